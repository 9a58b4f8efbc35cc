"""Licence scans by sentence identifiers and ordered rules, in DataFrame functions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Whole sentences of well-known licence notices (as `normalise` leaves them) and their identifiers. At ";" an end
# may stand inside the sentence.
SENTENCES = {
    "licensed under the apache license version 2 0": "apache-2.0/notice",
    "licensed under the apache license version 2 0 the license": "apache-2.0/notice",
    "you may not use this file except in compliance with the license": "apache-2.0/compliance",
    "you may obtain a copy of the license at": "apache-2.0/copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-2.0/as-is",
    "released under the mit license": "mit/notice",
    "licensed under the mit license": "mit/notice",
    "this project is licensed under the mit license": "mit/notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit/grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit/notice-kept",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0/notice",
    "licensed under the gnu general public license version 3": "gpl-3.0/notice",
    "licensed under the gnu general public license version 2": "gpl-2.0/notice",
    "this program is free software; you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation; either version 3 of the license or at your option any later version": "gpl-3.0/grant",
    "this program is free software; you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation; either version 2 of the license or at your option any later version": "gpl-2.0/grant",
    "this program is distributed in the hope that it will be useful but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose": "gpl/warranty",
    "you should have received a copy of the gnu general public license along with this program": "gpl/copy",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd/grant",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd/no-endorsement",
    "licensed under the bsd license": "bsd/notice",
    "licensed under the mozilla public license version 2 0": "mpl-2.0/notice",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2.0/notice",
    "licensed under cc by 4 0": "cc-by-4.0/notice",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0/notice",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0/notice",
    "licensed under cc by nd 4 0": "cc-by-nd-4.0/notice",
    "licensed under cc by nc sa 4 0": "cc-by-nc-sa-4.0/notice",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4.0/notice",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa-4.0/notice",
    "this work is dedicated to the public domain under cc0 1 0": "cc0-1.0/notice",
    "all rights reserved": "reserved/notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit/as-is",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so": "mit-0/grant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc/grant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "0bsd/grant",
    "this is free and unencumbered software released into the public domain": "unlicense/notice",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense/grant",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib/grant",
    "altered source versions must be plainly marked as such and must not be misrepresented as being the original software": "zlib/altered",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "bsl-1.0/grant",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at": "epl-2.0/grant",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at": "epl-1.0/grant",
    "if a copy of the mpl was not distributed with this file you can obtain one at": "mpl-2.0/copy",
    "this library is free software; you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation; either version 2 1 of the license or at your option any later version": "lgpl-2.1/grant",
    "this library is free software; you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation; either version 3 of the license or at your option any later version": "lgpl-3.0/grant",
    "this program is free software; you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation; either version 3 of the license or at your option any later version": "lgpl-3.0/grant",
    "this program is free software; you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation; either version 3 of the license or at your option any later version": "agpl-3.0/grant",
    "this library is distributed in the hope that it will be useful but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose": "gpl/warranty",
    "you should have received a copy of the gnu lesser general public license along with this library; if not write to the free software foundation inc": "lgpl/copy",
    "you should have received a copy of the gnu lesser general public license along with this library": "lgpl/copy",
    "you should have received a copy of the gnu lesser general public license along with this program": "lgpl/copy",
    "you should have received a copy of the gnu affero general public license along with this program": "agpl/copy",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd/source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd/binary",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "bsd/advertising",
    "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed": "wtfpl/grant",
    "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work": "cc0-1.0/waiver",
    "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies": "postgresql/grant",
    "this font software is licensed under the sil open font license version 1 1": "ofl-1.1/notice",
    "this work is published from the united states under the public domain mark 1 0": "pdm-1.0/notice",
}
# How notices begin, and the names that follow, with the licence's identifier.
OPENINGS = ("licensed under the", "released under the", "distributed under the", "available under the", "this project is licensed under the", "this work is licensed under the", "this software is licensed under the", "this file is licensed under the", "this program is licensed under the", "this software is released under the", "this library is distributed under the")
NAMES = {
    "apache license version 2 0": "apache-2.0", "apache license 2 0": "apache-2.0", "apache 2 0 license": "apache-2.0", "mit license": "mit", "mit no attribution license": "mit-0", "isc license": "isc", "zero clause bsd license": "0bsd",
    "bsd license": "bsd", "bsd 2 clause license": "bsd-2", "simplified bsd license": "bsd-2", "bsd 3 clause license": "bsd-3", "new bsd license": "bsd-3", "bsd 4 clause license": "bsd-4",
    "gnu general public license version 2": "gpl-2.0", "gnu general public license v2 0": "gpl-2.0", "gnu general public license version 3": "gpl-3.0", "gnu general public license v3 0": "gpl-3.0",
    "gnu lesser general public license version 2 1": "lgpl-2.1", "gnu lesser general public license version 3": "lgpl-3.0", "gnu affero general public license version 3": "agpl-3.0", "gnu free documentation license version 1 3": "gfdl-1.3",
    "mozilla public license version 2 0": "mpl-2.0", "mozilla public license 2 0": "mpl-2.0", "mozilla public license v 2 0": "mpl-2.0", "mozilla public license version 1 1": "mpl-1.1", "zlib license": "zlib", "boost software license version 1 0": "bsl-1.0",
    "eclipse public license version 2 0": "epl-2.0", "eclipse public license 2 0": "epl-2.0", "eclipse public license version 1 0": "epl-1.0", "common development and distribution license version 1 0": "cddl-1.0", "artistic license 2 0": "artistic-2.0",
    "european union public licence version 1 2": "eupl-1.2", "sil open font license version 1 1": "ofl-1.1", "postgresql license": "postgresql", "python software foundation license version 2": "psf-2.0", "microsoft public license": "ms-pl", "academic free license version 3 0": "afl-3.0",
    "open software license version 3 0": "osl-3.0", "universal permissive license version 1 0": "upl-1.0", "unlicense": "unlicense", "do what the fuck you want to public license version 2": "wtfpl", "ncsa open source license": "ncsa", "w3c software notice and license": "w3c",
}
#: Creative Commons codes as words; with each version and both wordings they make a notice by rule.
COMMONS = {"by": "attribution", "by sa": "attribution sharealike", "by nc": "attribution noncommercial", "by nd": "attribution noderivatives", "by nc sa": "attribution noncommercial sharealike", "by nc nd": "attribution noncommercial noderivatives"}
VERSIONS = {"2 0": "generic", "2 5": "generic", "3 0": "unported", "4 0": "international"}
SENTENCES |= {f"{o} {n}": f"{i}/notice" for o in OPENINGS for n, i in NAMES.items() if f"{o} {n}" not in SENTENCES}
for _code, _words in COMMONS.items():
    for _version, _kind in VERSIONS.items():
        _id = f"cc-{_code.replace(' ', '-')}-{_version.replace(' ', '.')}/notice"
        SENTENCES |= {f"licensed under cc {_code} {_version}": _id, f"this work is licensed under a creative commons {_words} {_version} {_kind} license": _id}
# Rules in order, most specific first: licence and the sentences that must follow one another, gaps allowed.
RULES = [
    ("Apache-2.0 (header)", ["apache-2.0/notice", "apache-2.0/compliance", "apache-2.0/copy", "apache-2.0/as-is"]),
    ("MIT (full)", ["mit/grant", "mit/notice-kept"]),
    ("GPL-3.0-or-later (header)", ["gpl-3.0/grant", "gpl/warranty", "gpl/copy"]),
    ("GPL-2.0-or-later (header)", ["gpl-2.0/grant", "gpl/warranty", "gpl/copy"]),
    ("AGPL-3.0-or-later (header)", ["agpl-3.0/grant", "gpl/warranty", "agpl/copy"]),
    ("LGPL-2.1-or-later (header)", ["lgpl-2.1/grant", "gpl/warranty", "lgpl/copy"]),
    ("LGPL-3.0-or-later (header)", ["lgpl-3.0/grant", "gpl/warranty", "lgpl/copy"]),
    ("MPL-2.0 (header)", ["mpl-2.0/notice", "mpl-2.0/copy"]),
    ("BSD-4-Clause", ["bsd/grant", "bsd/advertising"]),
    ("BSD-3-Clause", ["bsd/grant", "bsd/no-endorsement"]),
    ("BSD-2-Clause", ["bsd/grant"]),
    ("Unlicense (full)", ["unlicense/notice", "unlicense/grant"]),
    ("Zlib (full)", ["zlib/grant", "zlib/altered"]),
    ("AGPL-3.0-or-later", ["agpl-3.0/grant"]),
    ("LGPL-2.1-or-later", ["lgpl-2.1/grant"]),
    ("LGPL-3.0-or-later", ["lgpl-3.0/grant"]),
    ("GPL-3.0-or-later", ["gpl-3.0/grant"]),
    ("GPL-2.0-or-later", ["gpl-2.0/grant"]),
    ("Apache-2.0", ["apache-2.0/notice"]),
    ("MIT", ["mit/grant"]),
    ("MIT", ["mit/notice"]),
    ("MIT-0", ["mit-0/grant"]),
    ("MIT-0", ["mit-0/notice"]),
    ("ISC", ["isc/grant"]),
    ("ISC", ["isc/notice"]),
    ("0BSD", ["0bsd/grant"]),
    ("0BSD", ["0bsd/notice"]),
    ("GPL-3.0-only", ["gpl-3.0/notice"]),
    ("GPL-2.0-only", ["gpl-2.0/notice"]),
    ("LGPL-3.0-only", ["lgpl-3.0/notice"]),
    ("LGPL-2.1-only", ["lgpl-2.1/notice"]),
    ("AGPL-3.0-only", ["agpl-3.0/notice"]),
    ("GFDL-1.3-only", ["gfdl-1.3/notice"]),
    ("BSD-4-Clause", ["bsd-4/notice"]),
    ("BSD-3-Clause", ["bsd-3/notice"]),
    ("BSD-2-Clause", ["bsd-2/notice"]),
    ("BSD", ["bsd/notice"]),
    ("MPL-2.0", ["mpl-2.0/notice"]),
    ("MPL-1.1", ["mpl-1.1/notice"]),
    ("EPL-2.0", ["epl-2.0/grant"]),
    ("EPL-2.0", ["epl-2.0/notice"]),
    ("EPL-1.0", ["epl-1.0/grant"]),
    ("EPL-1.0", ["epl-1.0/notice"]),
    ("BSL-1.0", ["bsl-1.0/grant"]),
    ("BSL-1.0", ["bsl-1.0/notice"]),
    ("Zlib", ["zlib/grant"]),
    ("Zlib", ["zlib/notice"]),
    ("Unlicense", ["unlicense/notice"]),
    ("WTFPL", ["wtfpl/grant"]),
    ("WTFPL", ["wtfpl/notice"]),
    ("PostgreSQL", ["postgresql/grant"]),
    ("PostgreSQL", ["postgresql/notice"]),
    ("CDDL-1.0", ["cddl-1.0/notice"]),
    ("Artistic-2.0", ["artistic-2.0/notice"]),
    ("EUPL-1.2", ["eupl-1.2/notice"]),
    ("OFL-1.1", ["ofl-1.1/notice"]),
    ("PSF-2.0", ["psf-2.0/notice"]),
    ("MS-PL", ["ms-pl/notice"]),
    ("AFL-3.0", ["afl-3.0/notice"]),
    ("OSL-3.0", ["osl-3.0/notice"]),
    ("UPL-1.0", ["upl-1.0/notice"]),
    ("NCSA", ["ncsa/notice"]),
    ("W3C", ["w3c/notice"]),
    *[(f"CC-{c.upper().replace(' ', '-')}-{v.replace(' ', '.')}", [f"cc-{c.replace(' ', '-')}-{v.replace(' ', '.')}/notice"]) for v in reversed(VERSIONS) for c in reversed(COMMONS)],
    ("CC0-1.0", ["cc0-1.0/notice"]),
    ("CC0-1.0", ["cc0-1.0/waiver"]),
    ("PDM-1.0", ["pdm-1.0/notice"]),
    ("All-Rights-Reserved", ["reserved/notice"]),
]
#: Every known sentence has one of these words; a text without them has no licence sentence.
ANCHORS = ("licen", "permission", "permitted", "copyright", "reserved", "public domain", "warranty", "redistribut", "free to copy", "altered source", "copy of the mpl", "advertising materials")
#: Ends of sentences in the SQL: a line break, or a full stop, exclamation or question mark with white space behind it.
BREAK = r"[.!?;]+[\s]|[\n\r]+"


def normalise(sentence: Column) -> Column:
    """Lower case; anything but letters and digits is one blank."""
    return F.trim(F.regexp_replace(F.lower(sentence), r"[^\p{L}\p{N}]+", " "))


#: A character that stands for an end inside a text; then: what ends a sentence (also a colon, and the address that notices set without a mark),
#: and lines without a letter or digit, which part paragraphs (a single line break does not: notices are wrapped).
END = "\x01"
ENDS = r"[.!?;:]+\s|https?://[^\s\x01]+"
#: Short forms whose mark ends nothing: "v. 2.0", "No. 3".
SHORT = r"\b([vV]|[nN]o|[vV]er)\.\s"
BLANK_LINES = r"\n(?:[^\p{L}\p{N}\n\x01]*\n)+"


def clauses(text: Column) -> Column:
    """A text in normalised words, with END at ends of sentences and paragraphs and a line feed at single line breaks."""
    lines = F.regexp_replace(F.translate(F.lower(text), END, " "), r"\r\n?", "\n")
    parted = F.regexp_replace(F.regexp_replace(F.regexp_replace(lines, SHORT, "$1 "), BLANK_LINES, END), ENDS, END)
    return F.regexp_replace(parted, r"[^\p{L}\p{N}\n\x01]+", " ")


def sentence_pattern() -> str:
    """Any known sentence, on one line or wrapped, between two ends or line breaks; the longest first."""
    gap = {" ": r"(?: ?\n ?| )", "; ": r"[ \n\x01]+"}
    wrapped = lambda xs: "|".join("".join(gap.get(x, x) for x in re.split("(;? )", s)) for s in sorted(xs, key=len, reverse=True))
    made = {f"{o} {n}" for o in OPENINGS for n in NAMES}
    whole = f"{wrapped(set(SENTENCES) - made)}|(?:{wrapped(OPENINGS)}){gap[' ']}(?:{wrapped(NAMES)})"
    return rf"(?<=^ ?|[\n\x01] ?)(?:{whole})(?= ?(?:[\n\x01]|$))"


def rule_patterns() -> list[tuple[str, str]]:
    """Each rule as a pattern over `;a;b;c;`, the text's sequence of identifiers; identifiers of other sentences may stand between."""
    return [(name, ";" + ";(.*;)?".join(x.replace(".", "[.]") for x in ids) + ";") for name, ids in RULES]


def scan_licences(docs: DataFrame) -> DataFrame:
    """Licences that each whole text names.

    Whole sentences of a fixed table are found in the normalised words, on one line or wrapped over several (also behind the marks
    of comments): they start and end at sentence ends, paragraphs or line breaks. The identifiers found, in text order, are matched with the ordered rules. `licences` has every licence whose rule matches, once, in rule
    order (the most specific rule first); `licence` is the first.

    Defined cases: null, empty or licence-free text: no sentence, empty lists, licence null; sentences that repeat count
    each; ties cannot occur (rules are ordered); repeated rows are scanned each; other columns are ignored.
    Returns doc_id, n_sentences, sentence_ids (joined by ;), licences (joined by ;), licence.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    known = F.create_map(*[F.lit(x) for s, i in SENTENCES.items() for x in (s.replace(";", ""), i)])
    pieces = F.regexp_extract_all(clauses(text), F.lit(sentence_pattern()), F.lit(0))
    found = F.transform(pieces, lambda s: F.try_element_at(known, normalise(s)))
    has_anchor = F.lower(text).rlike("|".join(ANCHORS))
    ids = docs.select("doc_id", F.when(has_anchor, found).otherwise(F.array().cast("array<string>")).alias("_ids"))
    flat = ids.select("doc_id", F.size("_ids").alias("n_sentences"), F.array_join("_ids", ";").alias("sentence_ids"))
    sequence = F.concat(F.lit(";"), F.regexp_replace("sentence_ids", ";", ";;"), F.lit(";"))
    hits = F.array_distinct(F.array_compact(F.array(*[F.when(sequence.rlike(p), F.lit(name)) for name, p in rule_patterns()])))
    hits = F.when(F.col("n_sentences") == 0, F.array().cast("array<string>")).otherwise(hits)
    return flat.withColumn("_hits", hits).select("doc_id", "n_sentences", "sentence_ids", F.array_join("_hits", ";").alias("licences"), F.try_element_at("_hits", F.lit(1)).alias("licence"))


def scan_sql() -> str:
    """The scan for DuckDB line by line, as the given tables have their notices; it does not find wrapped ones."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    table = ", ".join(f"({q(k)}, {q(v)})" for k, v in SENTENCES.items())
    hits = ", ".join(f"CASE WHEN regexp_matches(s, {q(p)}) THEN {q(name)} END" for name, p in rule_patterns())
    return f"""
    WITH known(sentence, id) AS (VALUES {table}),
    pieces AS (SELECT rowid_, unnest(p) AS piece, generate_subscripts(p, 1) AS pos FROM (
        SELECT row_number() OVER () AS rowid_, string_split_regex(regexp_replace(coalesce(text, ''), '{SHORT}', '\\1 ', 'g'), '{BREAK}') AS p FROM documents)),
    found AS (SELECT rowid_, string_agg(id, ';' ORDER BY pos) AS ids, count(*) AS n FROM pieces
        JOIN known ON trim(regexp_replace(lower(piece), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) = sentence GROUP BY rowid_),
    flat AS (SELECT d.doc_id, coalesce(f.n, 0)::INTEGER AS n_sentences, coalesce(f.ids, '') AS sentence_ids,
        ';' || replace(coalesce(f.ids, ''), ';', ';;') || ';' AS s
        FROM (SELECT doc_id, row_number() OVER () AS rowid_ FROM documents) d LEFT JOIN found f USING (rowid_)),
    hit AS (SELECT *, list_filter([{hits}], lambda x: x IS NOT NULL) AS h FROM flat)
    SELECT doc_id, n_sentences, sentence_ids,
        coalesce(array_to_string(list_filter(h, lambda x, i: list_position(h, x) = i), ';'), '') AS licences, h[1] AS licence FROM hit"""
