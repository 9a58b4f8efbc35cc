"""Corpus operators against brute force on small tables, with nulls, empties, ties and repeats."""

import itertools
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import ann, bytesets, fingerprint, language, licences, lm, mixing, neardup, packing, pages, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, shard string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, la, so, 0, 1, "x") for i, t, la, so in rows], DOCS)


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(1)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(300)]
    rows = [(i, " ".join(rng.choice(vocabulary, rng.integers(1, 80))) + ". B more.\nnext line", "en" if i % 2 else "fr", f"s{i % 4}") for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "s0") for i in range(8)]
    rows += [(200 + i, rows[i][1] + " tail", None, None) for i in range(8)]
    return [*rows, (300, None, None, None), (301, "", "en", "s1"), (302, " \t ", None, "s1"), (5, rows[5][1], "en", "s1")]


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_jaccard_join(spark, texts):
    got = {r["doc_id"]: r for r in neardup.jaccard_join(frame(spark, texts)).collect()}
    sets = [(i, shingles(t)) for i, t, *_ in texts]
    links, near = Counter(), {i: {i} for i, _ in sets}
    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if x and y and 5 * len(x & y) >= 4 * len(x | y):
            links[a] += 1
            links[b] += 1
            near[a].add(b)
            near[b].add(a)
    for i, s in sets:
        if i != 5:  # a repeated doc_id has one row for each, both alike
            assert got[i]["n_links"] == links[i]
        assert got[i]["class_id"] <= i and (not s or got[i]["class_id"] == min(got[j]["class_id"] for j in near[i]))


def test_word_hashes_do_not_depend_on_pieces(monkeypatch):
    text = b"ab  cd " + b"x" * 300 + b" ab\n" + b"y" * 70 + b" cd ab"
    raw, ends = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    start, end, _ = bytesets.words(raw, ends)
    base, mask = 0xD6E8FEB86659FD93, (1 << 64) - 1
    sums = [sum((b + 1) * pow(base, k, 1 << 64) for k, b in enumerate(text[a:z])) & mask for a, z in zip(start, end, strict=True)]
    for piece in (1, 5, 64, 1 << 18):
        monkeypatch.setattr(bytesets, "PIECE", piece)
        assert (bytesets.word_hashes(raw, start, end) == bytesets.fmix(np.array(sums, np.uint64))).all()


def test_large_group_of_near_copies_is_whole(spark):
    base = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join([*base, f"end{i}"]), "en", "s") for i in range(700)]
    got = neardup.jaccard_join(frame(spark, rows)).collect()
    assert {r["class_id"] for r in got} == {0} and {r["n_links"] for r in got} == {699}


def test_sharding(spark, texts):
    got = sharding.shard_documents(frame(spark, texts)).collect()
    assert len(got) == len(texts)
    assert all(0 <= r["shard"] < 40 and r["grown_shard"] is None for r in got)
    for k in range(40):
        slots = sorted(r["slot"] for r in got if r["shard"] == k)
        assert slots == list(range(len(slots)))
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    assert max(sizes.values()) <= sum(sizes.values()) / 40 + 2 * max(r["size"] for r in got)


def test_sharding_is_the_tree(spark):
    """Shards of groups of texts against a plain recursion: widest dimension by the variance of ranks, cut nearest to the weighted quantile."""
    from pyspark.sql.window import Window  # noqa: F401

    rng = np.random.default_rng(6)
    rows = [(i, "w" * int(rng.integers(1, 400)) + f" {i}", ["en", "de", "fr", None][int(rng.integers(0, 4))], f"s{int(rng.integers(0, 9)) ** 2 // 9}") for i in range(900)]
    docs = frame(spark, rows)
    places = docs.select(F.xxhash64("text").alias("_hash"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"), (F.octet_length("text") + 16).cast("long").alias("size"), F.lit(0).alias("_piece"), F.coalesce("lang", F.lit("\0")).alias("_l"), F.coalesce("source", F.lit("\0")).alias("_s"))
    cells = sharding.ranked_cells(places.withColumn("_weight", F.col("size"))).collect()

    def tree(cell, leaves):
        if leaves == 1:
            return [cell]
        w = [r["_weight"] for r in cell]
        spread = lambda c: sum(w) * sum(x * r[c] ** 2 for x, r in zip(w, cell)) - sum(x * r[c] for x, r in zip(w, cell)) ** 2
        axis = max(sharding.DIMENSIONS, key=spread)
        cell = sorted(cell, key=lambda r: (r[axis], r["_tie"]))
        goal, sums = sum(w) * (leaves // 2) / leaves, list(itertools.accumulate(r["_weight"] for r in cell))
        at = next(i for i, x in enumerate(sums) if x >= goal)
        at += sums[at] - goal <= goal - (sums[at - 1] if at else 0)
        return tree(cell[:at], leaves // 2) + tree(cell[at:], leaves - leaves // 2)

    # Leaves are numbered by their place in the tree (children of g are 2 g + 1 and 2 g + 2), so compare which texts lie together.
    want = {frozenset(r["text_crc32"] for r in leaf) for leaf in tree(cells, 40)}
    got = {}
    for r in sharding.shard_documents(docs, pieces_a_shard=1).collect():
        got.setdefault(r["shard"], set()).add(r["text_crc32"])
    assert {frozenset(v) for v in got.values()} == want


def test_empty_tables(spark):
    empty = frame(spark, [])
    for f in (neardup.jaccard_join, sharding.shard_documents, packing.pack_documents, mixing.mix_sources, lm.score_documents, licences.scan_licences, fingerprint.fingerprint_documents):
        assert f(empty).count() == 0
    assert language.identify(empty, language.learn(empty)).count() == 0
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert pages.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def slow_best_fit(sizes, lengths):
    bins = []
    for s in sorted(sizes, reverse=True):
        room = [b for b in bins if b[0] - sum(b[1]) >= s]
        if not room:
            length = min((n for n in lengths if n >= s), key=lambda n: ((n + 16) / (s * (n // s)), -n))
            bins.append((length, []))
            room = bins[-1:]
        min(room, key=lambda b: b[0] - sum(b[1]))[1].append(s)
    return len(bins)


def test_best_fit_matches_item_by_item():
    rng = np.random.default_rng(3)
    sizes = [int(x) for x in rng.integers(1, 64, 400)]
    placed, _ = packing.best_fit(Counter(sizes), (16, 32, 64), 16)
    bins = {}
    for size, _, n, each, first, _, held, length in placed:
        for b in range(first, first + n):
            bins.setdefault(b, ([], held, length))[0].extend([size] * each)
    assert all(sum(x) == held <= length for x, held, length in bins.values())
    assert len(bins) == slow_best_fit(sizes, (16, 32, 64))  # which of equally full bins is taken is free
    assert Counter(s for x, *_ in bins.values() for s in x) == Counter(sizes)


def test_packing_is_whole(spark, texts):
    long = (400, "w " * 10_000, "en", "s1")
    got = packing.pack_documents(frame(spark, [*texts, long])).collect()
    assert sum(r["n_tokens"] for r in got) == sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) + 1 for _, t, *_ in [*texts, long])
    for _, rows in itertools.groupby(sorted(got, key=lambda r: (r["bin"], r["bin_offset"])), key=lambda r: r["bin"]):
        rows = list(rows)
        assert [r["bin_offset"] for r in rows] == [sum(x["n_tokens"] for x in rows[:i]) for i in range(len(rows))]
        assert sum(r["n_tokens"] for r in rows) == rows[0]["bin_tokens"] <= rows[0]["bin_length"]


def test_mixing_meets_targets(spark, texts):
    got = mixing.mix_sources(frame(spark, texts)).collect()
    for source in {r["source"] for r in got}:
        rows = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in rows) - rows[0]["target"]) <= 3 * max(r["size"] for r in rows)
        assert all(r["taken"] <= 3 * r["size"] for r in rows)
        assert sum(r["size"] for r in rows) == rows[0]["source_size"]


def test_language(spark, texts):
    model = language.learn(frame(spark, texts))
    got = {r["doc_id"]: r for r in language.identify(frame(spark, texts), model).collect()}
    assert got[300]["lang_pred"] == got[301]["lang_pred"] == "und" and got[300]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert frame(spark, texts).columns == language.keep_known(frame(spark, texts), model).columns


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = docs.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0)
    got = language.identify(docs, language.learn(docs)).join(held.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got)


def test_lm_base_score(spark, texts):
    got = {r["doc_id"]: r for r in lm.score_documents(frame(spark, texts)).collect()}
    import zlib

    cut = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()), None]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, t, *_ in texts if not held(i) for w in cut(t))
    n, v = sum(c.values()), len(c)
    for i, t, *_ in texts:
        assert got[i]["held_out"] == held(i) and got[i]["train_tokens"] == n and got[i]["n_tokens"] == len(cut(t))
        assert got[i]["n_known"] == sum(w in c for w in cut(t))
        assert got[i]["base_score"] == pytest.approx(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in cut(t)))
        assert got[i]["score"] < 0


def test_lm_is_normalised():
    pairs = np.random.default_rng(0).poisson(2.0, (30, 30)).astype(float)
    assert np.allclose((10 ** lm.train(pairs, steps=40)).sum(axis=1), 1)


def test_nearest_recall_and_odd_vectors(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    odd = spark.createDataFrame([(9000, None), (9020, [0.0] * 64), (9040, [float("nan")] * 64), (9060, [1.0, None])], "vec_id long, embedding array<float>")
    rows = docs.select("vec_id", "embedding").collect()
    got = ann.nearest(docs.select("vec_id", "embedding").union(odd)).collect()
    x, ids = np.array([r["embedding"] for r in rows], np.float64), np.array([r["vec_id"] for r in rows])
    assert {r["query_id"] for r in got} == {int(i) for i in ids if i % 20 == 0}
    found, hits = {}, 0
    for r in got:
        found.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    for q, near in found.items():
        s = x @ x[ids == q][0]
        best = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:20]
        hits += len({int(ids[i]) for i in best} & set(near))
        assert all(abs(v - s[ids == i][0]) < 1e-12 for i, v in near.items())
    assert hits >= 0.9 * 20 * len(found)


@pytest.mark.parametrize("deviation", [0.5, 1.0])
def test_nearest_recall_with_unequal_lengths(spark, deviation):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(6000, 64))
    x *= np.exp(deviation * rng.normal(size=(6000, 1))) / np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {}
    for r in ann.nearest(rows).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in range(0, 6000, 20):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(set(np.argsort(-s)[:20].tolist()) & found[q])
    assert hits >= 0.95 * 20 * len(found), hits / 20 / len(found)


def test_index_meets_every_code_within_the_radius():
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 1 << 16, (500, ann.SUBSTRINGS)).astype(np.uint16)
    codes[100:200] = codes[3] ^ (1 << rng.integers(0, 16, (100, ann.SUBSTRINGS))).astype(np.uint16) * (rng.random((100, ann.SUBSTRINGS)) < np.linspace(0, 1, 100)[:, None])
    apart = np.bitwise_count(codes ^ codes[3]).sum(axis=1)
    need = ann.needed_radius(codes, np.broadcast_to(codes[3], codes.shape))
    index = ann.MultiIndex(codes)
    for radius in (0, 5, 63, 64, 130, 300, 700, ann.BITS):
        met = index.probe(codes[3:5], radius)[0]
        assert not set(np.flatnonzero(apart <= radius)) - set(np.flatnonzero(met))
        assert (met == (need <= radius)).all()


def test_blocks_stream_and_ties_go_to_smaller_ids(spark):
    """Blocks and their queries over several Arrow batches give what one block gives; extra columns with clashing names do nothing."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 16))
    x[400:] = x[:200]
    rows = spark.createDataFrame([(i, v.tolist(), 1, 2.0) for i, v in enumerate(x)] + [(5, [9.0] * 16, 1, 2.0)], "vec_id long, embedding array<double>, rank int, score double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    got = ann.nearest(rows, k=5, block=100).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert Counter(r["query_id"] for r in got) == dict.fromkeys(range(0, 600, 20), 5)
    hits = 0
    for r in got:
        s = x @ x[r["query_id"]]
        best = [i for i in np.lexsort((np.arange(600), -s)) if i != r["query_id"]][:5]
        hits += best[r["rank"] - 1] == r["vec_id"]
    assert hits >= 0.8 * len(got)


@pytest.mark.parametrize("n", [2000, 50000])
def test_index_selects(n):
    """Figures of the README: recall and the share of rows met, on uniform directions (the hardest case)."""
    x = np.random.default_rng(n).normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    mean, projection = ann.learn_rotation(x[:4096])
    codes, ask = ann.encode(x, mean, projection), np.arange(0, n, n // 100)
    near = np.argpartition(-(x[ask] @ x.T), 21, axis=1)[:, :21]
    need = np.sort(ann.needed_radius(codes[near.ravel()], np.repeat(codes[ask], 21, axis=0)))
    met = ann.MultiIndex(codes).probe(codes[ask + 1], int(need[int(0.95 * len(need))]))
    best = np.argpartition(-(x[ask + 1] @ x.T), 21, axis=1)[:, :21]
    assert np.take_along_axis(met, best, axis=1).mean() >= 0.9
    assert met.mean() < (0.2 if n > 2000 else 0.4)


def test_fingerprints(spark, texts):
    got = fingerprint.fingerprint_documents(frame(spark, texts)).collect()
    by_text = {}
    text_of = {i: t or "" for i, t, *_ in texts}
    for r in got:
        by_text.setdefault(text_of[r["doc_id"]], set()).add(r["fingerprint"])
        assert r["n_chars"] == len(text_of[r["doc_id"]]) and 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert all(len(v) == 1 for v in by_text.values())


def test_likeness_is_that_of_the_digests(spark):
    """Sketches that come apart at once, after larger ones and not at all give what the paragraphs themselves give."""
    rng = np.random.default_rng(5)
    lines = [f"line {k} of {k % 7} words" for k in range(3000)]
    rows = [(i, "\n".join(lines[k] for k in rng.choice(3000, n)), "en", "s") for i, n in enumerate((0, 1, 2, 9, 40, 41, 200, 700, 2500))]
    rows += [(9, rows[8][1] + "\nnew", "en", "s"), (10, rows[8][1], "en", "s")]
    near = {r["doc_id"]: r["near_next"] for r in fingerprint.fingerprint_documents(frame(spark, rows)).collect()}
    for (i, text, *_), (_, other, *_) in zip(rows, [rows[-1], *rows[:-1]], strict=True):
        a, b = ({p for p in t.split("\n") if p} for t in (text, other))
        assert near[i] == pytest.approx(1 - len(a ^ b) / (len(a) + len(b)) if a or b else 1.0)


def test_every_sentence_end_cuts_a_line(spark):
    """Whatever letter or script the next sentence starts with, in Spark and in the SQL's pattern; one edit leaves the rest of a line."""
    import duckdb

    cases = {
        "Some words. The rest! is it? Zoë left (so.) “Yes.” 9 of 3.5 at a.b ends.": ["Some words.", "The rest!", "is it?", "Zoë left (so.)", "“Yes.”", "9 of 3.5 at a.b ends."],
        "今天下雨。我们回家！「好吗？」他说。": ["今天下雨。", "我们回家！", "「好吗？」", "他说。"],
        "यह एक है। वह दो है। Это три. Вот… так": ["यह एक है।", "वह दो है।", "Это три.", "Вот…", "так"],
        "هل هذا؟ نعم. Ժամ։ Վերջ": ["هل هذا؟", "نعم.", "Ժամ։", "Վերջ"],
    }
    got = {r["text"]: r["p"] for r in frame(spark, [(i, t, "x", "s") for i, t in enumerate(cases)]).select("text", fingerprint.paragraphs(F.col("text")).alias("p")).collect()}
    assert got == cases
    for text, pieces in cases.items():
        assert duckdb.execute("SELECT string_split(regexp_replace(?, ?, '\\1' || chr(10) || '\\2', 'g'), chr(10))", [text, fingerprint.CUT]).fetchone()[0] == pieces
    line = [f"Sentence number {i} of many." for i in range(40)]
    rows = [(1, " ".join([*line[:20], "Other words here.", *line[21:]]), "en", "s"), (2, " ".join(line), "en", "s")]
    near = {r["doc_id"]: r["near_next"] for r in fingerprint.fingerprint_documents(frame(spark, rows)).collect()}
    assert near[2] == pytest.approx(1 - 2 / 80)


def test_pages():
    page = "<html><body><header><h1>Site</h1></header><nav><a>x</a></nav><div class='cookie-banner'>We use cookies.</div><article><h1>T</h1><p>One &amp; two,\n three. Long enough to be read as text.<p>Four</article><div id='comments'><p>Great post, really.</p></div><footer>f</footer></body></html>"
    assert pages.main_text(page) == "T\n\nOne & two, three. Long enough to be read as text.\n\nFour"
    assert pages.main_text(None) == pages.main_text("") == pages.main_text("<script>x</script>") == ""


@pytest.mark.parametrize("page", ["<div>x " * 50_000, "<div>x " * 50_000 + "</div>" * 50_000, "<b>" * 50_000 + "<div>x. </div>" * 50_000, "<li><ul>" + "<div>" * 50_000 + "<li>y</li>" * 50_000])
def test_deep_pages_take_work_in_their_length(page):
    import time

    began = time.time()
    assert pages.main_text(page)
    assert time.time() - began < 30  # about 2 s alone; the cube of the depth took hours


def test_pages_through_spark(spark):
    """Nulls, empties, a long text, repeated rows and extra columns of clashing names."""
    body = "<article>" + "".join(f"<p>Sentence {i}, of some words &amp; marks.</p>" for i in range(20_000)) + "</article>"
    rows = [(1, "u", body, "x", 7), (1, "u", body, "x", 7), (2, None, None, None, None), (None, "v", "", "y", 0), (3, "w", "<nav>menu</nav>", "", 1)]
    got = pages.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")).collect()
    assert [(r["page_id"], r["url"], r["n_chars"]) for r in got] == [(1, "u", n := len("\n\n".join(f"Sentence {i}, of some words & marks." for i in range(20_000)))), (1, "u", n), (2, None, 0), (None, "v", 0), (3, "w", 0)]
    assert all(len(r["text"]) == r["n_chars"] for r in got)


@pytest.mark.parametrize("tag", ["div", "section", "td"])
def test_pages_without_article_are_whole(tag):
    """Unequal sibling parts, and paragraphs around a long blockquote, all stay; surroundings go."""
    p = [f"Paragraph {i} has some words, and more of them; it is read as text." for i in range(8)]
    inner = lambda ps: "".join(f"<p>{x}</p>" for x in ps)
    parts = f"<{tag}>{inner(p[:6])}</{tag}><{tag}>{inner(p[6:])}</{tag}>"
    parts = f"<table><tr>{parts}</tr></table>" if tag == "td" else parts
    page = f"<html><body><nav><a href='/'>Home</a></nav>{parts}<footer>Some footer, with a mark.</footer></body></html>"
    assert pages.main_text(page) == "\n\n".join(p)
    quoted = f"<body><div>{inner(p[:1])}<blockquote>{inner(p[1:7])}</blockquote>{inner(p[7:])}</div><div class='comments'><p>Nice text, really.</p></div></body>"
    assert pages.main_text(quoted) == "\n\n".join(p)


def test_licences(spark):
    rows = [(1, "Text here.\nReleased under the MIT License.\nAll rights reserved.", "en", "s"), (2, None, None, None), (3, "Licensed under CC BY-NC 4.0.", "en", "s")]
    got = {r["doc_id"]: r for r in licences.scan_licences(frame(spark, rows)).collect()}
    assert got[1]["licences"] == "MIT;All-Rights-Reserved" and got[1]["licence"] == "MIT" and got[2]["n_sentences"] == 0 and got[2]["licence"] is None and got[3]["licence"] == "CC-BY-NC-4.0"
    assert all(any(a in s for a in licences.ANCHORS) for s in licences.SENTENCES)


NOTICES = {
    "MIT (full)": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.""",
    "Apache-2.0 (header)": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language.""",
    "GPL-3.0-or-later (header)": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program.  If not, see <https://www.gnu.org/licenses/>.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.""",
}
NOTICES |= {
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "LGPL-2.1-or-later (header)": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU Lesser General Public License for more details.

You should have received a copy of the GNU Lesser General Public License along with this library.""",
    "MPL-2.0 (header)": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "Unlicense (full)": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    "EPL-2.0": """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/""",
    "CC-BY-NC-ND-3.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 3.0 Unported License.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
}
NOTICES["GPL-2.0-or-later (header)"] = NOTICES["GPL-3.0-or-later (header)"].replace("software: you", "software; you").replace("Foundation, either version 3", "Foundation; either version 2").replace("program.  If not, see <https://www.gnu.org/licenses/>", "program; if not, write to the Free Software Foundation")


def test_whole_notices_wrapped_or_not(spark):
    import textwrap

    wrap = lambda t, lead, end: end.join(lead + line for p in t.split("\n\n") for line in [*textwrap.wrap(p.strip(), 72), ""])
    forms = [lambda t: t, lambda t: " ".join(t.split()), lambda t: wrap(t, "", "\n"), lambda t: wrap(t, " * ", "\n"), lambda t: wrap(t, "# ", "\r\n"), lambda t: "Title\nCopyright (c) 2020 Somebody\n" + wrap(t, "", "\n")]
    rows = [(10 * i + j, form(t), name, "s") for i, (name, t) in enumerate(NOTICES.items()) for j, form in enumerate(forms)]
    rows.append((99, "Copyright 2020 A Name\nAll rights reserved.\nReleased under\nthe MIT License. Not released under the MIT License.", "All", "s"))
    got = {r["doc_id"]: r for r in licences.scan_licences(frame(spark, rows)).collect()}
    assert {i: got[i]["licence"] for i, _, name, _ in rows if i != 99} == {i: name for i, _, name, _ in rows if i != 99}
    assert got[99]["sentence_ids"] == "reserved/notice;mit/notice"


def test_pipeline_is_its_stages(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.known_language(spark, docs, sf)
    assert set(kept.columns) == set(docs.columns) and kept.count() >= 0.95 * docs.count()
    one = corpus_pipeline.one_of_a_group(spark, kept, sf)
    sets = [shingles(r["text"]) for r in one.collect()]
    assert not any(x and y and 5 * len(x & y) >= 4 * len(x | y) for x, y in itertools.combinations(sets, 2))
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_pipeline_against_brute_force_with_null_and_repeated_ids(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    some = [r.asDict() for r in docs.orderBy("doc_id").limit(60).collect()]
    other = lambda r, **new: {**r, **new}
    odd = [other(some[0]), other(some[0]), other(some[1], doc_id=None), other(some[2], doc_id=None, text=some[2]["text"] + " " + " ".join(f"{w}x" for w in some[3]["text"].split()))]
    odd += [other(some[4], doc_id=some[5]["doc_id"]), other(some[6], doc_id=some[7]["doc_id"], text=" ".join(reversed(some[6]["text"].split()))), other(some[8], source=None, text=some[8]["text"] + "\n" + some[9]["text"])]
    odd += [other(odd[5], doc_id=None), other(odd[3])]
    spark.createDataFrame([tuple(r[c] for c in docs.columns) for r in some + odd], docs.schema).write.parquet(f"{tmp_path}/documents.parquet")
    sf, plain = str(tmp_path), lambda df: Counter(tuple(r) for r in df.collect())
    kept = corpus_pipeline.known_language(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    rows = kept.collect()
    assert any(r["doc_id"] is None for r in rows)
    sets, group = [shingles(r["text"]) for r in rows], list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            group = [group[i] if g == group[j] else g for g in group]
    one = corpus_pipeline.one_of_a_group(spark, kept, sf)
    order = lambda r: (r["doc_id"] is None, r["doc_id"] or 0)
    ids = Counter(min((r for r, g in zip(rows, group, strict=True) if g == k), key=order)["doc_id"] for k in set(group))
    assert Counter(r["doc_id"] for r in one.collect()) == ids and None in ids and max(ids.values()) > 1
    assert not plain(one) - plain(kept)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    copies = {(r["doc_id"], r["source"], r["size"]): r["copies"] for r in mixing.mix_sources(one).collect()}
    want = Counter({t: n * copies[t[docs.columns.index("doc_id")], t[docs.columns.index("source")], words(t[docs.columns.index("text")])] for t, n in plain(one).items()})
    mixed = corpus_pipeline.mixed_sources(spark, one, sf)
    assert plain(mixed) == +want
    got = corpus_pipeline.run(spark, sf).collect()
    assert sum(r["n_tokens"] for r in got) == sum(n * (words(t[docs.columns.index("text")]) + 1) for t, n in want.items())


SENTENCE = "Long sentence of the article, with words, that goes on. " * 6


@pytest.mark.parametrize("opening", ['<div class="has-sidebar">', '<div class="hentry comments-open">', '<div class="side-by-side">', '<div class="post tag-search">', '<section id="social-policy">', '<article class="post comments-open">', '<body class="comments-open no-sidebar"><article>', '<div class="sidebar"><main>'])
def test_no_page_is_lost_by_a_name(opening):
    end = "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", opening)))
    page = f'{opening}<h2>Title</h2><p>{SENTENCE}</p><p>Second. {SENTENCE}</p>{end}<div class="site-footer"><p>Foot note.</p></div><ul class="nav-links"><li>Home</li></ul>'
    got = pages.main_text(page)
    assert got.count("Long sentence") == 12 and "Second." in got and "Foot note" not in got and "Home" not in got


def test_all_articles_and_running_words_stay():
    assert pages.main_text(f"<main><article><p>{SENTENCE * 3}</p></article><article><p>Short one. {SENTENCE}</p></article></main>").count("Long sentence") == 24
    got = pages.main_text(f'<article><p>{SENTENCE}</p><p>The <label>term</label> and <button>key</button> stay.</p><ul><li><a href="x">Link one</a></li><li><a href="y">Link two</a></li></ul></article><section class="comments"><p>{SENTENCE * 9}</p></section>')
    assert got.endswith("The term and key stay.\n\nLink one\n\nLink two") and got.count("Long sentence") == 6
    assert "Lead." in pages.main_text(f"<main><p>Lead. {SENTENCE}</p><article><p>{SENTENCE * 4}</p></article></main>")


def test_language_model_takes_any_id(spark):
    """Null ids, ids past 2**53 in one batch with them, repeated rows, long texts."""
    rows = [(None, "a b c", "en", "s"), (2**60 + 1, "a b", "en", "s"), (2**60 + 3, "a b", "en", "s"), (5, None, "en", "s"), (5, None, "en", "s"), (7, "a " * 50_000, "en", "s"), (None, "a b c", "en", "s")]
    got = lm.score_documents(frame(spark, rows).coalesce(1)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows)
    assert all(not r["held_out"] and r["n_tokens"] == 4 for r in got if r["doc_id"] is None)
    assert {r["n_tokens"] for r in got if r["doc_id"] == 7} == {50_001} and {r["n_tokens"] for r in got if r["doc_id"] == 5} == {1}


def test_broadcasts_carry_no_classes(spark):
    """What tasks read must not need the library on executors."""
    import pickle

    docs = frame(spark, [(i, f"word{i % 3} and more text {i}", "en" if i % 2 else "fr", "s") for i in range(60)])
    model = language.learn(docs)
    assert b"ledgerloom" not in pickle.dumps(model.parts)


def test_stages_with_clashing_columns(spark):
    import corpus_pipeline

    docs = frame(spark, [(i, f"same words in this text number {i % 4} of all", "en", f"s{i % 2}") for i in range(12)] + [(None, None, None, None)])
    docs = docs.withColumns({"row": F.lit(1), "copies": F.lit(2), "size": F.lit(3), "copy": F.lit(4), "_copies": F.lit(5), "_row": F.lit(6), "keep": F.lit(7)})
    first = corpus_pipeline.one_of_a_group(spark, docs, "")
    assert first.columns == docs.columns and first.count() == 5 and {r["row"] for r in first.collect()} == {1}
    mixed = corpus_pipeline.mixed_sources(spark, first, "")
    assert mixed.columns == docs.columns and {(r["copies"], r["copy"], r["_copies"], r["keep"]) for r in mixed.collect()} == {(2, 4, 5, 7)}
    assert corpus_pipeline.mixed_sources(spark, corpus_pipeline.one_of_a_group(spark, docs.where("false"), ""), "").count() == 0
