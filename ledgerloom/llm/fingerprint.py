"""Document fingerprints as invertible Bloom lookup sketches, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .kit import spread

CHECK_BITS = 24
#: Below this the product with a digest's 36 bits stays in 63.
CHECK_FACTOR, CHECK_SHIFT = 119_304_647, 20
#: A sketch has shares, of three tables of four cells each.
TABLES, CELLS, SHARES = 3, 4, 4
#: First bit of a digest's places in a share, of its finer share, and of the parts of a large share.
FIRST_PLACE, FIRST_FINER, FIRST_PART = 12, 18, 30
#: Digests a finer share may hold, most finer shares, rounds of peeling, and the size from which a share is parted first.
LOAD, FINEST, ROUNDS, LARGE = 3, 64, 5, 96
#: Marks that end a sentence in some script, quotes and brackets that may close behind them, and blanks, for a character class of Java and RE2.
MARKS = ".!?…‥‽؟۔।॥։።፧፨။។៕།׃᠃᠉。！？｡．\u037e"
CLOSING = r"\x22\x27)\]}”’“‘»«›‹」』）】》〉"
BLANKS = r" \t\x{A0}\x{3000}"
#: Lines are cut further at each sentence end: marks with blanks behind them (left out), or with a character that is not ASCII, as in scripts
#: without blanks ("3.5" and "a.b" stay whole).
CUT = rf"([{MARKS}]+[{CLOSING}]*)(?:[{BLANKS}]+|([^\x00-\x7F{MARKS}{CLOSING}{BLANKS}]))"


def paragraphs(text: Column) -> Column:
    """Lines; a line is cut further at each sentence end: one edit in a line then leaves the rest of it. Blank ones are left out."""
    return F.filter(F.split(F.regexp_replace(text, CUT, "$1\n$2"), "\n"), lambda p: F.trim(p) != "")


def check(h: Column) -> Column:
    """24 bits that a digest's 36 determine."""
    return F.shiftright(h * CHECK_FACTOR, CHECK_SHIFT).bitwiseAND((1 << CHECK_BITS) - 1)


def digests(text: Column) -> Column:
    """The distinct paragraphs' digests: 36 bits of md5, then the check by which a lone digest in a cell is known."""
    hashed = F.array_distinct(F.transform(paragraphs(text), lambda p: F.conv(F.substring(F.md5(p), 1, 9), 16, 10).cast("long")))
    return F.transform(hashed, lambda h: F.shiftleft(h, CHECK_BITS).bitwiseOR(check(h)))


def share(ds: Column, number: Column, shares: Column | int, first_bit: int = 0) -> Column:
    return F.filter(ds, lambda d: F.shiftright(d, CHECK_BITS + first_bit).bitwiseAND(shares - 1) == number)


def place(d: Column, table: int) -> Column:
    return F.shiftright(d, CHECK_BITS + FIRST_PLACE + 2 * table).bitwiseAND(CELLS - 1)


def put(cell: Column, d: Column, sign: Column | int) -> Column:
    return F.struct((cell["c"] + sign).alias("c"), cell["x"].bitwiseXOR(d).alias("x"))


def cells_of(plus: Column, minus: Column | None = None) -> Column:
    """Cells (c: how many digests, x: their exclusive or) of a share, less those of another; a digest is in one cell of each table."""

    def cell(table: int, at: int) -> Column:
        here = lambda d: place(d, table) == at
        held = F.aggregate(F.filter(plus, here), F.struct(F.lit(0).alias("c"), F.lit(0).cast("long").alias("x")), lambda c, d: put(c, d, 1))
        return held if minus is None else F.aggregate(F.filter(minus, here), held, lambda c, d: put(c, d, -1))

    return F.array(*[cell(t, k) for t in range(TABLES) for k in range(CELLS)])


def let(value: Column, use) -> Column:
    """Evaluate `value` once and use it several times."""
    return F.element_at(F.transform(F.array(value), use), 1)


def numbers(n: int) -> Column:
    return F.array(*[F.lit(i) for i in range(n)])


def sketch(ds: Column) -> Column:
    return F.transform(F.transform(numbers(SHARES), lambda b: share(ds, b, SHARES)), lambda part: cells_of(part))


def less(cell: Column, other: Column) -> Column:
    return F.struct((cell["c"] - other["c"]).alias("c"), cell["x"].bitwiseXOR(other["x"]).alias("x"))


def peel(cells: Column) -> Column:
    """The digests that a share's cells give back, negative ones of what was subtracted; null if some stay.

    A cell is lone if its count is 1 or -1 and what it holds has its own check. Each round takes all lone digests out of their cells.
    """
    sure = lambda d: d.bitwiseAND((1 << CHECK_BITS) - 1) == check(F.shiftright(d, CHECK_BITS))
    used = lambda cs: F.size(F.filter(cs, lambda c: (c["c"] != 0) | (c["x"] != 0)))

    def places(d: Column) -> Column:
        at = [F.call_function("shiftleft", F.lit(1 << CELLS * t), place(d, t).cast("int")) for t in range(TABLES)]
        return at[0].bitwiseOR(at[1]).bitwiseOR(at[2])

    def step(state: Column, _: Column) -> Column:
        held = F.filter(state["cells"], lambda c: (F.abs(c["c"]) == 1) & sure(c["x"]))
        lone = F.array_distinct(F.transform(held, lambda c: F.struct(c["x"].alias("d"), c["c"].alias("s"), places(c["x"]).alias("at"))))
        in_cell = lambda p, k: F.call_function("shiftright", p["at"], k).bitwiseAND(1) == 1
        rest = lambda ps: F.transform(state["cells"], lambda c, k: F.aggregate(ps, c, lambda x, p: F.when(in_cell(p, k), put(x, p["d"], -p["s"])).otherwise(x)))
        after = lambda ps: F.when(F.size(ps) == 0, state).otherwise(F.struct(rest(ps).alias("cells"), F.concat(state["out"], F.transform(ps, lambda p: p["d"] * p["s"])).alias("out"), F.lit(True).alias("open")))
        return F.when(state["open"], let(lone, after)).otherwise(state)

    start = F.struct(cells.alias("cells"), F.array().cast("array<bigint>").alias("out"), F.lit(True).alias("open"))
    end = F.aggregate(numbers(ROUNDS), start, step)
    # Nothing differs, or more than five sixths of the cells are in use: settled at once.
    return let(used(cells), lambda n: F.when(n == 0, F.array().cast("array<bigint>")).when(n * 6 <= 5 * TABLES * CELLS, let(end, lambda s: F.when(used(s["cells"]) == 0, s["out"]))))


def exact(a: Column, b: Column) -> Column:
    return F.concat(F.array_except(a, b), F.transform(F.array_except(b, a), lambda d: -d))


def larger(a: Column, b: Column) -> Column:
    """What two shares differ in by a larger sketch: as many finer shares as their digests need, each built anew. A finer share that does not come
    apart is sketched with 4 times the cells; digests that agree in all those bits, which no sketch parts, are compared themselves."""
    shares = F.call_function("shiftleft", F.lit(1), F.least(F.lit(FINEST.bit_length() - 1), F.greatest(F.lit(0), F.ceil(F.log2((F.size(a) + F.size(b)) / LOAD)).cast("int"))))
    four = lambda x, y: F.aggregate(numbers(4), F.array().cast("array<bigint>"), lambda out, k: F.concat(out, let(share(x, k, 4, FIRST_PART + 4), lambda p: let(share(y, k, 4, FIRST_PART + 4), lambda q: F.coalesce(let(cells_of(p, q), peel), exact(p, q))))))
    one = lambda x, y: F.coalesce(let(cells_of(x, y), peel), four(x, y))
    return let(shares, lambda n: F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda k: let(share(a, k, n, FIRST_FINER), lambda x: let(share(b, k, n, FIRST_FINER), lambda y: one(x, y))))))


def differing(a: Column, b: Column, sketch_a: Column, sketch_b: Column) -> Column:
    """The digests in which two documents differ (negative: of the second), from their sketches; shares that do not come apart are sketched larger.

    A share of over LARGE digests is dealt into 16 parts first, so that no filter runs over a long document for each of many finer shares.
    """

    def retried(x: Column, y: Column) -> Column:
        part = lambda k: let(share(x, k, 16, FIRST_PART), lambda p: let(share(y, k, 16, FIRST_PART), lambda q: larger(p, q)))
        return F.when(F.size(x) + F.size(y) <= LARGE, larger(x, y)).otherwise(F.flatten(F.transform(numbers(16), part)))

    def one(k: Column) -> Column:
        cells = F.zip_with(F.element_at(sketch_a, k + 1), F.element_at(sketch_b, k + 1), less)
        return F.coalesce(let(cells, peel), let(share(a, k, SHARES), lambda x: let(share(b, k, SHARES), lambda y: retried(x, y))))

    return F.flatten(F.transform(numbers(SHARES), one))


def written(ds: Column, cells: Column) -> Column:
    """A sketch as text: number of digests, then count:digest of each cell in hex."""
    return F.concat(F.size(ds).cast("string"), F.lit("/"), F.array_join(F.transform(F.flatten(cells), lambda c: F.concat(F.hex(c["c"]), F.lit(":"), F.hex(c["x"]))), ","))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, its digests `a`, and text and digests `b` of the next document by descending doc_id (after the last, the first).

    Rows are dealt by ranges of doc_id; a range finds the next row by a window of its own, and its last row takes the first of the next range,
    one row a range, so no task sees more than a range.
    """
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ranges = 4 * spread(docs)
    bounds = docs.select(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 100 * ranges)).first()[0] or []
    held = F.array(*[F.lit(b) for b in sorted(set(bounds))]).cast("array<long>")
    # How many bounds lie below, by halving.
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(max(1, len(bounds)).bit_length()))])
    below = F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.coalesce(F.try_element_at(held, at + s) < F.col("doc_id"), F.lit(False)), at + s).otherwise(at))
    rows = text.withColumn("_range", F.when(F.col("doc_id").isNull(), -1).otherwise(below))
    # The first row of each range: its largest doc_id, then, of the rows of that doc_id alone, the largest text.
    most = rows.groupBy("_range").agg(F.max("doc_id").alias("_most"))
    tops = rows.join(F.broadcast(most.withColumnRenamed("_range", "_r")), (F.col("_range") == F.col("_r")) & F.col("doc_id").eqNullSafe(F.col("_most")))
    first = tops.groupBy("_range").agg(F.max(F.struct("doc_id", "text")).alias("_first")).select("_range", F.struct("_first.*", digests(F.col("_first.text")).alias("a")).alias("_first"))
    rows = rows.withColumn("a", digests(F.col("text")))
    # One row a range: these two windows see at most `ranges` rows.
    down = Window.orderBy(F.desc("_range"))
    follow = first.select("_range", F.coalesce(F.lead("_first").over(down), F.first("_first").over(down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_follow"))
    order = Window.partitionBy("_range").orderBy(F.desc_nulls_last("doc_id"), F.desc("text"))
    led = rows.withColumn("_lead", F.lead(F.struct("doc_id", "text", "a")).over(order))
    following = led.join(follow.hint("shuffle_hash"), "_range").withColumn("_lead", F.coalesce("_lead", "_follow"))
    return following.select("doc_id", "text", "a", F.col("_lead.text").alias("next_text"), F.col("_lead.a").alias("b"))


def compare(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, both fingerprints, and the digests that their sketches give back: `differs_edited`, `differs_next` (negative
    ones are the edited or next text's), with the numbers of digests `_a`, `_e` and `_b`."""
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = with_next(docs).select("doc_id", "a", "b", n.cast("long").alias("n_chars"), F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) as int))"), F.substring("next_text", F.lit(1), half)).alias("edited"))
    digested = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "a", digests(F.col("edited")).alias("e"), "b")
    sketched = digested.select("*", sketch(F.col("a")).alias("sa"), sketch(F.col("e")).alias("se"), sketch(F.col("b")).alias("sb"))
    a, e, b, sa, se, sb = (F.col(x) for x in ("a", "e", "b", "sa", "se", "sb"))
    return sketched.select(
        "doc_id", "n_chars", "edited_sha256", written(a, sa).alias("fingerprint"), written(e, se).alias("edited_fingerprint"), F.size(a).alias("_a"), F.size(e).alias("_e"), F.size(b).alias("_b"),
        differing(a, e, sa, se).alias("differs_edited"), differing(a, b, sa, sb).alias("differs_next"))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprint every whole text and its edited text, whose last half is the start of the next document.

    A fingerprint is an invertible Bloom lookup sketch of the text's distinct paragraphs' digests: 4 shares of 3 x 4 cells, each with a count
    and an exclusive or. Two sketches are subtracted cell by cell and peeled; the digests that come out are the paragraphs that differ, and
    likeness is 1 - differing digests / digests of both.

    Defined cases: null text is empty; texts without paragraphs have equal fingerprints and likeness 1; a lone document is its own next; rows of
    one doc_id are ordered by descending text; a null doc_id comes last; no rows give no rows; other columns are ignored.
    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next (`compare` has the recovered digests).
    """
    likeness = lambda d, total: F.when(total == 0, F.lit(1.0)).otherwise(1 - F.size(d) / total)
    return compare(docs).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness("differs_edited", F.col("_a") + F.col("_e")).alias("near_edited"), likeness("differs_next", F.col("_a") + F.col("_b")).alias("near_next"))


def fingerprint_sql() -> str:
    """The same for DuckDB; the likeness from the digests themselves."""
    digest = "(('0x' || substr(md5({0}), 1, 9))::BIGINT)"
    cells = SHARES * TABLES * CELLS
    return f"""
    WITH d AS (SELECT row_number() OVER (ORDER BY doc_id DESC NULLS LAST, coalesce(text, '') DESC) AS i, doc_id, coalesce(text, '') AS text FROM documents),
    n AS (SELECT d.i, d.doc_id, d.text, coalesce(e.text, f.text) AS next_text FROM d LEFT JOIN d e ON e.i = d.i + 1 CROSS JOIN (SELECT text FROM d WHERE i = 1) f),
    t AS (SELECT *, substr(text, 1, length(text) - length(text) // 2) || substr(next_text, 1, length(text) // 2) AS edited FROM n),
    u AS (SELECT i, 'a' AS k, text AS t FROM t UNION ALL SELECT i, 'e', edited FROM t UNION ALL SELECT i, 'b', next_text FROM t),
    p AS (SELECT DISTINCT i, k, {digest.format("p")} AS h FROM (SELECT i, k, unnest(string_split(regexp_replace(t, '{CUT}', '\\1' || chr(10) || '\\2', 'g'), chr(10))) AS p FROM u) WHERE trim(p) <> ''),
    g AS (SELECT i, k, h, (h << {CHECK_BITS}) | (((h * {CHECK_FACTOR}) >> {CHECK_SHIFT}) & {(1 << CHECK_BITS) - 1}) AS x FROM p),
    c AS (SELECT i, k, (h & {SHARES - 1}) * {TABLES * CELLS} + t * {CELLS} + ((h >> ({FIRST_PLACE} + 2 * t)) & {CELLS - 1}) AS cell, x FROM g, range({TABLES}) r(t)),
    s AS (SELECT i, k, cell, count(*) AS n, bit_xor(x) AS x FROM c GROUP BY ALL),
    z AS (SELECT t.i, k.k, string_agg(hex(coalesce(s.n, 0)) || ':' || hex(coalesce(s.x, 0)), ',' ORDER BY r.cell) AS cells
        FROM t CROSS JOIN (VALUES ('a'), ('e')) k(k) CROSS JOIN range({cells}) r(cell) LEFT JOIN s ON s.i = t.i AND s.k = k.k AND s.cell = r.cell GROUP BY ALL),
    m AS (SELECT i, count(*) FILTER (k = 'a') AS a, count(*) FILTER (k = 'e') AS e, count(*) FILTER (k = 'b') AS b FROM g GROUP BY i),
    q AS (SELECT x.i, count(*) FILTER (y.k = 'e') AS ae, count(*) FILTER (y.k = 'b') AS ab FROM g x JOIN g y ON x.i = y.i AND x.h = y.h AND x.k = 'a' AND y.k <> 'a' GROUP BY x.i),
    w AS (SELECT t.*, coalesce(m.a, 0) AS na, coalesce(m.e, 0) AS ne, coalesce(m.b, 0) AS nb, coalesce(q.ae, 0) AS ae, coalesce(q.ab, 0) AS ab FROM t LEFT JOIN m USING (i) LEFT JOIN q USING (i))
    SELECT w.doc_id, length(w.text)::BIGINT AS n_chars, sha256(w.edited) AS edited_sha256,
        w.na::VARCHAR || '/' || za.cells AS fingerprint, w.ne::VARCHAR || '/' || ze.cells AS edited_fingerprint,
        CASE WHEN na + ne = 0 THEN 1.0::DOUBLE ELSE 1 - (na + ne - 2 * ae)::DOUBLE / (na + ne) END AS near_edited,
        CASE WHEN na + nb = 0 THEN 1.0::DOUBLE ELSE 1 - (na + nb - 2 * ab)::DOUBLE / (na + nb) END AS near_next
    FROM w JOIN z za ON za.i = w.i AND za.k = 'a' JOIN z ze ON ze.i = w.i AND ze.k = 'e'"""
