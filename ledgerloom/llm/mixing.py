"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kit import cut_lineage, small_table, weighted_cut, word_count

KEY_BITS = 60


def fair_targets(sizes: dict[str | None, int], weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> dict[str | None, tuple[int, int]]:
    """Each source's target as an exact fraction (numerator, denominator).

    Sources in code point order, null last, weigh `weights` in turn and share all words; a target stops at `most` times
    its source's words and the excess is shared anew by weight among the others, until none is above.
    """
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-8")))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full: set[str | None] = set()
    while True:
        rest = sum(sizes.values()) - sum(most * sizes[s] for s in full)
        shares = sum(weight[s] for s in order if s not in full)
        over = {s for s in order if s not in full and rest * weight[s] > most * sizes[s] * shares}
        if not over:
            return {s: (most * sizes[s], 1) if s in full else (rest * weight[s], max(1, shares)) for s in order}
        full |= over


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: str = "mix") -> DataFrame:
    """How many words of each document a mix of the sources takes.

    A source whose target is t times its words gives every document floor(t) whole times. What is left of the target is
    a Pareto order sample: each document has a random u from a keyed hash and an inclusion probability p = f * (n + 1) /
    (n + 8) for n words (f: the fraction of t), which favours articles over fragments; documents are ranked by
    (u / (1 - u)) / (p / (1 - p)) and taken in that order while the sum of words comes nearer to the target. The order is
    a pure function of doc_id, so reruns agree. The cut is found by `weighted_cut`: no window over a whole source.

    Collected by the driver: one word sum a source (a registry of sources, not of documents).
    Defined cases: null text is empty, size 0, and is never taken; a null source is a source of its own; rows of one
    doc_id and source share their random number and go together; no rows give no rows; other columns are ignored.
    Returns doc_id, source, size, source_size, target, copies, taken.
    """
    sized = cut_lineage(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    spark = docs.sparkSession
    sizes = {r["source"]: r["n"] for r in sized.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    goals = fair_targets(sizes, weights, most)
    rows, rest = [], {}
    for i, (s, (num, den)) in enumerate(goals.items()):
        whole = num // (den * sizes[s]) if sizes[s] else 0
        left = num - whole * den * sizes[s]  # over den
        rest[i] = left / den
        rows.append((i, s, sizes[s], num / den, whole, left / (den * sizes[s]) if sizes[s] else 0.0))
    plan = F.broadcast(small_table(spark, rows, "_group int, source string, source_size long, target double, _whole long, _f double"))
    u = (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col("doc_id").cast("string"))), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    p = F.col("_f") * (F.col("size") + 1) / (F.col("size") + 8)
    odds = F.try_divide(u / (1 - u), p / (1 - p))
    joined = sized.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source"))).select("d.*", "p._group", "p.source_size", "p.target", "p._whole", "p._f")
    ranked = joined.withColumn("_key", F.when(F.col("_f") > 0, F.floor(odds / (1 + odds) * float(1 << KEY_BITS))).cast("long"))
    cut = weighted_cut(ranked.where("_key is not null and size > 0").select("_group", "_key", F.col("size").alias("_weight")), {g: t for g, t in rest.items() if t > 0}, KEY_BITS + 1)
    cuts = F.broadcast(small_table(spark, list(cut.items()), "_group int, _cut long"))
    once_more = F.coalesce((F.col("_key") <= F.col("_cut")).cast("long"), F.lit(0))
    out = ranked.join(cuts, "_group", "left").withColumn("copies", F.when(F.col("size") > 0, F.col("_whole") + once_more).otherwise(0).cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix_sql(weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: str = "mix") -> str:
    """The same for DuckDB, with windows over whole sources."""
    weigh = "CASE " + " ".join(f"WHEN i % {len(weights)} = {k} THEN {w}" for k, w in enumerate(weights)) + " END"
    return f"""
    WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
    s AS (SELECT *, {weigh} AS w FROM (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS i FROM d GROUP BY source)),
    o AS (SELECT *, sum(source_size) OVER ()::BIGINT AS total, coalesce(sum({most} * source_size) OVER f, 0)::BIGINT AS capped, (sum(w) OVER () - coalesce(sum(w) OVER f, 0))::BIGINT AS open
        FROM s WINDOW f AS (ORDER BY {most} * source_size::DOUBLE / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    r AS (SELECT total - capped AS rest, open FROM o WHERE (total - capped) * w <= {most} * source_size * open ORDER BY {most} * source_size::DOUBLE / w, i LIMIT 1),
    t AS (SELECT source, source_size, CASE WHEN rest * w > {most} * source_size * open THEN {most} * source_size ELSE rest * w END AS num,
        CASE WHEN rest * w > {most} * source_size * open THEN 1 ELSE open END AS den FROM s, r),
    g AS (SELECT *, CASE WHEN source_size > 0 THEN num // (den * source_size) ELSE 0 END AS whole FROM t),
    h AS (SELECT *, num - whole * den * source_size AS rest FROM g),
    q AS (SELECT d.*, h.source_size, num::DOUBLE / den AS target, whole, rest::DOUBLE / den AS goal, CASE WHEN h.source_size > 0 THEN rest::DOUBLE / (den * h.source_size) ELSE 0 END AS f,
        (('0x' || substr(md5('{seed}|' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT::DOUBLE + 0.5) / {1 << 48}::DOUBLE AS u
        FROM d JOIN h ON d.source IS NOT DISTINCT FROM h.source),
    p AS (SELECT *, f * (size + 1) / (size + 8) AS p FROM q),
    k AS (SELECT *, CASE WHEN f > 0 AND size > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS odds FROM p),
    z AS (SELECT *, floor(odds / (1 + odds) * {1 << KEY_BITS}::DOUBLE) AS key FROM k),
    c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key) AS upto, sum(size) OVER (PARTITION BY source, key) AS own FROM z WHERE key IS NOT NULL),
    m AS (SELECT doc_id, size, source_size, target, size * (whole + (upto - goal <= goal - (upto - own))::INT)::BIGINT AS taken FROM c
        UNION ALL SELECT doc_id, size, source_size, target, size * whole FROM z WHERE key IS NULL)
    SELECT doc_id, size, source_size, target, taken::BIGINT AS taken FROM m"""
