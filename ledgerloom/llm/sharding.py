"""Sharding by a k-d tree over document metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .kit import cut_lineage, gapless_rank, small_table, weighted_cut

COORD_BITS, TIE_BITS = 20, 32
DIMENSIONS = ("_source", "_lang", "_size")


def shard_documents(docs: DataFrame, shards: int = 40, pieces_a_shard: int = 8) -> DataFrame:
    """Put every row into one of `shards` shards of nearly equal bytes.

    A k-d tree splits the corpus at weighted medians (weighted quantiles, where the leaves below are of odd number) along
    the dimension of source, language and size that is the widest in the cell: that whose ranks by weight, a scale that all three
    share, spread the most (by variance); a cell is a leaf when its bytes
    have reached total / shards. Split keys are found exactly by `weighted_cut`, with sums on the driver only. What moves
    is a group of equal texts, placed by the least source and language among its rows, so copies share a shard; a group
    over 1/`pieces_a_shard` of a shard is dealt by doc_id into pieces of about that size, so no hot group unbalances it.

    Defined cases: a null text weighs 16 bytes and equals the empty text; null lang or source is a value of its own;
    repeated rows are rows of their own, with slots of their own; an empty table gives no rows; other columns are ignored.
    Returns doc_id, size, text_crc32, law, shard, slot (0.. in each shard), grown_shard (null: the law is `bytes`).
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = cut_lineage(docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("_hash"),
        F.coalesce("lang", F.lit("\0")).alias("_l"),
        F.coalesce("source", F.lit("\0")).alias("_s"),
    ))
    group = ["_hash", "text_crc32", "size"]
    total = slim.agg(F.sum("size")).first()[0] or 0
    cap = max(1, total // (shards * pieces_a_shard))
    groups = slim.groupBy(*group).agg(F.sum("size").alias("_w"), F.min("_s").alias("_s"), F.min("_l").alias("_l"))
    # Groups over a cap of total / (shards * pieces): there are at most shards * pieces of them, hence the broadcast.
    hot = groups.where(F.col("_w") > cap).select(*group, F.ceil(F.col("_w") / cap).cast("int").alias("_pieces"))
    placed = slim.join(F.broadcast(hot), group, "left").withColumn("_piece", F.when(F.col("_pieces").isNotNull(), F.pmod(F.xxhash64("doc_id"), "_pieces")).otherwise(0).cast("int")).drop("_pieces")
    places = placed.groupBy(*group, "_piece").agg(F.sum("size").alias("_weight")).join(groups.select(*group, "_s", "_l"), group)
    cells = ranked_cells(places)
    quota = {0: shards}
    while max(quota.values()) > 1:
        cells, quota = split(cells, quota)
    leaf = {g: i for i, g in enumerate(sorted(quota))}
    number = small_table(cells.sparkSession, list(leaf.items()), "_group int, shard int")
    by_place = cells.join(F.broadcast(number), "_group").select(*group, "_piece", "shard")
    out = placed.join(by_place, [*group, "_piece"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard")
    out = gapless_rank(out, ["shard"], ["doc_id", "text_crc32"], "slot")
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def ranked_cells(places: DataFrame) -> DataFrame:
    """Places with a coordinate in each dimension: the share of all bytes before the middle of its bucket, of 2**COORD_BITS.

    Buckets are 65,536 hashes of source and of language (a source keeps to one bucket) and steps of a logarithm of size, so the tables of ranks
    that are broadcast are as small whatever the corpus.
    """
    code = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 16)).cast("int")
    bucket = {"_source": code("_s"), "_lang": code("_l"), "_size": F.least(F.lit((1 << 16) - 1), F.floor(F.log2(F.col("size")) * 1024)).cast("int")}
    cells = cut_lineage(places.select("_hash", "text_crc32", "size", "_piece", "_weight", *[v.alias(f"_b{k}") for k, v in bucket.items()], F.pmod(F.xxhash64("_hash", "_piece", F.lit(7)), F.lit(1 << TIE_BITS)).alias("_tie"), F.lit(0).alias("_group")))
    each = cells.select("_weight", F.inline(F.array(*[F.struct(F.lit(k).alias("_d"), F.col(f"_b{k}").alias("_b")) for k in DIMENSIONS]))).groupBy("_d", "_b").agg(F.sum("_weight").alias("w"))
    before = F.coalesce(F.sum("w").over(Window.partitionBy("_d").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = F.floor((before + F.col("w") / 2) / F.sum("w").over(Window.partitionBy("_d")) * ((1 << COORD_BITS) - 1)).cast("long")
    ranks = cut_lineage(each.select("_d", "_b", rank.alias("_x")))
    for k in DIMENSIONS:
        cells = cells.join(F.broadcast(ranks.where(F.col("_d") == k).select(F.col("_b").alias(f"_b{k}"), F.col("_x").alias(k))), f"_b{k}").drop(f"_b{k}")
    return cut_lineage(cells)


def split(cells: DataFrame, quota: dict[int, int]) -> tuple[DataFrame, dict[int, int]]:
    """One level of the tree: cells of more than one shard become two."""
    wide = {g: q for g, q in quota.items() if q > 1}
    # Exact sums, so that reruns choose the same axis: w, w x and w x x of each dimension.
    moments = [F.sum((F.col("_weight").cast("decimal(20,0)") * F.col(c) * (F.col(c) if p else 1)).cast("decimal(38,0)")).alias(f"{c}{p}") for c in DIMENSIONS for p in (0, 1)]
    stats = {r["_group"]: r for r in cells.groupBy("_group").agg(F.sum("_weight").alias("w"), *moments).collect()}
    width = lambda r, c: int(r["w"]) * int(r[f"{c}1"]) - int(r[f"{c}0"]) ** 2
    axis = {g: max(DIMENSIONS, key=lambda c: width(stats[g], c)) if g in stats else DIMENSIONS[0] for g in wide}
    spark = cells.sparkSession
    plan = small_table(spark, [(g, DIMENSIONS.index(axis[g])) for g in wide], "_group int, _axis int")
    coord = F.element_at(F.array(*DIMENSIONS), F.col("_axis") + 1)
    keyed = cells.join(F.broadcast(plan), "_group", "left").withColumn("_key", F.shiftleft(coord, TIE_BITS) + F.col("_tie")).drop("_axis")
    goal = {g: stats[g]["w"] * (q // 2) / q if g in stats else 0.0 for g, q in wide.items()}
    cut = weighted_cut(keyed.select("_group", "_key", "_weight").where("_key is not null"), goal, COORD_BITS + TIE_BITS)
    rule = small_table(spark, [(g, cut[g]) for g in wide], "_group int, _cut long")
    # Children of cell g are 2g + 1 and 2g + 2; a leaf keeps its number.
    child = F.when(F.col("_cut").isNull(), F.col("_group")).when(F.col("_key") <= F.col("_cut"), F.col("_group") * 2 + 1).otherwise(F.col("_group") * 2 + 2)
    cells = cut_lineage(keyed.join(F.broadcast(rule), "_group", "left").withColumn("_group", child.cast("int")).drop("_key", "_cut"))
    after = {g: q for g, q in quota.items() if q == 1} | {c: n for g, q in wide.items() for c, n in ((2 * g + 1, q // 2), (2 * g + 2, q - q // 2))}
    return cells, after
