"""Numbers and running values in one order over a whole table, with no task that holds it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .assign import cut_lineage


def in_ranges(df: DataFrame, order: list[str], parts: int | None = None) -> DataFrame:
    """`_range`: rows dealt by ranges of `order`, so that range i lies before range i + 1. Checkpointed: where ranges end is sampled, and must not
    be sampled again by a task that is repeated."""
    parts = parts or 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))


def _before(ranged: DataFrame, value: Column, out: str, how) -> DataFrame:
    """One row a range, with the value of all ranges before it: a window over as many rows as there are ranges."""
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    each = ranged.groupBy("_range").agg(value.alias("_v"))
    return F.broadcast(each.select("_range", how(F.col("_v")).over(earlier).alias(out)))


def global_rank(df: DataFrame, order: list[str], out: str = "rank", parts: int | None = None) -> DataFrame:
    """Number all rows from 1 by `order` (columns; ties are broken at will, so let it be total)."""
    ranged = in_ranges(df, order, parts)
    first = _before(ranged, F.count("*"), "_first", F.sum)
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_i", inside).join(first, "_range").withColumn(out, F.coalesce("_first", F.lit(0)) + F.col("_i")).drop("_range", "_i", "_first")


def running_max(df: DataFrame, order: list[str], value: str, out: str, parts: int | None = None) -> DataFrame:
    """The largest `value` of a row and all rows before it by `order`."""
    ranged = in_ranges(df, order, parts)
    first = _before(ranged, F.max(value), "_first", F.max)
    inside = F.max(value).over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn("_m", inside).join(first, "_range").withColumn(out, F.greatest("_m", "_first")).drop("_range", "_m", "_first")


def neighbours(df: DataFrame, order: list[str], value: str, before: str, after: str, parts: int | None = None) -> DataFrame:
    """The `value` of the row before and behind each row by `order` (null at the ends); a range asks the nearest range that has rows."""
    ranged = in_ranges(df, order, parts)
    inside = Window.partitionBy("_range").orderBy(*order)
    key = F.struct(*order)
    ends = ranged.groupBy("_range").agg(F.min_by(value, key).alias("_f"), F.max_by(value, key).alias("_l"))
    line = Window.orderBy("_range")
    ends = F.broadcast(ends.select("_range", F.lag("_l").over(line).alias("_b"), F.lead("_f").over(line).alias("_a")))
    rows = ranged.withColumns({before: F.lag(value).over(inside), after: F.lead(value).over(inside), "_i": F.row_number().over(inside), "_n": F.count("*").over(Window.partitionBy("_range"))})
    return rows.join(ends, "_range").withColumns({before: F.when(F.col("_i") == 1, F.col("_b")).otherwise(F.col(before)), after: F.when(F.col("_i") == F.col("_n"), F.col("_a")).otherwise(F.col(after))}).drop("_range", "_i", "_n", "_a", "_b")


def average_ranks(rows: DataFrame, key: str, group: str, measures: list[str], suffix: str = "_rank", parts: int | None = None) -> DataFrame:
    """(key, a percent rank a measure): average ties inside each group, 0.5 where a group has one row or a measure is null.

    All measures of all groups are counted by value and laid in one order over ranges; a value's rank is what lies before it in its range plus the
    counts of the ranges before. No task sorts a group, however many rows it has.
    """
    each = F.inline(F.array(*[F.struct(F.lit(i).alias("_m"), F.col(m).cast("double").alias("_v")) for i, m in enumerate(measures)]))
    long = rows.select(key, group, each).where("_v IS NOT NULL")
    ranged = in_ranges(long.groupBy(group, "_m", "_v").agg(F.count("*").alias("_k")), [group, "_m", "_v"], parts)
    same = Window.partitionBy(group, "_m")
    held = ranged.groupBy("_range", group, "_m").agg(F.sum("_k").alias("_s"))
    held = held.select("_range", group, "_m", F.coalesce(F.sum("_s").over(same.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"), F.sum("_s").over(same).alias("_t"))
    inside = F.sum("_k").over(Window.partitionBy("_range", group, "_m").orderBy("_v"))
    rank = F.when(F.col("_t") == 1, 0.5).otherwise((F.col("_b") + F.col("_i") - F.col("_k") + (F.col("_k") + 1) / 2) / F.col("_t"))
    placed = ranged.withColumn("_i", inside).join(held, ["_range", group, "_m"]).select(group, "_m", "_v", rank.alias("_r"))
    found = long.join(placed, [group, "_m", "_v"]).groupBy(key).agg(*[F.max(F.when(F.col("_m") == i, F.col("_r"))).alias(f"{m}{suffix}") for i, m in enumerate(measures)])
    return rows.select(key).join(found, key, "left").na.fill(0.5)


def running_sums(df: DataFrame, group: str, order: list[str], values: dict[str, Column], parts: int | None = None) -> DataFrame:
    """For each of `values` (whole numbers), its sum over the rows of the group up to and with this one by `order`: summed inside ranges of (group,
    order), plus what the group's earlier ranges hold. A group with most rows lies in many ranges."""
    ranged = in_ranges(df.withColumns({f"_f_{c}": x.cast("long") for c, x in values.items()}), [group, *order], parts)
    earlier = Window.partitionBy("_g").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    held = ranged.groupBy(F.col("_range").alias("_r"), F.col(group).alias("_g")).agg(*[F.sum(f"_f_{c}").alias(f"_s_{c}") for c in values])
    held = held.select("_r", "_g", *[F.coalesce(F.sum(f"_s_{c}").over(earlier), F.lit(0)).alias(f"_b_{c}") for c in values])
    inside = Window.partitionBy("_range", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = ranged.withColumns({c: F.sum(f"_f_{c}").over(inside) for c in values}).join(held, (F.col("_range") == F.col("_r")) & F.col(group).eqNullSafe(F.col("_g")))
    return rows.withColumns({c: F.col(c) + F.col(f"_b_{c}") for c in values}).select(*df.columns, *values)


def running_counts(df: DataFrame, group: str, order: list[str], flags: dict[str, Column], parts: int | None = None) -> DataFrame:
    """For each flag, how many rows of the group up to and with this one by `order` have it."""
    return running_sums(df, group, order, {c: F.coalesce(x, F.lit(False)) for c, x in flags.items()}, parts)


def shortest_prefix(moves: DataFrame, counts: DataFrame, bounds: DataFrame, order: list[str], costs: dict[str, Callable[[Column], Column]], parts: int | None = None) -> DataFrame:
    """Of each scope the fewest first moves by `order` after which every cost is within its bound; all moves where no prefix is.

    moves: scope, leaves, joins: one row goes from one value of its scope to another. counts: scope, value, k (rows that have it now), and what
    costs read; a row for every value. costs: name -> cost of a value that `k` rows have, a whole number; a scope's cost is the sum over its values.
    bounds: scope and a column a cost. Scopes and values are not null, `order` is total.
    A move changes the counts of two values and with them two costs, so costs after each move are running sums of running sums over ranges: no move
    is tried, and no task holds a scope.
    """
    placed = cut_lineage(running_sums(moves, "scope", order, {"_place": F.lit(1)}, parts))
    both = F.inline(F.array(*[F.struct(F.col(c).alias("value"), F.lit(d).alias("_d")) for c, d in (("leaves", -1), ("joins", 1))]))
    events = placed.where("leaves <> joins").select("scope", "_place", both).withColumn("_key", F.struct("scope", "value"))
    events = running_sums(events, "_key", ["_place"], {"_sum": F.col("_d")}, parts).join(counts, ["scope", "value"])
    after = F.col("k") + F.col("_sum")
    steps = events.groupBy("scope", "_place").agg(*[F.sum(cost(after) - cost(after - F.col("_d"))).alias(f"_by_{c}") for c, cost in costs.items()])
    start = counts.groupBy("scope").agg(*[F.sum(cost(F.col("k"))).alias(f"_at_{c}") for c, cost in costs.items()]).join(bounds, "scope")
    within = lambda gone: reduce(and_, [F.col(f"_at_{c}") + (F.col(f"_to_{c}") if gone else 0) <= F.col(c) for c in costs])
    gone = running_sums(steps, "scope", ["_place"], {f"_to_{c}": F.col(f"_by_{c}") for c in costs}, parts).join(start, "scope")
    first = start.where(within(False)).select("scope", F.lit(0).cast("long").alias("_first")).unionByName(gone.where(within(True)).select("scope", F.col("_place").alias("_first")))
    first = first.groupBy("scope").agg(F.min("_first").alias("_first"))
    return placed.join(first, "scope", "left").where("_first IS NULL OR _place <= _first").select(*moves.columns)
