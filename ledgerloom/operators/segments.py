"""Cutting one ordered table into blocks, each beginning where the last one ends, with no task that holds a run."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .assign import cut_lineage
from .order import in_ranges

#: Rows of a range, and most ranges: a table of `size` numbers a range comes to the driver.
RANGE_ROWS, MOST_RANGES = 100_000, 4_096


def look_ahead(ranged: DataFrame, order: str, fields: list[str], size: int) -> DataFrame:
    """`_look`: of each row itself and the rows behind it, `size` in all, whatever ranges they lie in."""
    inside = Window.partitionBy("_range").orderBy(order)
    struct = F.struct(*fields)
    heads = ranged.withColumn("_i", F.row_number().over(inside)).where(F.col("_i") < size).groupBy("_range").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", struct.alias("s")))), lambda x: x["s"]).alias("_h"))
    behind = Window.orderBy("_range").rowsBetween(1, size - 1)  # a row a range
    tails = heads.select("_range", F.slice(F.flatten(F.collect_list("_h").over(behind)), 1, size - 1).alias("_tail"))
    own = F.collect_list(struct).over(inside.rowsBetween(0, size - 1))
    return ranged.withColumn("_own", own).join(F.broadcast(tails), "_range").withColumn("_look", F.slice(F.concat("_own", "_tail"), 1, size)).drop("_own", "_tail")


def prefix(look: str, holds: Callable[[Column], Column]) -> Column:
    """How many elements from the first on hold."""
    fails = F.array_position(F.transform(look, lambda x: F.coalesce(holds(x), F.lit(False))), False)
    return F.when(fails == 0, F.size(look)).otherwise(fails - 1).cast("int")


def _walk(rows: pd.DataFrame, size: int, order: str) -> pd.DataFrame:
    """Where blocks that enter the range at each of its first `size` places leave it, and the last block that begins in it."""
    n = rows["_n"].to_numpy()
    exits, last = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
    for i in range(len(n) - 1, -1, -1):
        j = i + n[i]
        exits[i], last[i] = (j - len(n), i) if j >= len(n) else (exits[j], last[j])
    within = np.arange(min(size, len(n)))
    beyond = np.arange(len(within), size) - len(n)
    ends = last[within]
    pad = [None] * len(beyond)
    one = {"_range": rows["_range"].iloc[0], "rows": len(n), "exits": [*exits[within], *beyond], "last": [*rows[order].to_numpy()[ends], *pad], "gone": [*(len(n) - ends), *pad], "n": [*n[ends], *pad], "kind": [*rows["_kind"].to_numpy()[ends], *pad]}
    return pd.DataFrame([one])


def segments(df: DataFrame, order: str, fields: list[str], size: int, rule: Callable[[str], tuple[Column, Column]], parts: int | None = None) -> DataFrame:
    """Every row with its block: the first begins at the first row by `order` (unique whole numbers), each other one right behind the last.

    rule: column of the next `size` rows (structs of `fields`, the row itself first) -> (rows of a block that begins here, its kind). As a block is at
    most `size` rows, what a range does to a block that enters it at each of `size` places is a small function; ranges find theirs side by side, the functions are
    composed in order, and ranges mark their blocks side by side. A run of any length may cross any number of ranges.
    Returns order, block (order of its first row), k (place in it, from 0), n, kind.
    """
    parts = parts or min(MOST_RANGES, max(2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // RANGE_ROWS)))
    ahead = look_ahead(in_ranges(df.select(order, *[f for f in fields if f != order]), [order], parts), order, fields, size)
    n, kind = rule("_look")
    slim = ahead.select("_range", order, n.cast("int").alias("_n"), kind.alias("_kind"))
    key = df.schema[order].dataType.simpleString()
    table = slim.groupBy("_range").applyInPandas(lambda rows: _walk(rows.sort_values(order), size, order), f"_range int, rows long, exits array<int>, last array<{key}>, gone array<long>, n array<int>, kind array<string>")
    entry, carried, begin = 0, (None, 0, 0, None), {}
    for r in sorted(table.collect(), key=lambda r: r["_range"]):
        begin[r["_range"]] = (entry, *carried)
        if r["last"][entry] is None:
            carried = (carried[0], carried[1] + r["rows"], *carried[2:])
        else:
            carried = (r["last"][entry], r["gone"][entry], r["n"][entry], r["kind"][entry])
        entry = r["exits"][entry]
    sent = df.sparkSession.sparkContext.broadcast(begin)  # at most MOST_RANGES rows

    def mark(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        i, block, gone, many, what = sent.value[int(rows["_range"].iloc[0])]
        ids, lengths, kinds = (rows[c].to_numpy() for c in (order, "_n", "_kind"))
        first = min(i, len(ids))
        out = [(ids[j], block, gone + j, many, what) for j in range(first)]
        while i < len(ids):
            out += [(ids[j], ids[i], j - i, lengths[i], kinds[i]) for j in range(i, min(i + lengths[i], len(ids)))]
            i += lengths[i]
        return pd.DataFrame(out, columns=[order, "block", "k", "n", "kind"])

    return cut_lineage(slim.groupBy("_range").applyInPandas(mark, f"{order} {key}, block {key}, k int, n int, kind string"))
