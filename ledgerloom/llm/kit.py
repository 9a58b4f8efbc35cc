"""Shared Spark idioms of the corpus operators: reads, lineage cuts, exact distributed cuts and ranks."""

from __future__ import annotations

import json
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A word: a run of characters other than space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def word_count(text: Column) -> Column:
    """Words of a text; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; only where none is set and one machine runs all (tests) a folder is made."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """checkpoint() into the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def small_batches(spark: SparkSession) -> None:
    """Hand Python rows by 4 MB instead of the default 64 MB, unless the session has a limit of its own: that memory is taken in the
    JVM and in Python for each task at once. Holds for the session from here on; results do not depend on it."""
    key, default = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
    if spark.conf.get(key, None) == default:
        spark.conf.set(key, "4m")


def spread(df: DataFrame) -> int:
    """Number of tasks that a repartition by key should make: the session's shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows from the driver as a table, without a Python task."""
    names = [x.split()[0] for x in schema.split(", ")]
    kind = ", ".join(x.replace(" ", ": ", 1) for x in schema.split(", "))
    data = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(data), f"array<struct<{kind}>>")))


def gapless_rank(df: DataFrame, group: list[str], order: list[str], out: str, rows_a_part: int = 20_000) -> DataFrame:
    """Number the rows of each group from 0 without gaps, with no task holding a whole group.

    Rows of a group are dealt into hashed parts; the parts' counts give each part its first number, and only a part is
    sorted by one task. The number of parts grows with the table, so a group with a third of all rows is split as well.
    """
    parts = max(64, df.count() // rows_a_part)
    dealt = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = dealt.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n")).select(*group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    keys = [F.col(f"d.{c}").eqNullSafe(F.col(f"f.{c}")) for c in (*group, "_part")]
    joined = dealt.alias("d").join(first.alias("f"), keys, "left").select("d.*", "f._first")
    inside = Window.partitionBy(*group, "_part").orderBy(*order)
    return joined.withColumn(out, (F.col("_first") + F.row_number().over(inside) - 1).cast("long")).drop("_first", "_part")


def weighted_cut(df: DataFrame, targets: dict[int, float], bits: int, budget: int = 1 << 16) -> dict[int, int]:
    """For each group the key up to which the rows' weights come nearest to a target, exactly.

    df: _group int, _key long in [0, 2**bits), _weight long. Each round sums weights by the next bits of the key inside
    the one bucket that holds the cut, so the driver sees at most `budget` sums a round whatever the number of rows.
    Returns the largest key to take (-1: none). Rows of equal keys are taken or left together.
    """
    spark = df.sparkSession
    cut = {g: -1 for g, t in targets.items() if t <= 0}
    #: group -> (first key of the bucket, its bits still open, weight before it)
    open_ = {g: (0, bits, 0) for g in targets if g not in cut}
    while open_:
        step = max(1, min(12, (budget // len(open_)).bit_length() - 1))
        state = small_table(spark, [(g, lo, max(0, left - step), left) for g, (lo, left, _) in open_.items()], "_group int, _lo long, _shift int, _left int")
        inside = df.join(F.broadcast(state), "_group").where(F.expr("shiftright(_key, _left) = shiftright(_lo, _left)"))
        sums: dict[int, list] = {}
        for r in inside.groupBy("_group", F.expr("shiftright(_key, _shift)").alias("_b")).agg(F.sum("_weight").alias("w"), F.min("_key").alias("a"), F.max("_key").alias("z")).collect():
            sums.setdefault(r["_group"], []).append((r["_b"], r["w"], r["a"], r["z"]))
        after = {}
        for g, (_, left, before) in open_.items():
            shift, last = max(0, left - step), None
            for b, w, a, z in sorted(sums.get(g, ())):
                if before + w >= targets[g]:
                    last = (b, w, a, z)
                    break
                before += w
                cut[g] = z
            if last is None:
                cut.setdefault(g, -1)
            elif last[2] == last[3]:  # one key is left: take it if that comes nearer
                cut[g] = last[2] if before + last[1] - targets[g] <= targets[g] - before else last[2] - 1
            else:
                after[g] = (last[0] << shift, shift, before)
        open_ = after
    return cut
