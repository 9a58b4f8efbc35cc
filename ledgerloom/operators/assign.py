"""Assignments that carry running totals or budgets: greedy quotas, selection under caps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

#: Rows that one task assigns in order before it hands its totals to the next.
RANGE_ROWS = 100_000
#: Quota tables are taxonomies (categories, regions): more rows than this are refused.
MOST_QUOTAS = 10_000


def cut_lineage(df: DataFrame) -> DataFrame:
    """checkpoint() into the session's shared folder, planned with the size that it has there."""
    shared_folder(df.sparkSession)
    return measured(df.checkpoint(eager=True))


def measured(kept: DataFrame) -> DataFrame:
    """A checkpoint with the bytes of its files as its size, and nothing inherited.

    checkpoint() takes over the size estimated for the plan it cuts. An estimate of a join is a product, so in a loop that joins its own checkpoints
    estimates have twice and more digits after each step, until the driver does nothing but multiply them, and what is small is never broadcast.
    """
    spark = kept.sparkSession
    jvm, rows = spark._jvm, kept._jdf.queryExecution().analyzed()
    files = spark.read.text(rows.rdd().getCheckpointFile().get())  # listed, never read
    size, none = jvm.scala.Option.apply(files._jdf.queryExecution().analyzed().stats()), jvm.scala.Option.empty()
    plan = jvm.org.apache.spark.sql.execution.LogicalRDD(rows.output(), rows.rdd(), rows.outputPartitioning(), rows.outputOrdering(), False, none, spark._jsparkSession, size, none)
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan), spark)


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; only where none is set and one machine runs all (tests) a folder is made."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """Written as columns into the shared folder and read from there: who reads it again reads the columns it needs."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def carried(rows: DataFrame, order: list[Column], fold, state: list, schema: str, most: int = RANGE_ROWS) -> DataFrame:
    """Visit all rows in one order with a state that each visit changes, as a sequential program would, without one task for all rows.

    Rows are written to the shared folder in ranges of about `most` in order; one task after the other takes a range (`fold(frame, state)` -> (rows,
    state), in pandas) and hands its state, a list of numbers, to the next by way of the driver. The result does not depend on `most`.
    """
    spark = rows.sparkSession
    folder = f"{shared_folder(spark)}/carried-{uuid.uuid4().hex}"
    parts = max(1, -(-rows.count() // most))
    placed = cut_lineage(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    held = sorted(r["_part"] for r in placed.select("_part").distinct().collect())
    placed.repartition(parts, "_part").write.partitionBy("_part").parquet(f"{folder}/in")
    names = [x.split()[0] for x in schema.split(", ")]

    def visit(state: list):
        def run(batches):
            frame = [b.to_pandas() for b in batches]
            if frame:
                out, after = fold(pd.concat(frame, ignore_index=True), list(state))
                yield pa.RecordBatch.from_pandas(out[names].assign(_state=None), schema=target, preserve_index=False)
                last = {n: [None] for n in names} | {"_state": [after]}
                yield pa.RecordBatch.from_pydict(last, schema=target)

        return run

    target = pa.schema([*to_arrow_schema(StructType.fromDDL(schema)), pa.field("_state", pa.list_(pa.float64()))])
    for part in held:
        own = spark.read.schema(rows.schema).parquet(f"{folder}/in/_part={part}").repartition(1).sortWithinPartitions(*order)
        own.mapInArrow(visit(state), schema + ", _state array<double>").write.parquet(f"{folder}/out/{part}")
        got = spark.read.parquet(f"{folder}/out/{part}").where("_state IS NOT NULL").select("_state").first()
        state = list(got["_state"]) if got else state
    if not held:
        return spark.createDataFrame([], schema)
    return spark.read.parquet(*[f"{folder}/out/{p}" for p in held]).where("_state IS NULL").drop("_state")


def greedy(amount: np.ndarray, quota_a: np.ndarray, quota_n: np.ndarray, used_a: np.ndarray, used_n: np.ndarray, w_amount: float, w_count: float) -> np.ndarray:
    """Index of the quota each row takes, rows in the given order: the largest weighted room, the first of equals. Adds to what is used."""
    out = np.empty(len(amount), dtype=np.int64)
    for i, a in enumerate(amount):
        k = int(np.argmax(w_amount * (1 - used_a / quota_a) + w_count * (1 - used_n / quota_n)))
        out[i], used_a[k], used_n[k] = k, used_a[k] + a, used_n[k] + 1
    return out


def quota_greedy(items: DataFrame, quotas: DataFrame, w_amount: float = 0.35, w_count: float = 0.65, most: int = RANGE_ROWS) -> DataFrame:
    """Give every item a category so that amounts and counts both near their quotas, biggest amount first: the sequential greedy at any size.

    items: id, amount (null counts as 0); quotas: category, amount_share, count_share. Ties go to the smaller id, equal room to the first category.
    No quota rows: category is null. Returns id, amount, category.
    """
    plan = quotas.orderBy("category").limit(MOST_QUOTAS + 1).collect()
    if len(plan) > MOST_QUOTAS:
        raise ValueError(f"more than {MOST_QUOTAS} quotas")
    items = items.select("id", F.coalesce(F.col("amount").cast("double"), F.lit(0.0)).alias("amount"))
    if not plan:
        return items.withColumn("category", F.lit(None).cast("string"))
    names = np.array([str(r["category"]) for r in plan], dtype=object)
    items = cut_lineage(items)
    total = items.agg(F.sum(F.col("amount").cast("decimal(28,6)")), F.count("*")).first()
    quota_a, quota_n = (np.maximum(np.array([float(r[c] or 0) for r in plan]) * float(t or 0), 1e-9) for c, t in (("amount_share", total[0]), ("count_share", total[1])))

    def fold(rows: pd.DataFrame, state: list) -> tuple[pd.DataFrame, list]:
        used_a, used_n = np.array(state[: len(names)]), np.array(state[len(names) :])
        chosen = greedy(rows["amount"].to_numpy(), quota_a, quota_n, used_a, used_n, w_amount, w_count)
        return rows[["id", "amount"]].assign(category=names[chosen]), [*used_a, *used_n]

    kind = items.schema["id"].dataType.simpleString()
    return carried(items, [F.desc("amount"), F.col("id")], fold, [0.0] * 2 * len(names), f"id {kind}, amount double, category string", most)


def select_with_caps(proposals: DataFrame, caps: dict[str, Column], order: list[Column] | None = None, parts: int | None = None, few: int = 50_000) -> DataFrame:
    """What a program takes that visits proposals (id, gain, group columns) in order and takes each whose groups all have room: exactly that set.

    caps: group column -> cap of a row's group (a column of the proposals; null is a group as well). order: best gain first, then the smaller id.
    A row is decided once its place among the undecided rows before it fits the room of every group: whatever becomes of those, it is taken; as room
    is kept for them, a full group has only rows behind the ones it took, and these are out. The best row left always fits, so passes end.
    Places in a group are counted over ranges of the order, so no task holds a group. Once at most `few` rows are undecided one task walks them, in
    batches, with the room that is left.
    """
    spark, groups, columns, schema = proposals.sparkSession, list(caps), proposals.columns, proposals.schema
    order = order or [F.desc("gain"), F.col("id")]
    parts = parts or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = proposals.select("*", *[cap.alias(f"_cap_{c}") for c, cap in caps.items()])
    left = cut_lineage(rows.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))
    taken = None

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        used: dict = {}
        for b in batches:
            keep = []
            for i, (keys, room) in enumerate(zip(b[groups].astype(object).where(b[groups].notna(), None).itertuples(index=False, name=None), b[[f"_cap_{c}" for c in groups]].to_numpy(), strict=True)):
                held = list(enumerate(keys))
                if all(used.get(k, 0) < most for k, most in zip(held, room, strict=True)):
                    keep.append(i)
                    for k in held:
                        used[k] = used.get(k, 0) + 1
            yield b.iloc[keep][columns]

    while True:
        if left.count() <= few:
            new = cut_lineage(left.drop("_range").repartition(1).sortWithinPartitions(*order).mapInPandas(walk, schema))
            return new if taken is None else taken.union(new)
        fits, ranked = F.lit(True), left
        for c in caps:
            held = left.groupBy(F.col("_range").alias("_r"), F.col(c).alias("_g")).agg(F.count("*").alias("_k"))
            before = Window.partitionBy("_g").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
            held = held.select("_r", "_g", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias(f"_before_{c}"))
            place = F.row_number().over(Window.partitionBy("_range", c).orderBy(*order))
            ranked = ranked.withColumn(f"_place_{c}", place).join(held, (F.col("_range") == F.col("_r")) & F.col(c).eqNullSafe(F.col("_g"))).drop("_r", "_g")
            fits = fits & (F.col(f"_before_{c}") + F.col(f"_place_{c}") <= F.col(f"_cap_{c}"))
        ranked = cut_lineage(ranked.withColumn("_fits", fits).select(*left.columns, "_fits"))
        new = ranked.where("_fits").select(*proposals.columns)
        taken = new if taken is None else taken.union(new)
        left = ranked.where("not _fits").drop("_fits")
        for c in caps:  # what the pass took leaves less room
            used = ranked.where("_fits").groupBy(F.col(c).alias("_g")).agg(F.count("*").alias("_used"))
            left = left.join(used, F.col(c).eqNullSafe(F.col("_g")), "left").withColumn(f"_cap_{c}", F.col(f"_cap_{c}") - F.coalesce("_used", F.lit(0))).drop("_used", "_g").where(F.col(f"_cap_{c}") > 0)
        left = cut_lineage(left)
