"""Transaction views over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


HOUR = "(l_orderkey + 5 * l_linenumber) % 24"


def txn_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered transactions with a time of day: seq, source, target, amount, datetime, label (1 fraud, 0 normal, 2 unlabeled)."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.col("user_id").alias("source"),
        F.get_json_object("props", "$.k").cast("long").alias("target"),
        F.col("value").alias("amount"),
        F.col("ts").alias("datetime"),
        F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "purchase", 0).otherwise(2).alias("label"),
    )


def txn_li(spark: SparkSession, sf_dir: str, timed: bool = False, users: DataFrame | None = None, parts: bool = True) -> DataFrame:
    """Transactions with places and merchants; dimensions are joined on their keys and the planner broadcasts what is small.

    What belongs to a buyer is joined to orders, before the lines. timed: orders have a date alone; every line gets an hour of that day by its keys.
    users: more columns of buyers by `source`. parts: whether lines meet their part (level1, level2); who groups by target joins it to the groups.
    """
    t = lambda n: table(spark, sf_dir, n)
    home = t("nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("source_province"))
    away = t("nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("transaction_province"))
    bought = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(home, "c_nationkey")
    if users is not None:
        bought = bought.join(users, F.col("o_custkey") == F.col("source")).drop("source")
    facts = t("lineitem").join(bought, F.col("l_orderkey") == F.col("o_orderkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(away, "s_nationkey")
    facts = facts.join(t("part"), F.col("l_partkey") == F.col("p_partkey")) if parts else facts
    return facts.select(
        F.col("o_custkey").alias("source"), F.col("l_partkey").alias("target"), F.col("l_extendedprice").alias("amount"), F.col("l_suppkey").alias("location"),
        F.col("o_orderpriority").alias("kind"), "source_province", "transaction_province", F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 0).otherwise(2).alias("label"),
        F.expr(f"timestampadd(HOUR, {HOUR}, o_orderdate)" if timed else "o_orderdate").alias("datetime"), *([F.col("p_type").alias("level1"), F.col("p_brand").alias("level2")] if parts else []),
        *[c for c in (users.columns if users is not None else ()) if c != "source"])


EV = """ev AS (SELECT event_id AS seq, user_id AS source, json_extract_string(props, '$.k')::BIGINT AS target, value AS amount, ts AS datetime,
    CASE event_type WHEN 'error' THEN 1 WHEN 'purchase' THEN 0 ELSE 2 END AS label FROM events)"""
LI = """li AS (SELECT o_custkey AS source, l_partkey AS target, l_extendedprice AS amount, l_suppkey AS location, o_orderpriority AS kind,
    h.n_name AS source_province, a.n_name AS transaction_province, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 0 ELSE 2 END AS label,
    o_orderdate AS datetime, p_type AS level1, p_brand AS level2
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation h ON c_nationkey = h.n_nationkey
    JOIN supplier ON l_suppkey = s_suppkey JOIN nation a ON s_nationkey = a.n_nationkey JOIN part ON l_partkey = p_partkey)"""
LI_TIMED = LI.replace("o_orderdate AS datetime", f"o_orderdate + to_hours(({HOUR})::INT) AS datetime")
