"""Transactions of any origin brought to one form: columns that are there are read, those that are not are worked out or get a default."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.views import EV, LI, table, txn_ev, txn_li
from .contracts import require_columns
from .profiles import exact_sum

one = "*"
# Parts of a day that are known; days on which thirds of a month begin and end.
PERIOD_TAGS = ("late_night", "early_morning", "commute_morning", "workday_morning", "lunch", "afternoon", "commute_evening", "night")
THIRDS = {"is_month_start": (1, 10), "is_month_middle": (11, 20), "is_month_end": (21, 31)}
#: What counts as yes in flags of transactions, and in those of contexts.
YES, NARROW_YES = ("true", "1", "yes", "y", "t"), ("true", "1", "yes")


def normalized_transactions(df: DataFrame, target: str = "target", amount: str = "amount") -> DataFrame:
    """Amounts as numbers, part of the day, weekend, thirds of the month and flag of another province, from whatever columns there are.

    Rows without target or amount go. The day comes from `date`, else `datetime`; the hour from `hour`, else `datetime`; the weekend from `is_weekend`,
    else `dayofweek` (Monday is 0), else the day. What none of them tells is "unknown", false or 0. Other columns stay as they are.
    """
    require_columns(df, [target, amount], "transactions")
    there = set(df.columns)
    first = lambda *names: next((F.col(n) for n in names if n in there), F.lit(None).cast("string"))
    day = first("date", "datetime").try_cast("timestamp")
    hour = F.col("hour").try_cast("double").cast("int") if "hour" in there else F.hour(first("datetime").try_cast("timestamp"))
    tag = F.col("period_tag") if "period_tag" in there else F.when(hour.isNotNull(), S.day_part(hour, "fallback"))
    weekend = S.to_bool(F.col("is_weekend"), YES) if "is_weekend" in there else (F.col("dayofweek").try_cast("double") if "dayofweek" in there else F.weekday(day)) >= 5
    out = {"period_tag": F.when(tag.isin(*PERIOD_TAGS), tag).otherwise("unknown"), "is_weekend": F.coalesce(weekend, F.lit(False))}
    for name, (low, high) in THIRDS.items():
        out[name] = S.to_bool(F.col(name), YES) if name in there else F.coalesce(F.dayofmonth(day).between(low, high), F.lit(False))
    away = "is_out_province_transaction"
    out[away] = S.to_bool(F.col(away), YES).cast("int") if away in there else F.lit(0)
    return df.withColumns({amount: S.money(F.col(amount).cast("string")), **out}).where(F.col(target).isNotNull() & F.col(amount).isNotNull())


def class_shares(values: DataFrame, group: str, cls: str, value: str, groups: DataFrame, classes: DataFrame) -> DataFrame:
    """(group, class, share) for every class in every group: what is absent has 0, and a group of nothing has even shares.

    groups and classes name them all; classes are a taxonomy, so a group has a row for each of them.
    """
    every = groups.select(group).distinct().join(F.broadcast(classes.select(F.collect_set(cls).alias("_all"))))  # one row
    every = every.select(group, F.explode("_all").alias(cls))
    rows = every.join(values.groupBy(group, cls).agg(exact_sum(F.col(value)).alias("share")), [group, cls], "left").na.fill(0.0, ["share"])
    return S.normalized(rows, [group], "share")


def untidy(spark: SparkSession, d: str) -> DataFrame:
    """The given events as an export might hold them: amounts with signs, hours and flags as text, some unreadable."""
    pick = lambda k, *texts: F.element_at(F.array(*[F.lit(t) for t in texts]), (F.pmod("seq", F.lit(k)) + 1).cast("int"))
    t = F.col("datetime")
    return txn_ev(spark, d).select(
        "seq", F.when(F.pmod("seq", F.lit(17)) != 0, F.col("target")).alias("target"), F.when(F.pmod("seq", F.lit(11)) == 0, "n/a").otherwise(F.concat(F.lit(" ￥"), F.col("amount").cast("decimal(18,4)").cast("string"))).alias("amount"),
        F.when(F.pmod("seq", F.lit(7)) == 0, "?").otherwise(F.hour(t).cast("string")).alias("hour"), F.weekday(t).cast("string").alias("dayofweek"),
        F.when(F.pmod("seq", F.lit(13)) != 0, F.date_format(t, "yyyy-MM-dd")).alias("date"), pick(4, "Yes", "0", " T ", "no").alias("is_month_start"), pick(3, "1", "false", "y").alias("is_out_province_transaction"))


def queries() -> dict:
    shown = ["seq", "target", "amount", "period_tag", "is_weekend", *THIRDS, "is_out_province_transaction"]
    show = lambda df: df.select(*[F.round("amount", 4).alias("amount") if c == "amount" else c for c in shown])
    ev, part_of_day = txn_ev, S.day_part_sql("hour(datetime)", "fallback")
    third = lambda low, high: f"day(datetime) BETWEEN {low} AND {high}"
    amount = "round(amount::DECIMAL(18,4)::DOUBLE, 4) AS amount"
    flags = lambda s, d: ev(s, d).select("seq", F.element_at(F.array(*[F.lit(x) for x in (" True", "0", "yes ", "Y", "n", "t")]), (F.pmod("seq", F.lit(6)) + 1).cast("int")).alias("flag"))
    most = lambda s, d: ev(s, d).groupBy("source").agg(F.max("amount").alias("most"))
    fraud = lambda s, d: txn_li(s, d).where("label = 1")
    return {
        "normalized_transactions": (lambda s, d: show(normalized_transactions(untidy(s, d))), f"WITH {EV} SELECT seq, target, {amount}, CASE WHEN seq % 7 = 0 THEN 'unknown' ELSE {part_of_day} END AS period_tag, isodow(datetime) >= 6 AS is_weekend, seq % 4 IN (0, 2) AS is_month_start, seq % 13 <> 0 AND {third(11, 20)} AS is_month_middle, seq % 13 <> 0 AND {third(21, 31)} AS is_month_end, (seq % 3 <> 1)::INT AS is_out_province_transaction FROM ev WHERE seq % 11 <> 0 AND seq % 17 <> 0"),
        "normalized_transactions_dated": (lambda s, d: show(normalized_transactions(ev(s, d).select("seq", "target", "amount", "datetime"))), f"WITH {EV} SELECT seq, target, round(amount, 4) AS amount, {part_of_day} AS period_tag, isodow(datetime) >= 6 AS is_weekend, {', '.join(f'{third(*v)} AS {k}' for k, v in THIRDS.items())}, 0 AS is_out_province_transaction FROM ev WHERE target IS NOT NULL AND amount IS NOT NULL"),
        "normalized_transactions_bare": (lambda s, d: show(normalized_transactions(ev(s, d).select("seq", "target", "amount"))), f"WITH {EV} SELECT seq, target, round(amount, 4) AS amount, 'unknown' AS period_tag, false AS is_weekend, {', '.join(f'false AS {k}' for k in THIRDS)}, 0 AS is_out_province_transaction FROM ev WHERE target IS NOT NULL AND amount IS NOT NULL"),
        "class_shares": (lambda s, d: class_shares(fraud(s, d), "source", "level1", "amount", table(s, d, "customer").select(F.col("c_custkey").alias("source")), table(s, d, "part").select(F.col("p_type").alias("level1"))).withColumn("share", F.round("share", 9)), f"WITH {LI}, e AS (SELECT c_custkey AS source, level1 FROM customer, (SELECT DISTINCT p_type AS level1 FROM part)), v AS (SELECT source, level1, sum(amount::DECIMAL(18,4))::DOUBLE AS v FROM li WHERE label = 1 GROUP BY 1, 2), r AS (SELECT e.source, e.level1, coalesce(v, 0) AS v FROM e LEFT JOIN v ON v.source = e.source AND v.level1 = e.level1) SELECT source, level1, round(CASE WHEN sum(v) OVER w > 0 THEN v / sum(v) OVER w ELSE 1.0::DOUBLE / count(*) OVER w END, 9) AS share FROM r WINDOW w AS (PARTITION BY source)"),
        "scalar_bool": (lambda s, d: flags(s, d).select("seq", S.to_bool(F.col("flag"), YES).alias("wide"), S.to_bool(F.col("flag"), NARROW_YES).alias("narrow")), f"WITH {EV} SELECT seq, seq % 6 IN (0, 2, 3, 5) AS wide, seq % 6 IN (0, 2) AS narrow FROM ev"),
        "scalar_nearly_equal": (lambda s, d: ev(s, d).join(most(s, d), "source").select("seq", S.nearly_equal(F.col("amount"), F.col("most")).alias("near_most")), f"WITH {EV} SELECT seq, abs(amount - most) <= 0.01::DOUBLE * greatest(abs(amount), abs(most), 0.000001::DOUBLE) AS near_most FROM (SELECT seq, amount, max(amount) OVER (PARTITION BY source) AS most FROM ev)"),
    }
