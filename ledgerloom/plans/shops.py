"""Features, relative ranks and first categories of merchants, and how well merchants and categories fit their priors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from ..sources.views import EV, table, txn_ev
from .profiles import average_rank, exact_sum, level_of
from .time import calendar, calendar_sql

W = Window.partitionBy
one = "*"
# Thresholds of plain features, and the measures that are ranked inside a category.
OBVIOUS, MONTH, WEEKEND, WORKDAY = 0.35, 0.45, 0.40, 0.25
MEASURES = ("mean", "n", "total", "commute", "dining", "night_share", "work", "active_periods", "weekend", "month_start", "month_middle", "month_end", "month_cycle", "out_share")
#: Level1 of each category of the given merchants and the word of its rule: kinds are checked in this order.
KINDS = ("dining", "commute", "online", "monthly", "retail")
# Words of categories that carry more risk.
RISKY = ("Brand#1", "Brand#2")


def features(spark: SparkSession, d: str) -> DataFrame:
    """A row a merchant: sizes, shares of day parts, of weekends and parts of the month, and the plain flags made of them."""
    merchants = table(spark, d, "part").select(F.col("p_partkey").alias("target"), F.col("p_type").alias("level1"), F.col("p_brand").alias("level2"))
    share = lambda *p: F.avg(F.col("period_tag").isin(*p).cast("int"))
    flag = lambda c: F.avg(F.col(c).cast("int"))
    g = calendar(txn_ev(spark, d)).groupBy("target").agg(
        F.count(one).alias("n"), exact_sum(F.col("amount")).alias("total"), (exact_sum(F.col("amount")) / F.count("amount")).alias("mean"), *[share(p).alias(f"p_{p}") for p in S.PARTS],
        flag("is_weekend").alias("weekend"), flag("is_month_start").alias("month_start"), flag("is_month_middle").alias("month_middle"), flag("is_month_end").alias("month_end"), F.avg((F.pmod("seq", F.lit(4)) == 0).cast("int")).alias("out_share"))
    part = lambda *p: sum((F.col(f"p_{x}") for x in p[1:]), F.col(f"p_{p[0]}"))
    most = F.greatest(*[F.col(f"p_{p}") for p in S.PARTS])
    active = sum(((F.col(f"p_{p}") >= 0.1).cast("int") for p in S.PARTS[1:]), (F.col(f"p_{S.PARTS[0]}") >= 0.1).cast("int"))
    g = g.withColumns({"commute": part("commute_morning", "commute_evening"), "dining": part("lunch", "night", "late_night"), "night_share": part("night", "late_night"), "work": part("workday_morning", "afternoon"), "max_period": most, "active_periods": active, "month_cycle": F.greatest("month_start", "month_middle", "month_end")})
    g = g.withColumns({"is_commute": F.col("commute") >= OBVIOUS, "is_dining": F.col("dining") >= OBVIOUS, "is_night": F.col("night_share") >= OBVIOUS, "is_work": F.col("work") >= OBVIOUS, "is_weekend_enhanced": F.col("weekend") >= WEEKEND, "is_workday": F.col("weekend") <= WORKDAY,
        "is_month_cycle": F.col("month_cycle") >= MONTH, "is_distributed": (F.col("max_period") <= MONTH) & (F.col("active_periods") >= 3), "online_tendency": S.online_tendency(F.col("out_share"))})
    return merchants.join(g, "target").drop(*[f"p_{p}" for p in S.PARTS])


FEATURES = (
    "ft AS (SELECT target, count(*) AS n, sum(amount::DECIMAL(18,4))::DOUBLE AS total, sum(amount::DECIMAL(18,4))::DOUBLE / count(amount) AS mean, " + ", ".join(f"avg((period_tag = '{p}')::INT) AS p_{p}" for p in S.PARTS) + ", avg(is_weekend::INT) AS weekend, avg(is_month_start::INT) AS month_start, avg(is_month_middle::INT) AS month_middle, avg(is_month_end::INT) AS month_end, avg((seq % 4 = 0)::INT) AS out_share FROM cal GROUP BY 1),"
    " fu AS (SELECT *, p_commute_morning + p_commute_evening AS commute, p_lunch + p_night + p_late_night AS dining, p_night + p_late_night AS night_share, p_workday_morning + p_afternoon AS work, greatest(" + ", ".join(f"p_{p}" for p in S.PARTS) + ") AS max_period, (" + " + ".join(f"(p_{p} >= 0.1)::INT" for p in S.PARTS) + ")::INT AS active_periods, greatest(month_start, month_middle, month_end) AS month_cycle FROM ft),"
    f" fe AS (SELECT target, p_type AS level1, p_brand AS level2, n, total, mean, weekend, month_start, month_middle, month_end, out_share, commute, dining, night_share, work, max_period, active_periods, month_cycle, commute >= {OBVIOUS} AS is_commute, dining >= {OBVIOUS} AS is_dining, night_share >= {OBVIOUS} AS is_night, work >= {OBVIOUS} AS is_work, weekend >= {WEEKEND} AS is_weekend_enhanced, weekend <= {WORKDAY} AS is_workday,"
    f" month_cycle >= {MONTH} AS is_month_cycle, max_period <= {MONTH} AND active_periods >= 3 AS is_distributed, CASE WHEN out_share >= 0.45 THEN 'strong_online' WHEN out_share >= 0.15 THEN 'mixed_online_offline' ELSE 'strong_offline' END AS online_tendency FROM fu JOIN part ON p_partkey = target)"
)


def ranked(rows: DataFrame) -> DataFrame:
    """Percent ranks of all measures inside level1, and their levels; rounded shares keep ties."""
    rows = rows.withColumns({m: F.round(m, 9) for m in MEASURES if m not in ("n", "active_periods")})
    rows = rows.withColumns({f"{m}_rank": average_rank("level1", m) for m in MEASURES})
    return rows.withColumns({f"{m}_level": level_of(f"{m}_rank") for m in MEASURES})


RANKED = "fr AS (SELECT * REPLACE (" + ", ".join(f"round({m}, 9) AS {m}" for m in MEASURES if m not in ("n", "active_periods")) + ") FROM fe), rk AS (SELECT *, " + ", ".join(f"CASE WHEN count(*) OVER (PARTITION BY level1) = 1 THEN 0.5 ELSE (rank() OVER (PARTITION BY level1 ORDER BY {m}) + (count(*) OVER (PARTITION BY level1, {m}) - 1) / 2) / count(*) OVER (PARTITION BY level1) END AS {m}_rank" for m in MEASURES) + " FROM fr), rl AS (SELECT *, " + ", ".join(f"CASE WHEN {m}_rank >= 0.67 THEN 'high' WHEN {m}_rank <= 0.33 THEN 'low' ELSE 'medium' END AS {m}_level" for m in MEASURES) + " FROM rk)"


def category_online(rows: DataFrame) -> Column:
    """Online tendency against the category: sure shares first, then a high rank with some share."""
    return F.when(F.col("out_share") >= 0.6, "strong_online").when((F.col("out_share") >= 0.2) | ((F.col("out_share_level") == "high") & (F.col("out_share") >= 0.08)), "mixed_online_offline").otherwise("strong_offline")


def rule_kind(rows: DataFrame) -> DataFrame:
    """A first kind by the first rule that holds, of the ranks inside the category."""
    high = lambda m: F.col(f"{m}_level") == "high"
    rules = [high("dining") & (F.col("mean_level") != "low"), high("commute"), category_online(rows) != "strong_offline", high("month_cycle") & (F.col("mean_level") != "high")]
    out = F.lit(KINDS[-1])
    for name, rule in reversed(list(zip(KINDS, rules, strict=False))):
        out = F.when(rule, name).otherwise(out)
    return rows.select("target", "level1", category_online(rows).alias("online"), out.alias("kind"))


# How much each rank speaks for a kind.
COEFFICIENTS = {"dining": {"dining": 0.6, "mean": 0.2, "night_share": 0.2}, "commute": {"commute": 0.7, "n": 0.3}, "online": {"out_share": 0.8, "active_periods": 0.2}, "monthly": {"month_cycle": 0.7, "mean": -0.2}, "retail": {"n": 0.4, "active_periods": 0.3, "mean": -0.1}}


def kind_scores(rows: DataFrame) -> DataFrame:
    """(target, kind, score): sums of ranks times coefficients, a row a kind."""
    score = lambda c: sum((F.lit(float(w)) * F.col(f"{m}_rank") for m, w in list(c.items())[1:]), F.lit(float(next(iter(c.values())))) * F.col(f"{next(iter(c))}_rank"))
    return rows.select("target", "level1", F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), (F.round(score(c), 9) + 0.0).alias("score")) for k, c in COEFFICIENTS.items()])))


SCORES = "sk AS (" + " UNION ALL ".join(f"SELECT target, level1, '{k}' AS kind, round({' + '.join(f'({w}::DOUBLE * {m}_rank)' for m, w in c.items())}, 9) + 0.0 AS score FROM rl" for k, c in COEFFICIENTS.items()) + ")"


def level2_draw(dim: DataFrame) -> DataFrame:
    """A level2 drawn evenly among those of the merchant's level1, by a keyed uniform."""
    of = dim.groupBy("level1").agg(F.array_sort(F.collect_set("level2")).alias("_of"))  # taxonomy
    at = F.floor(S.keyed_uniform("level2", F.col("target")) * F.size("_of")).cast("int")
    return dim.join(F.broadcast(of), "level1").select("target", "level1", F.get("_of", at).alias("drawn"))


def risk_score(online: Column, amount: Column, volatility: Column, name: Column) -> Column:
    """How risky a category's prior makes it, 0 to 1."""
    by = lambda x, high, medium: F.when(x == "high", high).when(x == "medium", medium).otherwise(0.0)
    word = F.lit(False)
    for r in RISKY:
        word = word | name.contains(r)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.18 + 0.22 * online + by(amount, 0.13, 0.06) + by(volatility, 0.10, 0.04) + F.when(word, 0.32).otherwise(0.0)))


def priors(rows: DataFrame) -> DataFrame:
    """Per level2 of a level1: mean online share, label of the mean amount and of its spread, from its merchants."""
    g = rows.groupBy("level1", "level2").agg(F.avg("out_share").alias("online"), F.avg("mean").alias("_m"), F.coalesce(F.stddev_samp("mean"), F.lit(0.0)).alias("_s"))
    return g.select("level1", "level2", F.round("online", 9).alias("online"), S.amount_label(F.col("_m")).alias("amount"), S.cv_label(S.safe_div(F.col("_s"), F.col("_m"))).alias("volatility"))


PRIORS = """pg AS (SELECT level1, level2, round(avg(out_share), 9) AS online, avg(mean) AS m, coalesce(stddev_samp(mean), 0) AS s FROM fe GROUP BY 1, 2),
    pq AS (SELECT level1, level2, online, CASE WHEN m < 20 THEN 'low' WHEN m < 100 THEN 'low_to_medium' WHEN m < 500 THEN 'medium' ELSE 'high' END AS amount, CASE WHEN coalesce(s / nullif(m, 0), 0) < 0.5 THEN 'low' WHEN coalesce(s / nullif(m, 0), 0) < 1 THEN 'low_to_medium' WHEN coalesce(s / nullif(m, 0), 0) < 2 THEN 'medium' ELSE 'high' END AS volatility FROM pg)"""


def fit(rows: DataFrame, prior: DataFrame) -> DataFrame:
    """Errors of each merchant against its level2's prior, their weighted fit, and how many are large (`residual_dims`)."""
    p = prior.select("level1", "level2", F.col("online").alias("_o"), F.col("amount").alias("_a"), F.col("volatility").alias("_v"))
    r = rows.join(F.broadcast(p), ["level1", "level2"])  # taxonomy
    label, online = S.amount_label(F.col("mean")), F.abs(F.round("out_share", 9) - F.col("_o"))
    gap = S.label_distance(label, F.col("_a"))
    r = r.select("target", "level1", "level2", F.round(online, 9).alias("online_error"), gap.alias("amount_error"), F.round(F.abs(F.col("dining") - 0.375), 9).alias("hour_error"), S.label_distance(F.col("_v"), F.lit("low")).alias("volatility_error"))
    r = r.withColumn("fit", F.round(1 - (0.18 * F.col("online_error") + 0.18 * F.col("amount_error") + 0.14 * F.col("volatility_error") + 0.14 * F.col("hour_error")) / 0.64, 9))
    dims = (F.col("online_error") >= 0.45).cast("int") + (F.col("amount_error") >= 0.6).cast("int") + (F.col("volatility_error") >= 0.6).cast("int") + (F.col("hour_error") >= 0.333).cast("int")
    return r.withColumn("residual_dims", dims).withColumn("is_residual", (F.col("residual_dims") >= 1) | (F.col("fit") <= 0.65))


FIT = """ff AS (SELECT target, fe.level1, fe.level2, round(abs(round(out_share, 9) - online), 9) AS online_error, CASE WHEN mean < 20 THEN 1 WHEN mean < 100 THEN 2 WHEN mean < 500 THEN 3 ELSE 4 END AS la, list_position(['low', 'low_to_medium', 'medium', 'high'], amount) AS pa, list_position(['low', 'low_to_medium', 'medium', 'high'], volatility) AS pv, round(abs(dining - 0.375), 9) AS hour_error FROM fe JOIN pq ON pq.level1 = fe.level1 AND pq.level2 = fe.level2),
    fg AS (SELECT target, level1, level2, online_error, abs(la - pa) / 3.0::DOUBLE AS amount_error, hour_error, abs(pv - 1) / 3.0::DOUBLE AS volatility_error FROM ff), fh AS (SELECT *, round(1 - (0.18::DOUBLE * online_error + 0.18::DOUBLE * amount_error + 0.14::DOUBLE * volatility_error + 0.14::DOUBLE * hour_error) / 0.64::DOUBLE, 9) AS fit, (online_error >= 0.45)::INT + (amount_error >= 0.6)::INT + (volatility_error >= 0.6)::INT + (hour_error >= 0.333)::INT AS residual_dims FROM fg)"""


def queries() -> dict:
    head = f"WITH {EV}, cal AS ({calendar_sql()}), {FEATURES}"
    cols = ["target", "level1", *[f"{m}_rank" for m in MEASURES], *[f"{m}_level" for m in MEASURES]]
    online = "CASE WHEN out_share >= 0.6 THEN 'strong_online' WHEN out_share >= 0.2 OR (out_share_level = 'high' AND out_share >= 0.08) THEN 'mixed_online_offline' ELSE 'strong_offline' END"
    risk = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.18::DOUBLE + 0.22::DOUBLE * online + CASE amount WHEN 'high' THEN 0.13 WHEN 'medium' THEN 0.06 ELSE 0 END::DOUBLE + CASE volatility WHEN 'high' THEN 0.10 WHEN 'medium' THEN 0.04 ELSE 0 END::DOUBLE + CASE WHEN " + " OR ".join(f"contains(level2, '{r}')" for r in RISKY) + " THEN 0.32 ELSE 0 END::DOUBLE))"
    dim = lambda s, d: table(s, d, "part").select(F.col("p_partkey").alias("target"), F.col("p_type").alias("level1"), F.col("p_brand").alias("level2"))
    return {
        "rule_features": (features, f"{head} SELECT * FROM fe"),
        "measure_ranks": (lambda s, d: ranked(features(s, d)).select(*cols), f"{head}, {RANKED} SELECT {', '.join(cols)} FROM rl"),
        "level1_rules": (lambda s, d: rule_kind(ranked(features(s, d))), f"{head}, {RANKED} SELECT target, level1, {online} AS online, CASE WHEN dining_level = 'high' AND mean_level <> 'low' THEN 'dining' WHEN commute_level = 'high' THEN 'commute' WHEN {online} <> 'strong_offline' THEN 'online' WHEN month_cycle_level = 'high' AND mean_level <> 'high' THEN 'monthly' ELSE 'retail' END AS kind FROM rl"),
        "level1_scores": (lambda s, d: kind_scores(ranked(features(s, d))), f"{head}, {RANKED}, {SCORES} SELECT * FROM sk"),
        "best_candidate": (lambda s, d: kind_scores(ranked(features(s, d))).groupBy("target").agg(F.min_by(F.struct("kind", "score"), F.struct(-F.col("score"), F.col("kind"))).alias("b")).select("target", "b.kind", "b.score"), f"{head}, {RANKED}, {SCORES} SELECT target, kind, score FROM sk QUALIFY row_number() OVER (PARTITION BY target ORDER BY score DESC, kind) = 1"),
        "level2_draw": (lambda s, d: level2_draw(dim(s, d)), "WITH o AS (SELECT p_type, list_sort(list_distinct(list(p_brand))) AS l FROM part GROUP BY 1) SELECT p_partkey AS target, part.p_type AS level1, l[(floor(('0x' || substr(md5(p_partkey::VARCHAR || '|level2'), 1, 8))::BIGINT / 4294967296.0::DOUBLE * len(l)) + 1)::INT] AS drawn FROM part JOIN o ON o.p_type = part.p_type"),
        "category_prior_rows": (lambda s, d: priors(features(s, d)).withColumn("bucket", S.online_bucket(F.col("online"))), f"{head}, {PRIORS} SELECT *, CASE WHEN online >= 0.75 THEN 'strong_online' WHEN online >= 0.55 THEN 'mixed_online' WHEN online >= 0.35 THEN 'mixed_offline' ELSE 'strong_offline' END AS bucket FROM pq"),
        "risk_score": (lambda s, d: priors(features(s, d)).select("level1", "level2", F.round(risk_score(F.col("online"), F.col("amount"), F.col("volatility"), F.col("level2")), 9).alias("risk")), f"{head}, {PRIORS} SELECT level1, level2, round({risk}, 9) AS risk FROM pq"),
        "fit_score": (lambda s, d: fit(f := features(s, d), priors(f)).drop("is_residual", "residual_dims"), f"{head}, {PRIORS}, {FIT} SELECT target, level1, level2, online_error, amount_error, hour_error, volatility_error, fit FROM fh"),
        "residual_dims": (lambda s, d: fit(f := features(s, d), priors(f)).select("target", "residual_dims", "is_residual"), f"{head}, {PRIORS}, {FIT} SELECT target, residual_dims, residual_dims >= 1 OR fit <= 0.65 AS is_residual FROM fh"),
        "online_alignment_by_category": (lambda s, d: fit(f := features(s, d), priors(f)).groupBy("level1").agg(F.count(one).alias("merchants"), F.round(F.avg("online_error"), 9).alias("online_error"), F.round(F.avg("fit"), 9).alias("fit"), F.count_if("is_residual").alias("residual")), f"{head}, {PRIORS}, {FIT} SELECT level1, count(*) AS merchants, round(avg(online_error), 9) AS online_error, round(avg(fit), 9) AS fit, count(*) FILTER (residual_dims >= 1 OR fit <= 0.65) AS residual FROM fh GROUP BY 1"),
    }
