"""Allocation to quotas, merchant proposals and their selection under budgets, blocks of fraud runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from ..operators.assign import select_with_caps
from ..operators.balance import quota_shards
from ..sources.views import EV, LI, txn_ev, txn_li
from .clock import ROWS_SQL, block_rows
from .profiles import effective_amount, exact_sum, merchant_profile

W = Window.partitionBy
one = "*"


def category_quotas(df: DataFrame) -> DataFrame:
    """Share of amounts and of merchants that each level1 has in the facts."""
    g = df.groupBy(F.col("level1").alias("category")).agg(F.sum("amount").alias("a"), F.count_distinct("target").alias("n"))
    return g.select("category", (F.col("a") / F.sum("a").over(W(F.lit(0)))).alias("amount_share"), (F.col("n") / F.sum("n").over(W(F.lit(0)))).alias("count_share"))


def category_allocation(df: DataFrame) -> DataFrame:
    items = effective_amount(merchant_profile(df)).select(F.col("target").alias("id"), F.col("effective_total_amount").alias("amount"))
    return quota_shards(items, category_quotas(df), 0.35, 0.65).withColumnRenamed("id", "target")


def allocation_report(df: DataFrame) -> DataFrame:
    got = category_allocation(df).groupBy("category").agg(F.sum("amount").alias("amount"), F.count(one).alias("merchants"))
    got = got.select("category", (F.col("amount") / F.sum("amount").over(W(F.lit(0)))).alias("amount_got"), (F.col("merchants") / F.sum("merchants").over(W(F.lit(0)))).alias("count_got"))
    both = category_quotas(df).join(got, "category", "left").na.fill(0.0)
    return both.select("*", (F.col("amount_got") - F.col("amount_share")).alias("amount_gap"), (F.col("count_got") - F.col("count_share")).alias("count_gap"))


def merchants(df: DataFrame) -> DataFrame:
    """A row each merchant: its levels, size and labels of amount (against its level1's quartiles of means) and of spread."""
    m = df.groupBy("level1", "level2", "target").agg(F.count(one).alias("n"), (exact_sum(F.col("amount")) / F.count("amount")).alias("mean"), F.coalesce(F.stddev_samp("amount"), F.lit(0.0)).alias("std"))
    q = m.groupBy("level1").agg(*[F.percentile("mean", x).alias(f"q{int(x * 100)}") for x in (0.25, 0.5, 0.75)])
    return m.join(q, "level1").select("level1", "level2", "target", "n", "mean", S.amount_label(F.col("mean"), F.col("q25"), F.col("q50"), F.col("q75")).alias("amount_label"), S.cv_label(S.safe_div(F.col("std"), F.col("mean"))).alias("cv_label"))


def level2_priors(df: DataFrame) -> DataFrame:
    """Per level2 of a level1: weight (share of merchants) and the commonest labels, ties to the first by name."""
    m = merchants(df)
    top = lambda c: m.groupBy("level1", "level2", c).agg(F.count(one).alias("k")).groupBy("level1", "level2").agg(F.min_by(c, F.struct(-F.col("k"), F.col(c))).alias(c))
    share = m.groupBy("level1", "level2").agg(F.count(one).alias("k")).withColumn("weight", F.col("k") / F.sum("k").over(W("level1"))).drop("k")
    return share.join(top("amount_label"), ["level1", "level2"]).join(top("cv_label"), ["level1", "level2"])


def merchant_scores(df: DataFrame) -> DataFrame:
    """Score of every level2 of a merchant's level1; a taxonomy's level1 holds few level2, so rows are merchants times few."""
    p = level2_priors(df).select("level1", F.col("level2").alias("candidate"), "weight", F.col("amount_label").alias("_a"), F.col("cv_label").alias("_v"))
    fit = 0.8 * (1 - S.label_distance(F.col("amount_label"), F.col("_a"))) + 0.3 * (1 - S.label_distance(F.col("cv_label"), F.col("_v")))
    return merchants(df).join(p, "level1").select("level1", "target", "level2", "n", "candidate", (0.35 * F.log("weight") + F.when(F.col("n") >= 5, fit).otherwise(0.0)).alias("score"))


def merchant_proposals(df: DataFrame, penalty: float = 0.03) -> DataFrame:
    """The best other level2 of a merchant where it gains more than the penalty; equal scores to the first by name."""
    s = merchant_scores(df)
    best = s.groupBy("level1", "target", "level2").agg(F.min_by(F.struct("candidate", "score"), F.struct(-F.round("score", 9), F.col("candidate"))).alias("b"), F.max(F.when(F.col("candidate") == F.col("level2"), F.col("score"))).alias("now"))
    return best.select("level1", "target", F.col("level2").alias("old"), F.col("b.candidate").alias("new"), F.round(F.col("b.score") - F.col("now") - penalty, 9).alias("gain")).where("new <> old AND gain > 0")


def merchant_selected(df: DataFrame) -> DataFrame:
    """Proposals kept under budgets: a fifth of a level1's merchants, and 12 % of them into or out of one level2."""
    size = df.groupBy("level1").agg(F.count_distinct("target").alias("_n"))
    p = merchant_proposals(df).join(size, "level1").withColumn("id", F.col("target")).withColumn("into", F.concat_ws("\x1f", "level1", "new")).withColumn("out_of", F.concat_ws("\x1f", "level1", "old"))
    flow = F.ceil(F.col("_n") * 0.12)
    return select_with_caps(p, {"level1": F.ceil(F.col("_n") * 0.2), "into": flow, "out_of": flow}).select("level1", "target", "old", "new", "gain")


def structure_state(df: DataFrame) -> DataFrame:
    """Per level1: its level2 in use, the largest share of one, and the limits of both."""
    g = df.select("level1", "level2", "target").distinct().groupBy("level1", "level2").agg(F.count(one).alias("k"))
    g = g.groupBy("level1").agg(F.count(one).alias("active"), (F.max("k") / F.sum("k")).alias("max_share"))
    return g.select("*", F.greatest(F.lit(0.65), 1 / F.col("active") + 0.2).alias("share_limit"), F.ceil(F.col("active") * 0.6).alias("least_active"))


def soft_weights(df: DataFrame) -> DataFrame:
    """Weight of a province among users against an even target: 1 + 0.6 times its relative gap, within 0.25 and 4."""
    g = df.select("source", "source_province").distinct().groupBy(F.col("source_province").alias("value")).agg(F.count(one).alias("k"))
    g = g.select("value", (F.col("k") / F.sum("k").over(W(F.lit(0)))).alias("share"), (1 / F.count(one).over(W(F.lit(0)))).alias("target"))
    return g.select("*", F.greatest(F.lit(0.25), F.least(F.lit(4.0), 1 + 0.6 * (F.col("target") - F.col("share")) / F.col("target"))).alias("weight"))


def fraud_blocks(df: DataFrame) -> DataFrame:
    """A row for each block of fraud rows in the order of all transactions, with the number of its users."""
    return block_rows(df).where("kind <> 'normal'").groupBy(F.col("block").alias("first_seq")).agg(F.max("seq").alias("last_seq"), F.count(one).alias("rows"), F.count_distinct("source").alias("users"), F.first("kind").alias("kind"))


M_SQL = """m0 AS (SELECT level1, level2, target, count(*) AS n, avg(amount) AS mean, coalesce(stddev_samp(amount), 0) AS std FROM li GROUP BY 1, 2, 3),
    mq AS (SELECT level1, quantile_cont(mean, 0.25) AS a, quantile_cont(mean, 0.5) AS b, quantile_cont(mean, 0.75) AS c FROM m0 GROUP BY 1),
    m AS (SELECT level1, level2, target, n, mean, CASE WHEN mean < a THEN 1 WHEN mean < b THEN 2 WHEN mean < c THEN 3 ELSE 4 END AS al, CASE WHEN v < 0.5 THEN 1 WHEN v < 1 THEN 2 WHEN v < 2 THEN 3 ELSE 4 END AS cl
        FROM (SELECT *, coalesce(std / nullif(mean, 0), 0) AS v FROM m0) JOIN mq USING (level1)),
    nm AS (SELECT unnest([1, 2, 3, 4]) AS i, unnest(['low', 'low_to_medium', 'medium', 'high']) AS s)"""
TOP_SQL = "SELECT level1, level2, i FROM (SELECT level1, level2, {c} AS i, count(*) AS k FROM m GROUP BY 1, 2, 3) JOIN nm USING (i) QUALIFY row_number() OVER (PARTITION BY level1, level2 ORDER BY k DESC, s) = 1"
P_SQL = f"""pa AS ({TOP_SQL.format(c="al")}), pv AS ({TOP_SQL.format(c="cl")}),
    p AS (SELECT w.level1, w.level2, weight, pa.i AS a, pv.i AS v FROM (SELECT level1, level2, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY level1) AS weight FROM m GROUP BY 1, 2) w
        JOIN pa ON pa.level1 = w.level1 AND pa.level2 = w.level2 JOIN pv ON pv.level1 = w.level1 AND pv.level2 = w.level2)"""
S_SQL = """s AS (SELECT m.level1, target, m.level2, n, p.level2 AS candidate, 0.35::DOUBLE * ln(weight) + CASE WHEN n >= 5 THEN 0.8::DOUBLE * (1 - abs(al - a) / 3.0::DOUBLE) + 0.3::DOUBLE * (1 - abs(cl - v) / 3.0::DOUBLE) ELSE 0 END AS score
    FROM m JOIN p ON m.level1 = p.level1)"""

MP_SQL = """mb AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY target ORDER BY round(score, 9) DESC, candidate) = 1),
    mp AS (SELECT mb.level1, mb.target, mb.level2 AS old, mb.candidate AS new, round(mb.score - c.score - 0.03::DOUBLE, 9) AS gain FROM mb JOIN s c ON c.target = mb.target AND c.candidate = c.level2 WHERE mb.candidate <> mb.level2 AND round(mb.score - c.score - 0.03::DOUBLE, 9) > 0)"""


def queries() -> dict:
    li, ev = txn_li, txn_ev
    quotas = "q AS (SELECT level1 AS category, sum(amount) / sum(sum(amount)) OVER () AS amount_share, count(DISTINCT target)::DOUBLE / sum(count(DISTINCT target)) OVER () AS count_share FROM li GROUP BY 1)"
    return {
        "category_quotas": (lambda s, d: category_quotas(li(s, d)), f"WITH {LI}, {quotas} SELECT * FROM q"),
        "category_allocation": (lambda s, d: category_allocation(li(s, d)), None),
        "allocation_report": (lambda s, d: allocation_report(li(s, d)), None),
        "level2_priors": (lambda s, d: level2_priors(li(s, d)), f"WITH {LI}, {M_SQL}, {P_SQL} SELECT level1, level2, weight, x.s AS amount_label, y.s AS cv_label FROM p JOIN nm x ON x.i = a JOIN nm y ON y.i = v"),
        "merchant_proposals": (lambda s, d: merchant_proposals(li(s, d)), f"WITH {LI}, {M_SQL}, {P_SQL}, {S_SQL}, {MP_SQL} SELECT * FROM mp"),
        "merchant_selected": (lambda s, d: merchant_selected(li(s, d)), None),
        "structure_state": (lambda s, d: structure_state(li(s, d)), f"WITH {LI}, g AS (SELECT level1, level2, count(DISTINCT target) AS k FROM li GROUP BY 1, 2) SELECT level1, count(*) AS active, max(k)::DOUBLE / sum(k) AS max_share, greatest(0.65::DOUBLE, 1.0::DOUBLE / count(*) + 0.2::DOUBLE) AS share_limit, ceil(count(*) * 0.6::DOUBLE)::BIGINT AS least_active FROM g GROUP BY 1"),
        "soft_weights": (lambda s, d: soft_weights(li(s, d)), f"WITH {LI}, g AS (SELECT source_province AS value, count(DISTINCT source)::DOUBLE / sum(count(DISTINCT source)) OVER () AS share, 1.0::DOUBLE / count(*) OVER () AS target FROM li GROUP BY 1) SELECT *, greatest(0.25::DOUBLE, least(4.0::DOUBLE, 1 + 0.6::DOUBLE * (target - share) / target)) AS weight FROM g"),
        "ffsd_blocks_fraud": (lambda s, d: fraud_blocks(ev(s, d)), f"WITH RECURSIVE {EV}, {ROWS_SQL} SELECT block AS first_seq, max(seq) AS last_seq, count(*) AS rows, count(DISTINCT source) AS users, any_value(kind) AS kind FROM br WHERE kind <> 'normal' GROUP BY block"),
    }
