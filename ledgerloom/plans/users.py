"""User proposals, swaps and their selection; priors, seeds, summaries and errors of provinces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.assign import cut_lineage, stored
from ..sources.views import LI, table, txn_li
from .profiles import province_names, sums_to_probs, visitor_sums
from .refine import soft_weights

W = Window.partitionBy
one = "*"
#: Candidate values a user may take; more than these are less likely by their merchants.
MOST_CANDIDATES = 8


def user_sums(df: DataFrame, values: list[str]) -> DataFrame:
    """A row a user with all that its proposals need, kept: transactions are read once."""
    return stored(visitor_sums(df, values))


def user_proposals(sums: DataFrame, values: list[str]) -> DataFrame:
    """The best other province of a user of three merchants or more, where it gains: 3 times the probability by the user's merchants and
    half the log of the province's weight. Candidates are the 8 likeliest, equal ones by name; equal scores go to the first by name. sums: `user_sums`."""
    p = sums_to_probs(sums.where("m >= 3"), values, "old").withColumn("prob", F.round("prob", 9))
    weights = soft_weights(sums.select("source", F.col("old").alias("source_province"))).select("value", "weight")
    scored = p.join(F.broadcast(weights), "value").withColumn("_s", F.round(0.5 * F.log("weight") + 3 * F.col("prob"), 9))
    own = F.col("value") == F.col("old")
    ranked = scored.withColumn("_r", F.row_number().over(W("source").orderBy(F.desc("prob"), "value"))).where((F.col("_r") <= MOST_CANDIDATES) | own)
    best = ranked.groupBy("source", "old").agg(F.min_by(F.struct("value", "_s"), F.struct(-F.col("_s"), F.col("value"))).alias("b"), F.max(F.when(own, F.col("_s"))).alias("_now"))
    return best.select("source", "old", F.col("b.value").alias("new"), F.round(F.col("b._s") - F.col("_now"), 9).alias("gain")).where("new <> old AND gain > 0")


def user_swaps(proposals: DataFrame) -> DataFrame:
    """The i-th best user that would go from one value to another, with the i-th best that would go back: totals of values stay."""
    ranked = proposals.withColumn("rank", F.row_number().over(W("old", "new").orderBy(F.desc("gain"), "source")))
    back = ranked.select(F.col("source").alias("back_source"), F.col("old").alias("new"), F.col("new").alias("old"), "rank", F.col("gain").alias("_g"))
    return ranked.where("old < new").join(back, ["old", "new", "rank"]).select("source", "back_source", "old", "new", "rank", F.round(F.col("gain") + F.col("_g"), 9).alias("gain"))


def user_selected(sums: DataFrame, values: list[str]) -> DataFrame:
    """Members of swaps, then single changes by gain, at most a fifth of a value's users leaving it. The budget is kept by rank within the old value, so
    that no window holds all proposals; a swap one half of which falls outside its budget is dropped with the other."""
    p = cut_lineage(user_proposals(sums, values))
    s = user_swaps(p)
    paired = s.select(F.explode(F.array("source", "back_source")).alias("source"), F.least("source", "back_source").alias("_pair")).withColumn("kind", F.lit("swap"))
    budget = sums.groupBy("old").agg(F.ceil(F.count(one) * 0.2).alias("_cap"))
    rows = p.join(paired, "source", "left").withColumn("kind", F.coalesce("kind", F.lit("single"))).join(budget, "old")
    rows = rows.withColumn("_r", F.row_number().over(W("old").orderBy(F.desc("kind"), F.desc("gain"), "source"))).where("_r <= _cap")
    whole = (F.col("kind") == "single") | (F.count(one).over(W("kind", F.coalesce("_pair", "source"))) == 2)
    return rows.withColumn("_whole", whole).where("_whole").select("source", "old", "new", "gain", "kind")


def seed_provinces(df: DataFrame, spark, d: str, seeds: int = 25) -> DataFrame:
    """The i-th largest place (by users, amount, name) takes the i-th most populous province; only the first `seeds` of both are ranked."""
    places = df.groupBy("location").agg(F.count_distinct("source").alias("users"), F.sum(F.col("amount").cast("decimal(18,4)")).alias("_a")).orderBy(F.desc("users"), F.desc("_a"), "location").limit(seeds)
    people = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("province")).agg(F.count(one).alias("population")).orderBy(F.desc("population"), "province").limit(seeds)
    first = places.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("users"), F.desc("_a"), "location"))).drop("_a")
    return first.join(people.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("population"), "province"))), "rank")


def activity_prior(spark, d: str) -> DataFrame:
    """Share of people times share of spending of each province, made to sum to one."""
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("province"))
    spent = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("_o"))
    g = c.join(spent, "c_custkey", "left").groupBy("province").agg(F.count(one).alias("people"), F.coalesce(F.sum("_o").cast("double"), F.lit(0.0)).alias("spending"))
    share = lambda x: F.col(x) / F.sum(x).over(W(F.lit(0)))
    both = g.withColumn("_p", share("people") * share("spending"))
    return both.select("province", "people", "spending", share("_p").alias("prior"))


def weight_summary(weights: DataFrame, most: int = 5) -> DataFrame:
    """The values weighted up and down the most."""
    sides = weights.where("weight <> 1").withColumn("side", F.when(F.col("weight") > 1, "up").otherwise("down"))
    order = W("side").orderBy(F.desc(F.round(F.abs(F.col("weight") - 1), 9)), "value")
    return sides.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("side", "rank", "value", "weight")


def constraint_errors(df: DataFrame) -> DataFrame:
    """Total variation distance of users by province, and of each level1's merchants by level2, from even shares."""

    def error(pairs: DataFrame, field: str, *group: str) -> DataFrame:
        g = pairs.groupBy(*group, "value").agg(F.count(one).alias("k")).groupBy(*group).agg(F.collect_list("k").alias("ks"))  # a value each: taxonomies are small
        total = F.aggregate("ks", F.lit(0).cast("long"), lambda a, x: a + x)
        gap = F.aggregate("ks", F.lit(0.0), lambda a, x: a + F.abs(x / total - 1 / F.size("ks")))
        return g.select(F.lit(field).alias("field"), F.col(group[0]).alias("part") if group else F.lit("").alias("part"), (gap / 2).alias("tvd"))

    users = error(df.select("source", F.col("source_province").alias("value")).distinct(), "province")
    return users.unionByName(error(df.select("level1", F.col("level2").alias("value"), "target").distinct(), "level2", "level1"))


P_SQL = """w AS (SELECT source, target, count(*) AS n FROM li GROUP BY 1, 2), a AS (SELECT target, source_province AS value, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY target) AS p FROM li GROUP BY 1, 2),
    c AS (SELECT source, value, sum(n * p) AS s FROM w JOIN a USING (target) GROUP BY 1, 2), cp AS (SELECT source, value, round(s / sum(s) OVER (PARTITION BY source), 9) AS prob FROM c),
    sw0 AS (SELECT source_province AS value, count(DISTINCT source)::DOUBLE / sum(count(DISTINCT source)) OVER () AS share, 1.0::DOUBLE / count(*) OVER () AS target FROM li GROUP BY 1),
    sw AS (SELECT value, greatest(0.25::DOUBLE, least(4.0::DOUBLE, 1 + 0.6::DOUBLE * (target - share) / target)) AS weight FROM sw0),
    u AS (SELECT source, source_province AS old FROM li GROUP BY 1, 2 HAVING count(DISTINCT target) >= 3),
    sc AS (SELECT source, old, value, round(0.5::DOUBLE * ln(weight) + 3 * prob, 9) AS s FROM u JOIN cp USING (source) JOIN sw USING (value) QUALIFY row_number() OVER (PARTITION BY source ORDER BY prob DESC, value) <= 8 OR value = old),
    b AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY source ORDER BY s DESC, value) = 1),
    up AS (SELECT b.source, b.old, b.value AS new, round(b.s - o.s, 9) AS gain FROM b JOIN sc o ON o.source = b.source AND o.value = b.old WHERE b.value <> b.old AND round(b.s - o.s, 9) > 0),
    ur AS (SELECT *, row_number() OVER (PARTITION BY old, new ORDER BY gain DESC, source) AS rank FROM up),
    us AS (SELECT x.source, y.source AS back_source, x.old, x.new, x.rank, round(x.gain + y.gain, 9) AS gain FROM ur x JOIN ur y ON x.old = y.new AND x.new = y.old AND x.rank = y.rank WHERE x.old < x.new)"""


def queries() -> dict:
    li = txn_li
    known = lambda s, d: (user_sums(li(s, d), v := province_names(s, d)), v)
    return {
        "user_proposals": (lambda s, d: user_proposals(*known(s, d)), f"WITH {LI}, {P_SQL} SELECT * FROM up"),
        "user_swaps": (lambda s, d: user_swaps(user_proposals(*known(s, d))), f"WITH {LI}, {P_SQL} SELECT * FROM us"),
        "user_selected": (lambda s, d: user_selected(*known(s, d)), f"""WITH {LI}, {P_SQL}, pa AS (SELECT source, least(source, back_source) AS pair FROM us UNION ALL SELECT back_source, least(source, back_source) FROM us), k AS (SELECT up.*, pair, CASE WHEN pair IS NULL THEN 'single' ELSE 'swap' END AS kind FROM up LEFT JOIN pa USING (source)),
            cap AS (SELECT source_province AS old, ceil(count(DISTINCT source) * 0.2::DOUBLE) AS cap FROM li GROUP BY 1), sel AS (SELECT source, k.old, new, gain, kind, pair FROM k JOIN cap ON cap.old = k.old QUALIFY row_number() OVER (PARTITION BY k.old ORDER BY kind DESC, gain DESC, source) <= any_value(cap) OVER (PARTITION BY k.old))
            SELECT source, old, new, gain, kind FROM sel QUALIFY kind = 'single' OR count(*) OVER (PARTITION BY pair) = 2"""),
        "seed_provinces": (lambda s, d: seed_provinces(li(s, d), s, d), f"""WITH {LI}, b AS (SELECT row_number() OVER (ORDER BY count(DISTINCT source) DESC, sum(amount::DECIMAL(18,4)) DESC, location) AS rank, location, count(DISTINCT source) AS users FROM li GROUP BY location),
            p AS (SELECT row_number() OVER (ORDER BY count(*) DESC, n_name) AS rank, n_name AS province, count(*) AS population FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name) SELECT rank, location, users, province, population FROM b JOIN p USING (rank) WHERE rank <= 25"""),
        "activity_prior": (activity_prior, """WITH g AS (SELECT n_name AS province, count(DISTINCT c_custkey) AS people, coalesce(sum(o_totalprice::DECIMAL(18,2))::DOUBLE, 0) AS spending FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1),
            h AS (SELECT *, people / sum(people) OVER () * (spending / sum(spending) OVER ()) AS p FROM g) SELECT province, people, spending, p / sum(p) OVER () AS prior FROM h"""),
        "weight_summary": (lambda s, d: weight_summary(soft_weights(li(s, d))), f"WITH {LI}, {P_SQL} SELECT CASE WHEN weight > 1 THEN 'up' ELSE 'down' END AS side, row_number() OVER (PARTITION BY weight > 1 ORDER BY round(abs(weight - 1), 9) DESC, value) AS rank, value, weight FROM sw WHERE weight <> 1 QUALIFY rank <= 5"),
        "constraint_errors": (lambda s, d: constraint_errors(li(s, d)), f"""WITH {LI}, x AS (SELECT DISTINCT 'province' AS field, '' AS part, source_province AS value, source AS id FROM li UNION ALL SELECT DISTINCT 'level2', level1, level2, target FROM li),
            k AS (SELECT field, part, value, count(*)::DOUBLE AS k FROM x GROUP BY ALL), s AS (SELECT field, part, k / sum(k) OVER (PARTITION BY field, part) AS p, 1.0::DOUBLE / count(*) OVER (PARTITION BY field, part) AS q FROM k) SELECT field, part, sum(abs(p - q)) / 2 AS tvd FROM s GROUP BY 1, 2"""),
        "attribute_summary": (lambda s, d: table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("province"), F.col("c_mktsegment").alias("attribute")).groupingSets([["province"], ["attribute"], ["province", "attribute"]], "province", "attribute").agg(F.count(one).alias("n")), "SELECT n_name AS province, c_mktsegment AS attribute, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY GROUPING SETS ((n_name), (c_mktsegment), (n_name, c_mktsegment))"),
    }
