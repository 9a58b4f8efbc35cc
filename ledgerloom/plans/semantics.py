"""Merchants against what their categories should look like: profiles, errors, match rates, and new categories where fraud is evident."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from ..operators.assign import cut_lineage
from ..sources.views import LI_TIMED, txn_li
from . import levels
from .people import KINDS, SEGMENTS, USERS, user_attributes
from .profiles import exact_sum
from .taxonomy import AGE_LABELS, EDUCATION_LABELS, INDUSTRY_LABELS, RISKY, TAXONOMY, keyword_priors, priors_sql

W = Window.partitionBy
one = "*"
#: What the given tables' segments and order kinds stand for.
EDUCATION_OF = dict(zip(SEGMENTS, (*EDUCATION_LABELS, EDUCATION_LABELS[-1]), strict=True))
INDUSTRY_OF = dict(zip(KINDS, ("Wholesale and Retail Trade", "Manufacturing", "Education", "Financial Services", "Health and Social Work"), strict=True))
# Labels of special interest, and weights of the fit.
SELECTED = ("Medical Aesthetics", "Online Medical Services", "Fuel Supply Services", "Full-Service Restaurant", "Fast Food and Snacks", "Hotels, Inns and Homestays", "Direct Tourism-Related Services", "Air Travel Services", "Expressway Toll and Service Areas", "Gaming", "Apparel, Footwear and Bags", "Primary and Secondary Education", "Software Development Services", "Hair, Beauty and Nail Services", "Pet Hospital and Other Pet Services")
FIT = {"online": 0.18, "amount": 0.18, "volatility": 0.14, "hour": 0.14, "gender": 0.08, "age": 0.09, "education": 0.09, "occupation": 0.10}
# Evidence of fraud (labelled, fraud, rate; fraud, rate), tolerances and limits of new categories.
EVIDENCE, MUCH = (20, 3, 0.15), (50, 0.12)
SAME_TOLERANCE, CROSS_GAIN, RISK_GAIN, CROSS_RISK, RISK_WEIGHT = 0.08, 0.05, 0.12, 0.65, 0.35
MOST_CHANGES, LEVEL1_RATE, MOST_SHARE = 120, 0.08, 0.65
LABELS = ("low", "low_to_medium", "medium", "high")


def placed_merchants(spark: SparkSession, d: str) -> DataFrame:
    """(target, level1, level2): level1 by the decision lists, level2 drawn evenly among its own."""
    rows = levels.decided(levels.relative(levels.branded(levels.merchants(spark, d)))).select("target", "level1")
    own = F.element_at(F.create_map(*[x for c, names in TAXONOMY.items() for x in (F.lit(c), F.array(*[F.lit(v) for v in names]))]), F.col("level1"))
    at = F.floor(S.keyed_uniform("level2", F.col("target")) * F.size("_of")).cast("int")
    return rows.withColumn("_of", own).select("target", "level1", F.get("_of", at).alias("level2"))


def enriched(spark: SparkSession, d: str) -> DataFrame:
    """Transactions with the hour and the user's attributes."""
    rename = lambda c, names: F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col(c))
    users = user_attributes(spark, d).select("source", "gender", F.col("age_group").alias("age"), rename("education", EDUCATION_OF).alias("education"), rename("occupation", INDUSTRY_OF).alias("industry"))
    facts = txn_li(spark, d, timed=True, users=users, parts=False)
    return facts.select("target", "amount", "label", F.hour("datetime").alias("hour"), (F.col("source_province") != F.col("transaction_province")).cast("int").alias("out"), "gender", "age", "education", "industry")


#: What a profile counts, and of how many rows (`_of`): shares are made of both at the end, so merchants' counts add up to their categories'.
COUNTED = {"out": ("out", (1,)), "women": ("gender", ("Female",)), "ages": ("age", AGE_LABELS), "educations": ("education", EDUCATION_LABELS), "occupations": ("industry", INDUSTRY_LABELS)}
COUNTS = [*[f"{c}_{i}" for c, (_, v) in COUNTED.items() for i in range(len(v))], *[f"{c}_of" for c in COUNTED], *[f"hour_{h}" for h in range(24)], "tx", "paid", "normal", "fraud"]


def tallies(facts: DataFrame, merchants: DataFrame) -> DataFrame:
    """A row a merchant with its levels: exact counts and sums, and the sum of squares about its mean (`m2`). Facts go narrow to their merchant once."""
    a = F.col("amount")
    counts = {f"{c}_{i}": F.count_if(F.col(column) == v) for c, (column, values) in COUNTED.items() for i, v in enumerate(values)} | {f"{c}_of": F.count(column) for c, (column, _) in COUNTED.items()}
    counts |= {f"hour_{h}": F.count_if(F.col("hour") == h) for h in range(24)} | {"tx": F.count(one), "paid": F.count(a), "normal": F.count_if(F.col("label") == 0), "fraud": F.count_if(F.col("label") == 1)}
    g = facts.repartition("target").groupBy("target").agg(F.sum(a.cast("decimal(18,4)")).alias("total"), (F.var_pop(a) * F.count(a)).alias("m2"), *[counts[c].alias(c) for c in COUNTS])
    return g.join(merchants, "target")


def summed(tally: DataFrame, key: list[str]) -> DataFrame:
    """Tallies of merchants put together: squares about the common mean are those about each own mean and those of the means."""
    mean = F.col("total").cast("double") / F.col("paid")
    g = tally.groupBy(*key).agg(F.sum("total").alias("total"), F.sum("m2").alias("_within"), *[F.sum(c).alias(c) for c in COUNTS])
    common = F.broadcast(g.select(*key, mean.alias("_mean")))  # taxonomy
    between = tally.join(common, key).groupBy(*key).agg(F.sum(F.col("paid") * F.pow(mean - F.col("_mean"), 2)).alias("_between"))
    return g.join(between, key).withColumn("m2", F.col("_within") + F.col("_between"))


def profiles(tally: DataFrame, key: list[str]) -> DataFrame:
    """Per group: size, amounts, share of other provinces, the three commonest hours (ties to the earlier), and shares of all user attributes."""
    share = lambda c: [F.try_divide(F.col(f"{c}_{i}"), F.col(f"{c}_of")) for i in range(len(COUNTED[c][1]))]
    total = F.col("total").cast("double")
    hours = F.array_sort(F.filter(F.array(*[F.struct((-F.col(f"hour_{h}")).alias("k"), F.lit(h).alias("hour")) for h in range(24)]), lambda x: x["k"] < 0))
    rows = tally.select(*key, "tx", total.alias("total"), F.try_divide(total, F.col("paid")).alias("mean"), F.when(F.col("paid") > 1, F.sqrt(F.col("m2") / (F.col("paid") - 1))).otherwise(0.0).alias("std"), share("out")[0].alias("cross"), share("women")[0].alias("women"),
        *[F.array(*share(c)).alias(c) for c in ("ages", "educations", "occupations")], "normal", "fraud", F.transform(F.slice(hours, 1, 3), lambda x: x["hour"]).alias("top_hours"))
    return rows.withColumn("cv", S.safe_div(F.col("std"), F.col("mean")))


def labelled(p: DataFrame, merchant: DataFrame) -> DataFrame:
    """With labels of amount (by the quartiles of the level1's merchants where it has four, else fixed cuts) and of spread."""
    q = merchant.groupBy("level1").agg(F.count(one).alias("_c"), *[F.percentile("mean", x).alias(f"_q{i}") for i, x in enumerate((0.25, 0.5, 0.75))])
    cut = lambda i, x: F.when(F.col("_c") >= 4, F.col(f"_q{i}")).otherwise(F.lit(float(x)))
    return p.join(F.broadcast(q), "level1").withColumns({"amount_label": S.amount_label(F.col("mean"), cut(0, 20), cut(1, 100), cut(2, 500)), "cv_label": S.cv_label(F.col("cv"))}).drop("_c", "_q0", "_q1", "_q2")  # a row a level1


def scored_online(merchant: DataFrame) -> DataFrame:
    low = merchant.agg(F.percentile("cross", 0.1).alias("_lo"), F.percentile("cross", 0.95).alias("_hi"))
    return merchant.join(F.broadcast(low)).withColumn("online_score", S.minmax_score(F.col("cross"), F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")  # one row


def merchant_profiles(tally: DataFrame) -> DataFrame:
    """A row a merchant, labelled and scored; levels kept."""
    p = cut_lineage(profiles(tally, ["target", "level1", "level2"]))
    return labelled(scored_online(p), p)


def apart(a: Column, b: Column) -> Column:
    """Total variation distance of two arrays of shares."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / 2


def mean_of(*parts: Column) -> Column:
    """Mean of the parts that are there; null if none is."""
    total = sum((F.coalesce(p, F.lit(0.0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0.0)))
    return F.try_divide(total, sum((p.isNotNull().cast("int") for p in parts[1:]), parts[0].isNotNull().cast("int")))


def against(rows: DataFrame, prior: DataFrame, how: str = "left") -> DataFrame:
    """Errors of each row against the prior of its (level1, level2); rows without a prior keep their own columns, and errors that have no data are null."""
    p = prior.select("level1", "level2", *[F.col(c).alias(f"p_{c}") for c in ("online", "amount", "vol", "hours", "female", "age", "edu", "industries", "basis")])
    both = rows.join(F.broadcast(p), ["level1", "level2"], how)  # taxonomy
    known = F.col("p_online").isNotNull() & (F.col("tx") > 0)
    when = lambda c: F.when(known, c)
    prior_hours = F.transform(F.split("p_hours", ","), lambda h: h.cast("int"))
    held = F.size(F.filter("top_hours", lambda h: F.array_contains(prior_hours, h)))
    both = both.withColumns({
        "online_error": when(F.abs(F.col("online_score") - F.col("p_online"))), "amount_error": when(S.label_distance(F.col("amount_label"), F.col("p_amount"))), "volatility_error": when(S.label_distance(F.col("cv_label"), F.col("p_vol"))),
        "hour_hit": F.when(F.col("p_online").isNotNull(), held / F.greatest(F.size("top_hours"), F.lit(1))), "gender_error": when(F.abs(F.col("women") - F.col("p_female"))), "age_error": when(apart(F.col("ages"), F.col("p_age"))),
        "education_error": when(apart(F.col("educations"), F.col("p_edu"))), "occupation_error": when(apart(F.col("occupations"), F.col("p_industries")))})
    both = both.withColumn("demographic_tvd", mean_of(*[F.col(f"{c}_error") for c in ("gender", "age", "education", "occupation")]))
    parts = [F.when(F.col("online_error").isNotNull(), 1 - F.least(F.lit(1.0), F.col("online_error"))), 1 - F.col("amount_error"), 1 - F.col("volatility_error"), F.col("hour_hit"), 1 - F.col("demographic_tvd")]
    return both.withColumn("overall", F.when(F.col("p_online").isNotNull(), mean_of(*parts)))


ERRORS = ("online_error", "amount_error", "volatility_error", "hour_hit", "gender_error", "age_error", "education_error", "occupation_error", "demographic_tvd", "overall")


def rounded(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.select(*key, "tx", F.round("total", 2).alias("total"), F.round("cv", 6).alias("cv"), "amount_label", "cv_label", F.round("online_score", 9).alias("online_score"), F.concat_ws(",", F.transform("top_hours", lambda h: h.cast("string"))).alias("top_hours"), *[F.round(e, 9).alias(e) for e in ERRORS])


def level2_vs_prior(tally: DataFrame, merchant: DataFrame, prior: DataFrame) -> DataFrame:
    """A row for each prior: what its transactions look like; online score is the mean over its merchants."""
    p = labelled(profiles(summed(tally, ["level1", "level2"]), ["level1", "level2"]), merchant)
    own = merchant.groupBy("level1", "level2").agg(F.count(one).alias("merchants"), F.avg("online_score").alias("online_score"))
    return against(p.join(own, ["level1", "level2"]), prior, "left")


def match_rates(level2: DataFrame) -> DataFrame:
    """One row: how often labels match, and mean errors, over categories that have transactions."""
    return level2.where("tx > 0").agg(F.count(one).alias("level2"), F.avg((F.col("amount_label") == F.col("p_amount")).cast("int")).alias("amount_match"), F.avg((F.col("cv_label") == F.col("p_vol")).cast("int")).alias("volatility_match"),
        *[F.round(F.avg(e), 9).alias(f"{e}_mean") for e in ("hour_hit", "online_error", "demographic_tvd", "occupation_error", "overall")])


def risk(prior: DataFrame) -> DataFrame:
    """How risky a category is by its prior, 0 to 1."""
    by = lambda c, high, medium: F.when(F.col(c) == "high", high).when(F.col(c) == "medium", medium).otherwise(0.0)
    word = F.lit(False)
    for r in RISKY:
        word = word | F.col("level2").contains(r)
    return prior.withColumn("risk", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.18 + 0.22 * F.col("online") + by("amount", 0.13, 0.06) + by("vol", 0.10, 0.04) + F.when(word, 0.32).otherwise(0.0))))


def fit_of() -> Column:
    """How well a row fits the prior it was joined with, by all eight errors; a missing online score counts half, missing hours miss."""
    part = {"online": F.least(F.lit(1.0), F.coalesce("online_error", F.lit(0.5))), "hour": 1 - F.coalesce("hour_hit", F.lit(0.0)), "gender": F.least(F.lit(1.0), F.col("gender_error"))}
    error = sum((F.lit(w) * part.get(c, F.col(f"{c}_error")) for c, w in FIT.items()), F.lit(0.0))
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - error)), 9)


def evident(profile: DataFrame) -> DataFrame:
    """Profiles against their priors with evidence of fraud and of misfit: in how many of six dimensions, or overall."""
    labeled, rate = F.col("normal") + F.col("fraud"), F.coalesce(F.try_divide(F.col("fraud"), F.col("normal") + F.col("fraud")), F.lit(0.0))
    rank = lambda c: F.array_position(F.array(*[F.lit(v) for v in LABELS]), F.col(c))
    wide = lambda a, b: (F.abs(rank(a) - rank(b)) >= 2)
    dims = [F.col("online_error") >= 0.45, wide("amount_label", "p_amount"), wide("cv_label", "p_vol"), F.col("hour_hit") <= 0.333, F.col("demographic_tvd") >= 0.70, F.col("occupation_error") >= 0.90]
    count = sum((F.coalesce(x, F.lit(False)).cast("int") for x in dims[1:]), F.coalesce(dims[0], F.lit(False)).cast("int"))
    rows = profile.withColumns({"labeled": labeled, "rate": F.round(rate, 9), "dims": count})
    fraud = ((F.col("labeled") >= EVIDENCE[0]) & (F.col("fraud") >= EVIDENCE[1]) & (F.col("rate") >= EVIDENCE[2])) | ((F.col("fraud") >= MUCH[0]) & (F.col("rate") >= MUCH[1]))
    return rows.where(fraud & ((F.col("dims") >= 1) | F.coalesce(F.col("overall") <= 0.65, F.lit(False))))


def options(candidates: DataFrame, prior: DataFrame) -> DataFrame:
    """Of each candidate the categories that it may move to, best first: those of its level1 before others, each by fit and risk; ties by name.

    Candidates times the categories that are riskier by enough, which is known before any fit. What depends on shares that move with every pick is left to the walk.
    """
    keep = ["target", "level1", "level2", "tx", "labeled", "fraud", "rate", "dims", "overall"]
    measured = ["top_hours", "women", "ages", "educations", "occupations", "online_score", "amount_label", "cv_label"]
    priced = risk(prior)
    own = against(candidates.select("target", "level1", "level2", "tx", *measured), prior, "inner").withColumn("old_fit", fit_of())
    slim = own.select(F.col("target").alias("_t"), F.col("level1").alias("_l1"), F.col("level2").alias("_l2"), "tx", *measured, "old_fit")
    # Where each category may lead by risk alone: the taxonomy with itself.
    was = priced.select(F.col("level1").alias("_l1"), F.col("level2").alias("_l2"), F.col("risk").alias("old_risk"))
    same = F.col("level1") == F.col("_l1")
    ways = was.join(priced.select("level1", "level2", "risk")).where((F.round(F.col("risk") - F.col("old_risk"), 9) >= RISK_GAIN) & (same | (F.col("risk") >= CROSS_RISK)) & ~(same & (F.col("level2") == F.col("_l2"))))
    rows = against(slim.join(F.broadcast(ways), ["_l1", "_l2"]), prior, "inner").withColumn("fit", fit_of())  # taxonomy
    fine = F.when(same, F.col("fit") >= F.round(F.col("old_fit") - SAME_TOLERANCE, 9)).otherwise(F.col("fit") >= F.round(F.col("old_fit") + CROSS_GAIN, 9))
    rows = rows.where(fine).withColumn("goal", F.round(F.col("fit") + RISK_WEIGHT * F.col("risk"), 9))
    entry = F.struct((~same).cast("int").alias("cross"), (-F.col("goal")).alias("g"), F.col("level1").alias("new_level1"), F.col("level2").alias("new_level2"), "fit", "risk", "old_fit", "old_risk")
    lists = rows.groupBy(F.col("_t").alias("target")).agg(F.array_sort(F.collect_list(entry)).alias("options"))
    return candidates.select(*keep).join(lists, "target")


def in_turn() -> list[Column]:
    """Candidates in the order in which they are visited."""
    return [F.desc("rate"), F.desc("fraud"), F.desc("dims"), F.desc("tx"), F.col("target")]


AUDIT = "target long, old_level1 string, old_level2 string, new_level1 string, new_level2 string, scope string, old_fit double, new_fit double, old_risk double, new_risk double, rate double, fraud long, dims int"


def recategorise(merchants: DataFrame, choices: DataFrame, most: int = MOST_CHANGES, rate: float = LEVEL1_RATE, share: float = MOST_SHARE) -> DataFrame:
    """The changes that a walk over candidates in order makes, while limits move with each pick: at most `rate` of a level1 (one at least), `most` in all, and no
    level2 that holds `share` of its level1 by then.

    As at most `most` merchants move, a level2 whose share lies lower by more than that can never be closed: a candidate whose best choice is such a one moves for
    sure when its turn comes. Behind as many sure ones of a level1 as it may lose, none of its candidates can move, so those are cut before one task walks
    what is left, in batches, with counts of the taxonomy as its state.
    """
    held = {(r["level1"], r["level2"]): r["n"] for r in merchants.groupBy("level1", "level2").agg(F.count(one).alias("n")).collect()}  # taxonomy
    size: dict[str, int] = {}
    for (a, _), k in held.items():
        size[a] = size.get(a, 0) + k
    limits = {a: max(1, int(k * rate)) for a, k in size.items()}
    spark = merchants.sparkSession
    open_ = [(a, b, bool((held[a, b] + most) < share * max(1, size[a] - most))) for a, b in held]
    sure = F.broadcast(spark.createDataFrame(open_, "new_level1 string, new_level2 string, _sure boolean"))
    caps = F.broadcast(spark.createDataFrame([(a, min(k, most)) for a, k in limits.items()], "level1 string, _cap long"))
    first = F.get("options", F.lit(0))
    rows = cut_lineage(choices.withColumns({"new_level1": first["new_level1"], "new_level2": first["new_level2"]}).join(sure, ["new_level1", "new_level2"], "left").join(caps, "level1"))
    nth = F.row_number().over(W("level1").orderBy(*in_turn()))
    place = F.struct((-F.col("rate")).alias("a"), (-F.col("fraud")).alias("b"), (-F.col("dims")).alias("c"), (-F.col("tx")).alias("d"), F.col("target").alias("e"))
    last = rows.where("_sure").withColumn("_n", nth).where(F.col("_n") <= most).where("_n <= _cap").groupBy("level1").agg(F.max(place).alias("_last"), F.max("_n").alias("_n"), F.first("_cap").alias("_c")).where("_n = _c")
    left = rows.join(F.broadcast(last.select("level1", "_last")), "level1", "left").where(F.col("_last").isNull() | (place <= F.col("_last")))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, whole, moved, total = dict(held), dict(size), {}, 0
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                if total >= most or moved.get(r.level1, 0) >= limits.get(r.level1, 1):
                    continue
                for o in r.options:
                    a, z = o["new_level1"], o["new_level2"]
                    if count.get((a, z), 0) < share * whole.get(a, 0) or not whole.get(a, 0):
                        count[r.level1, r.level2] -= 1
                        whole[r.level1] -= 1
                        count[a, z] = count.get((a, z), 0) + 1
                        whole[a] = whole.get(a, 0) + 1
                        moved[r.level1] = moved.get(r.level1, 0) + 1
                        total += 1
                        out.append((r.target, r.level1, r.level2, a, z, "cross_level1" if o["cross"] else "same_level1", o["old_fit"], o["fit"], o["old_risk"], o["risk"], r.rate, r.fraud, r.dims))
                        break
            yield pd.DataFrame(out, columns=[c.split()[0] for c in AUDIT.split(", ")])

    slim = left.select("target", "level1", "level2", "options", "rate", "fraud", "dims", "tx")
    return cut_lineage(slim.repartition(1).sortWithinPartitions(*in_turn()).mapInPandas(walk, AUDIT))


def explained(audit: DataFrame) -> DataFrame:
    """The audit with its reason in words."""
    f = lambda c: F.format_string("%.3f", F.col(c))
    evidence = F.when(F.col("fraud") > 0, F.concat(F.lit("fraud_rate_labeled="), f("rate"), F.lit(", fraud_count="), F.col("fraud").cast("string")))
    dims = F.when(F.col("dims") > 0, F.concat(F.lit("residual_dims="), F.col("dims").cast("string")))
    change = F.concat(F.lit("fit "), f("old_fit"), F.lit("->"), f("new_fit"), F.lit(", risk "), f("old_risk"), F.lit("->"), f("new_risk"))
    return audit.withColumn("reason", F.concat_ws("; ", evidence, dims, change))


def after(merchants: DataFrame, audit: DataFrame) -> DataFrame:
    """The merchants' table with the changes."""
    new = audit.select("target", F.col("new_level1").alias("_1"), F.col("new_level2").alias("_2"))
    return merchants.join(new, "target", "left").select("target", F.coalesce("_1", "level1").alias("level1"), F.coalesce("_2", "level2").alias("level2"))


def change_summary(merchants: DataFrame, candidates: DataFrame, audit: DataFrame) -> DataFrame:
    """(measure, scope, value): sizes of the job, and merchants of each level1 before and after."""
    count = lambda name, df, scope=F.lit("all"): df.groupBy(scope.alias("scope")).agg(F.count(one).alias("value")).select(F.lit(name).alias("measure"), "scope", "value")
    out = count("merchants", merchants).unionByName(count("candidates", candidates)).unionByName(count("changed", audit)).unionByName(count("changed_by_scope", audit, F.col("scope")))
    return out.unionByName(count("changed_from_level1", audit, F.col("old_level1"))).unionByName(count("level1_before", merchants, F.col("level1"))).unionByName(count("level1_after", after(merchants, audit), F.col("level1")))


def tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Merchants with levels, their tallies, their profiles, priors."""
    merchants = cut_lineage(placed_merchants(spark, d))
    tally = cut_lineage(tallies(enriched(spark, d), merchants))
    return merchants, tally, cut_lineage(merchant_profiles(tally)), cut_lineage(keyword_priors(merchants))


def semantics(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Merchants, candidates with evidence, their options, the changes."""
    merchants, _, profile, prior = tables(spark, d)
    found = cut_lineage(evident(against(profile, prior)))
    choices = cut_lineage(options(found, prior))
    return merchants, found, choices, recategorise(merchants, choices)


def semantic_sql() -> str:
    """Everything up to errors as CTEs: `mm` merchants, `kp` priors, `mv` merchants' profiles and `lv` categories' against priors."""
    taxonomy = "MAP {" + ", ".join(f"'{c}': [" + ", ".join("'" + v.replace("'", "''") + "'" for v in own) + "]" for c, own in TAXONOMY.items()) + "}"
    share = lambda c, names: "[" + ", ".join(f"avg(({c} = '{v}')::INT)" for v in names) + "]"
    case = lambda c, names: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " END"

    def profile(name: str, key: str) -> str:
        return f"""{name}g AS (SELECT {key}, count(*) AS tx, sum(amount::DECIMAL(18,4))::DOUBLE AS total, sum(amount::DECIMAL(18,4))::DOUBLE / count(amount) AS mean, coalesce(stddev_samp(amount), 0) AS std, avg("out") AS cross_, avg((gender = 'Female')::INT) AS women, {share("age", AGE_LABELS)} AS ages, {share("education", EDUCATION_LABELS)} AS educations, {share("industry", INDUSTRY_LABELS)} AS occupations,
    count(*) FILTER (label = 0) AS normal, count(*) FILTER (label = 1) AS fraud FROM fx GROUP BY {key}), {name}h AS (SELECT {key}, list(hour ORDER BY k DESC, hour)[1:3] AS top_hours FROM (SELECT {key}, hour, count(*) AS k FROM fx GROUP BY {key}, hour) GROUP BY {key}), {name}p AS (SELECT *, coalesce(std / nullif(mean, 0), 0) AS cv FROM {name}g JOIN {name}h USING ({key}))"""

    label = lambda p: f"{p}l AS (SELECT {p}p.*, CASE WHEN mean < CASE WHEN c >= 4 THEN a ELSE 20 END THEN 1 WHEN mean < CASE WHEN c >= 4 THEN b ELSE 100 END THEN 2 WHEN mean < CASE WHEN c >= 4 THEN z ELSE 500 END THEN 3 ELSE 4 END AS al, CASE WHEN cv < 0.5 THEN 1 WHEN cv < 1 THEN 2 WHEN cv < 2 THEN 3 ELSE 4 END AS vl FROM {p}p JOIN qs ON qs.level1 = {p}p.level1)"
    tvd = lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda x: abs(x[1] - x[2]))) / 2"
    names = "[" + ", ".join(f"'{x}'" for x in LABELS) + "]"

    def errors(src: str, out: str) -> str:
        return f"""{out}e AS (SELECT {src}.*, kp.amount AS p_amount, kp.vol AS p_vol, kp.online AS p_online, abs(online_score - kp.online) AS online_error, abs(al - list_position({names}, kp.amount)) / 3.0::DOUBLE AS amount_error, abs(vl - list_position({names}, kp.vol)) / 3.0::DOUBLE AS volatility_error, len(list_filter(top_hours, lambda h: list_contains(string_split(kp.hours, ','), h::VARCHAR)))::DOUBLE / len(top_hours) AS hour_hit,
    abs(women - kp.female) AS gender_error, {tvd("ages", "kp.age")} AS age_error, {tvd("educations", "kp.edu")} AS education_error, {tvd("occupations", "kp.industries")} AS occupation_error FROM {src} JOIN kp ON kp.level1 = {src}.level1 AND kp.level2 = {src}.level2),
    {out}d AS (SELECT *, (gender_error + age_error + education_error + occupation_error) / 4 AS demographic_tvd FROM {out}e), {out} AS (SELECT *, ((1 - least(1, online_error)) + (1 - amount_error) + (1 - volatility_error) + hour_hit + (1 - demographic_tvd)) / 5 AS overall, {names}[al] AS amount_label, {names}[vl] AS cv_label FROM {out}d)"""

    return f"""{levels.level_sql()}, {USERS},
mm AS (SELECT target, level1, l[(floor(('0x' || substr(md5(target::VARCHAR || '|level2'), 1, 8))::BIGINT / 4294967296.0::DOUBLE * len(l)) + 1)::INT] AS level2 FROM (SELECT *, {taxonomy}[level1] AS l FROM (SELECT target, {levels.decide_sql()} AS level1 FROM f))),
fx AS (SELECT li.source, li.target, amount, label, hour(datetime)::INT AS hour, (source_province <> transaction_province)::INT AS "out", gender, age_group AS age, {case("education", EDUCATION_OF)} AS education, {case("occupation", INDUSTRY_OF)} AS industry, level1, level2 FROM (SELECT source, target, amount, label, datetime, source_province, transaction_province FROM li) li JOIN us USING (source) JOIN mm USING (target)),
{priors_sql("mm")}, {profile("m", "target, level1, level2")}, {profile("c", "level1, level2")}, qs AS (SELECT level1, count(*) AS c, quantile_cont(mean, 0.25) AS a, quantile_cont(mean, 0.5) AS b, quantile_cont(mean, 0.75) AS z FROM mp GROUP BY 1), {label("m")}, {label("c")},
lo AS (SELECT quantile_cont(cross_, 0.1) AS lo, quantile_cont(cross_, 0.95) AS hi FROM mp), mo AS (SELECT ml_.*, CASE WHEN hi <= lo THEN CASE WHEN cross_ > lo THEN 1.0 ELSE 0.0 END ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, (cross_ - lo) / (hi - lo))) END AS online_score FROM (SELECT * FROM ml) ml_, lo),
co AS (SELECT cl.*, k.merchants, k.online_score FROM cl JOIN (SELECT level1, level2, count(*) AS merchants, avg(online_score) AS online_score FROM mo GROUP BY 1, 2) k ON k.level1 = cl.level1 AND k.level2 = cl.level2), {errors("mo", "mv")}, {errors("co", "lv")}"""


def queries() -> dict:
    keys = ["level1", "level2"]
    show = lambda key: ", ".join([*key, "tx", "round(total, 2) AS total", "round(cv, 6) AS cv", "amount_label", "cv_label", "round(online_score, 9) AS online_score", "array_to_string(top_hours, ',') AS top_hours", *[f"round({e}, 9) AS {e}" for e in ERRORS]])

    def category(s: SparkSession, d: str) -> DataFrame:
        _, tally, profile, prior = tables(s, d)
        return level2_vs_prior(tally, profile, prior)

    def merchant(s: SparkSession, d: str) -> DataFrame:
        _, _, profile, prior = tables(s, d)
        return against(profile, prior)

    flat = lambda p: p.select(*keys, "online", "bucket", "amount", "vol", "hours", "female", *[F.get("age", F.lit(i)).alias(f"age_{i}") for i in range(3)], *[F.get("edu", F.lit(i)).alias(f"edu_{i}") for i in range(4)], "occ", F.round(F.array_max("industries"), 9).alias("top_industry_share"), F.get(F.array(*[F.lit(x) for x in INDUSTRY_LABELS]), (F.array_position("industries", F.array_max("industries")) - 1).cast("int")).alias("top_industry"), "basis")
    flat_sql = ", ".join(["level1", "level2", "online", "bucket", "amount", "vol", "hours", "female", *[f"age[{i + 1}] AS age_{i}" for i in range(3)], *[f"edu[{i + 1}] AS edu_{i}" for i in range(4)], "occ", "round(list_max(industries), 9) AS top_industry_share", "[" + ", ".join(f"'{x}'" for x in INDUSTRY_LABELS) + "][list_position(industries, list_max(industries))] AS top_industry", "basis"])
    sql = semantic_sql()
    rates = "SELECT count(*) AS level2, avg((amount_label = p_amount)::INT) AS amount_match, avg((cv_label = p_vol)::INT) AS volatility_match, " + ", ".join(f"round(avg({e}), 9) AS {e}_mean" for e in ("hour_hit", "online_error", "demographic_tvd", "occupation_error", "overall")) + " FROM lv"
    selected = ", ".join(f"'{x}'" for x in SELECTED)
    rank = lambda c: f"list_position([{', '.join(repr(v) for v in LABELS)}], {c})"
    evidence = f"""ed AS (SELECT *, normal + fraud AS labeled, round(coalesce(fraud::DOUBLE / nullif(normal + fraud, 0), 0), 9) AS rate, (online_error >= 0.45)::INT + (abs({rank("amount_label")} - {rank("p_amount")}) >= 2)::INT + (abs({rank("cv_label")} - {rank("p_vol")}) >= 2)::INT + (hour_hit <= 0.333)::INT + (demographic_tvd >= 0.7)::INT + (occupation_error >= 0.9)::INT AS dims FROM mv),
    ec AS (SELECT * FROM ed WHERE ((labeled >= 20 AND fraud >= 3 AND rate >= 0.15) OR (fraud >= 50 AND rate >= 0.12)) AND (dims >= 1 OR overall <= 0.65))"""
    return {
        "placed_merchants": (placed_merchants, f"WITH {sql} SELECT * FROM mm"),
        "keyword_priors": (lambda s, d: flat(keyword_priors(placed_merchants(s, d))), f"WITH {sql} SELECT {flat_sql} FROM kp"),
        "level2_vs_prior": (lambda s, d: rounded(category(s, d), keys), f"WITH {sql} SELECT {show(keys)} FROM lv"),
        "level2_vs_prior_selected": (lambda s, d: rounded(category(s, d).where(F.col("level2").isin(*SELECTED)), keys), f"WITH {sql} SELECT {show(keys)} FROM lv WHERE level2 IN ({selected})"),
        "merchant_vs_prior": (lambda s, d: rounded(merchant(s, d), ["target", *keys]), f"WITH {sql} SELECT {show(['target', *keys])} FROM mv"),
        "match_rates": (lambda s, d: match_rates(category(s, d)), f"WITH {sql} {rates}"),
        "category_risk": (lambda s, d: risk(keyword_priors(placed_merchants(s, d))).select(*keys, F.round("risk", 9).alias("risk")), f"WITH {sql} SELECT level1, level2, round(least(1.0::DOUBLE, 0.18::DOUBLE + 0.22::DOUBLE * online + CASE amount WHEN 'high' THEN 0.13 WHEN 'medium' THEN 0.06 ELSE 0 END::DOUBLE + CASE vol WHEN 'high' THEN 0.10 WHEN 'medium' THEN 0.04 ELSE 0 END::DOUBLE + CASE WHEN " + " OR ".join(f"contains(level2, '{r}')" for r in RISKY) + " THEN 0.32 ELSE 0 END::DOUBLE), 9) AS risk FROM kp"),
        "merchant_fit": (lambda s, d: merchant(s, d).select("target", fit_of().alias("fit")), f"WITH {sql} SELECT target, round(1 - (0.18::DOUBLE * least(1, online_error) + 0.18::DOUBLE * amount_error + 0.14::DOUBLE * volatility_error + 0.14::DOUBLE * (1 - hour_hit) + 0.08::DOUBLE * gender_error + 0.09::DOUBLE * age_error + 0.09::DOUBLE * education_error + 0.10::DOUBLE * occupation_error), 9) AS fit FROM mv"),
        "fraud_candidates": (lambda s, d: evident(merchant(s, d)).select("target", *keys, "labeled", "fraud", "rate", "dims"), f"WITH {sql}, {evidence} SELECT target, level1, level2, labeled, fraud, rate, dims FROM ec"),
        "recategorised": (lambda s, d: explained(semantics(s, d)[3]), None),
        "recategorised_merchants": (lambda s, d: after((r := semantics(s, d))[0], r[3]), None),
        "unchanged_candidates": (lambda s, d: (r := semantics(s, d))[1].join(r[3], "target", "left_anti").select("target", *keys, "rate", "fraud", "dims", F.round("overall", 9).alias("overall")), None),
        "recategorise_summary": (lambda s, d: change_summary((r := semantics(s, d))[0], r[1], r[3]), None),
    }
