"""Priors of regions and the attributes of users that are drawn from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from ..sources.views import table

W = Window.partitionBy
one = "*"
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
KINDS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
#: Base shares of age groups by gender: parameters of the age model.
AGES = {"Female": (0.40, 0.43, 0.17), "Male": (0.44, 0.42, 0.14)}
AGE_GROUPS = ("Middle-aged Adults", "Older Adults", "Young Adults")


def homes(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("province"))
    return table(spark, d, "customer").join(nation, "c_nationkey").select(F.col("c_custkey").alias("source"), "province", F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("funds"))


def percent_text(share: Column) -> Column:
    """A share as a percent string with one decimal."""
    n = F.floor(share * 1000 + 0.5).cast("long")
    return F.concat(F.floor(n / 10).cast("long").cast("string"), F.lit("."), F.pmod(n, F.lit(10)).cast("string"), F.lit("%"))


def percent_text_sql(x: str) -> str:
    return f"((floor({x} * 1000 + 0.5)::BIGINT // 10)::VARCHAR || '.' || (floor({x} * 1000 + 0.5)::BIGINT % 10)::VARCHAR || '%')"


def wide_prior(rows: DataFrame, value: str, values: list[str]) -> DataFrame:
    """A row a province with a percent string for each value, as such tables are published."""
    return rows.groupBy("province").agg(*[percent_text(F.count_if(F.col(value) == v) / F.count(one)).alias(v) for v in values])


def long_prior(wide: DataFrame, values: list[str], field: str) -> DataFrame:
    """(field, province, value, prob) of a wide table of percent strings, each province made to sum to one; a province of zeros: even shares."""
    parsed = wide.select("province", *[S.percent(F.col(v)).alias(v) for v in values])
    return S.normalized(parsed.unpivot("province", values, "value", "p"), ["province"], "p").select(F.lit(field).alias("field"), "province", "value", F.col("p").alias("prob"))


def gender_prior(spark: SparkSession, d: str) -> DataFrame:
    rows = homes(spark, d).withColumn("g", F.when(F.col("funds") < 3000, "Female").otherwise("Male"))
    return long_prior(wide_prior(rows, "g", ["Female", "Male"]), ["Female", "Male"], "gender")


def education_prior(spark: SparkSession, d: str) -> DataFrame:
    return long_prior(wide_prior(homes(spark, d), "segment", SEGMENTS), SEGMENTS, "education")


def occupation_prior(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("source"), F.col("o_orderpriority").alias("kind"))
    return long_prior(wide_prior(orders.join(homes(spark, d), "source"), "kind", KINDS), KINDS, "occupation")


def relative_levels(spark: SparkSession, d: str) -> DataFrame:
    """Each province's level of older people against the whole, as text (here: of funds); mostly percents, some plain numbers."""
    g = homes(spark, d).groupBy("province").agg(F.sum(F.col("funds").cast("decimal(18,2)")).alias("a"), F.count(one).alias("n"))
    level = (F.col("a").cast("double") / F.col("n")) / (F.sum("a").over(W(F.lit(0))).cast("double") / F.sum("n").over(W(F.lit(0))))
    plain = F.pmod(F.length("province"), F.lit(2)) == 0
    return g.select("province", F.when(plain, F.floor(level * 100).cast("long").cast("string")).otherwise(percent_text(level)).alias("raw"))


def level_violations(levels: DataFrame) -> DataFrame:
    value = S.relative_level(F.col("raw"))
    return levels.select("province", "raw", value.alias("level")).where(value.isNull() | (value <= 0) | (value > 3))


def age_prior(levels: DataFrame) -> DataFrame:
    """(province, gender, value, prob): the share of older people is the base one times the province's level (half at least), under 0.8; the rest
    keeps the base ratio of the two younger groups."""
    base = [F.struct(F.lit(g).alias("gender"), *[F.lit(float(x)).alias(n) for n, x in zip(("young", "middle", "old"), v, strict=True)]) for g, v in AGES.items()]
    rows = levels.select("province", S.relative_level(F.col("raw")).alias("level"), F.inline(F.array(*base)))
    old = F.least(F.col("old") * F.greatest("level", F.lit(0.5)), F.lit(0.8))
    rows = rows.withColumn("p_old", old).withColumn("rest", 1 - F.col("p_old"))
    young = F.col("rest") * F.col("young") / (F.col("young") + F.col("middle"))
    middle = F.col("rest") * F.col("middle") / (F.col("young") + F.col("middle"))
    groups = F.array(*[F.struct(F.lit(n).alias("value"), p.alias("prob")) for n, p in zip(AGE_GROUPS, (middle, F.col("p_old"), young), strict=True)])
    return rows.select("province", "gender", F.inline(groups))


def draw(users: DataFrame, prior: DataFrame, field: str, on: list[str]) -> DataFrame:
    """One value a user by inverse distribution: a keyed uniform falls into one interval of the user's group. Priors are a few values a region."""
    order = W(*on).orderBy("value")
    upto = F.sum("prob").over(order.rowsBetween(Window.unboundedPreceding, 0))
    cdf = prior.select(*on, "value", (upto - F.col("prob")).alias("_lo"), F.when(F.row_number().over(W(*on).orderBy(F.desc("value"))) == 1, 2.0).otherwise(upto).alias("_hi"))
    u = users.withColumn("_u", S.keyed_uniform(field, F.col("source")))
    return u.join(F.broadcast(cdf), on).where((F.col("_u") >= F.col("_lo")) & (F.col("_u") < F.col("_hi"))).drop("_u", "_lo", "_hi").withColumnRenamed("value", field)


def user_attributes(spark: SparkSession, d: str) -> DataFrame:
    """Gender by province, education by province, age by province and gender, occupation by province: four independent draws a user."""
    users = homes(spark, d).select("source", "province")
    for field, prior in (("gender", gender_prior), ("education", education_prior), ("occupation", occupation_prior)):
        users = draw(users, prior(spark, d), field, ["province"])
    return draw(users, age_prior(relative_levels(spark, d)), "age_group", ["province", "gender"])


def province_violations(users: DataFrame, regions: DataFrame) -> DataFrame:
    """Repeated users, blank provinces and provinces that no region has, a row each."""
    repeated = users.groupBy("source").agg(F.count(one).alias("n")).where("n > 1").select(F.lit("repeated").alias("rule"), F.col("source").cast("string").alias("value"))
    blank = users.where(F.coalesce(F.trim("province"), F.lit("")) == "").select(F.lit("blank").alias("rule"), F.col("source").cast("string").alias("value"))
    unknown = users.where(F.trim("province") != "").select("province").distinct().join(regions.select("province"), "province", "left_anti").select(F.lit("unknown").alias("rule"), F.col("province").alias("value"))
    return repeated.unionByName(blank).unionByName(unknown)


def odd_users(spark: SparkSession, d: str) -> DataFrame:
    """Users whose list has the faults that checks must find."""
    h = homes(spark, d).select("source", F.when(F.col("source") % 40 == 3, " ").when(F.col("source") % 50 == 7, "Atlantis").otherwise(F.col("province")).alias("province"))
    return h.union(h.where("source % 60 = 5"))


HOMES = "h AS (SELECT c_custkey AS source, n_name AS province, c_mktsegment AS segment, c_acctbal AS funds FROM customer JOIN nation ON c_nationkey = n_nationkey)"


def _long_sql(name: str, rows: str, value: str, values: list[str]) -> str:
    wide = ", ".join(percent_text_sql(f"(count(*) FILTER ({value} = '{v}'))::DOUBLE / count(*)") + f' AS "{v}"' for v in values)
    return f"""{name}w AS (SELECT province, {wide} FROM {rows} GROUP BY 1), {name}l AS (UNPIVOT {name}w ON {", ".join(f'"{v}"' for v in values)} INTO NAME value VALUE t),
    {name} AS (SELECT province, value, p / sum(p) OVER (PARTITION BY province) AS prob FROM (SELECT province, value, replace(t, '%', '')::DOUBLE / 100 AS p FROM {name}l))"""


PRIORS = f"""{HOMES}, hg AS (SELECT *, CASE WHEN funds < 3000 THEN 'Female' ELSE 'Male' END AS g FROM h), ho AS (SELECT h.*, o_orderpriority AS kind FROM orders JOIN h ON o_custkey = source),
    {_long_sql("gp", "hg", "g", ["Female", "Male"])}, {_long_sql("ep", "h", "segment", SEGMENTS)}, {_long_sql("op", "ho", "kind", KINDS)},
    la AS (SELECT province, sum(funds::DECIMAL(18,2)) AS a, count(*) AS n FROM h GROUP BY 1), lb AS (SELECT province, (a::DOUBLE / n) / ((sum(a) OVER ())::DOUBLE / sum(n) OVER ()) AS level FROM la),
    rl AS (SELECT province, CASE WHEN length(province) % 2 = 0 THEN floor(level * 100)::BIGINT::VARCHAR ELSE {percent_text_sql("level")} END AS raw FROM lb),
    rv AS (SELECT province, raw, CASE WHEN raw LIKE '%\\%' ESCAPE '\\' THEN replace(raw, '%', '')::DOUBLE / 100 WHEN raw::DOUBLE > 3 THEN raw::DOUBLE / 100 ELSE raw::DOUBLE END AS level FROM rl),
    ab(gender, young, middle, old) AS (VALUES {", ".join(f"('{g}', {v[0]}::DOUBLE, {v[1]}::DOUBLE, {v[2]}::DOUBLE)" for g, v in AGES.items())}),
    ac AS (SELECT province, gender, young, middle, least(old * greatest(level, 0.5::DOUBLE), 0.8::DOUBLE) AS po FROM rv, ab),
    ap AS (SELECT province, gender, unnest(['{"', '".join(AGE_GROUPS)}']) AS value, unnest([(1 - po) * middle / (young + middle), po, (1 - po) * young / (young + middle)]) AS prob FROM ac)"""


def _draw_sql(users: str, prior: str, field: str, on: list[str], out: str) -> str:
    keys = ", ".join(on)
    return f"""{out}c AS (SELECT *, sum(prob) OVER (PARTITION BY {keys} ORDER BY value) AS hi, row_number() OVER (PARTITION BY {keys} ORDER BY value DESC) AS last FROM {prior}),
    {out} AS (SELECT u.*, c.value AS {field} FROM (SELECT *, ('0x' || substr(md5(source::VARCHAR || '|{field}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u_ FROM {users}) u JOIN {out}c c USING ({keys}) WHERE u_ >= hi - prob AND (u_ < hi OR last = 1))"""


USERS = f"""{PRIORS}, u0 AS (SELECT source, province FROM h), {_draw_sql("u0", "gp", "gender", ["province"], "u1")}, {_draw_sql("(SELECT source, province, gender FROM u1)", "ep", "education", ["province"], "u2")},
    {_draw_sql("(SELECT source, province, gender, education FROM u2)", "op", "occupation", ["province"], "u3")}, {_draw_sql("(SELECT source, province, gender, education, occupation FROM u3)", "ap", "age_group", ["province", "gender"], "u4")},
    us AS (SELECT source, province, gender, education, occupation, age_group FROM u4)"""


def queries() -> dict:
    every = lambda s, d: gender_prior(s, d).unionByName(education_prior(s, d)).unionByName(occupation_prior(s, d))
    regions = lambda s, d: table(s, d, "nation").select(F.col("n_name").alias("province"))
    odd = "x0 AS (SELECT c_custkey AS source, CASE WHEN c_custkey % 40 = 3 THEN ' ' WHEN c_custkey % 50 = 7 THEN 'Atlantis' ELSE n_name END AS province FROM customer JOIN nation ON c_nationkey = n_nationkey), x AS (SELECT * FROM x0 UNION ALL SELECT * FROM x0 WHERE source % 60 = 5)"
    return {
        "region_priors_long": (every, f"WITH {PRIORS} SELECT 'gender' AS field, * FROM gp UNION ALL SELECT 'education', * FROM ep UNION ALL SELECT 'occupation', * FROM op"),
        "normalize_prob": (lambda s, d: S.normalized(table(s, d, "customer").select("c_nationkey", "c_custkey", F.greatest("c_acctbal", F.lit(0.0)).alias("p")), ["c_nationkey"], "p"),
            "SELECT c_nationkey, c_custkey, CASE WHEN sum(p) OVER w > 0 THEN p / sum(p) OVER w ELSE 1.0::DOUBLE / count(*) OVER w END AS p FROM (SELECT *, greatest(c_acctbal, 0) AS p FROM customer) WINDOW w AS (PARTITION BY c_nationkey)"),
        "relative_levels": (lambda s, d: relative_levels(s, d).withColumn("level", S.relative_level(F.col("raw"))), f"WITH {PRIORS} SELECT * FROM rv"),
        "relative_level_violations": (lambda s, d: level_violations(relative_levels(s, d).withColumn("raw", F.when(F.col("province").endswith("1"), "0%").when(F.col("province").endswith("2"), "412%").when(F.col("province").endswith("3"), "n/a").otherwise(F.col("raw")))),
            f"WITH {PRIORS}, z AS (SELECT province, CASE WHEN province LIKE '%1' THEN '0%' WHEN province LIKE '%2' THEN '412%' WHEN province LIKE '%3' THEN 'n/a' ELSE raw END AS raw FROM rl), y AS (SELECT province, raw, CASE WHEN raw LIKE '%\\%' ESCAPE '\\' THEN try_cast(replace(raw, '%', '') AS DOUBLE) / 100 WHEN try_cast(raw AS DOUBLE) > 3 THEN try_cast(raw AS DOUBLE) / 100 ELSE try_cast(raw AS DOUBLE) END AS level FROM z) SELECT * FROM y WHERE level IS NULL OR level <= 0 OR level > 3"),
        "age_distribution": (lambda s, d: age_prior(relative_levels(s, d)), f"WITH {PRIORS} SELECT * FROM ap"),
        "user_attributes": (user_attributes, f"WITH {USERS} SELECT * FROM us"),
        "attr_by_province": (lambda s, d: user_attributes(s, d).groupBy("province").agg(F.count(one).alias("n"), *[F.avg((F.col("age_group") == a).cast("int")).alias(a.split()[0].split("-")[0].lower()) for a in AGE_GROUPS]), f"WITH {USERS} SELECT province, count(*) AS n, " + ", ".join(f"avg((age_group = '{a}')::INT) AS {a.split()[0].split('-')[0].lower()}" for a in AGE_GROUPS) + " FROM us GROUP BY 1"),
        "source_province_violations": (lambda s, d: province_violations(odd_users(s, d), regions(s, d)), f"WITH {odd} SELECT 'repeated' AS rule, source::VARCHAR AS value FROM x GROUP BY source HAVING count(*) > 1 UNION ALL SELECT 'blank', source::VARCHAR FROM x WHERE trim(province) = '' UNION ALL (SELECT DISTINCT 'unknown', province FROM x WHERE trim(province) <> '' AND province NOT IN (SELECT n_name FROM nation))"),
        "national_priors": (lambda s, d: national(s, d), f"WITH {PRIORS}, w AS (SELECT province, count(*)::DOUBLE / sum(count(*)) OVER () AS w FROM h GROUP BY 1), x AS (SELECT 'gender' AS field, * FROM gp UNION ALL SELECT 'education', * FROM ep UNION ALL SELECT 'occupation', * FROM op UNION ALL SELECT 'age', ap.province, ap.value, ap.prob * gp.prob FROM ap JOIN gp ON gp.province = ap.province AND gp.value = ap.gender) SELECT field, value, sum(prob * w) AS prob FROM x JOIN w USING (province) GROUP BY 1, 2"),
    }


def national(spark: SparkSession, d: str) -> DataFrame:
    """Shares of the whole country: each province's prior weighted by its people; ages over both genders."""
    people = homes(spark, d).groupBy("province").agg(F.count(one).alias("n")).select("province", (F.col("n") / F.sum("n").over(W(F.lit(0)))).alias("_w"))
    gender = gender_prior(spark, d)
    ages = age_prior(relative_levels(spark, d)).join(gender.select("province", F.col("value").alias("gender"), F.col("prob").alias("_g")), ["province", "gender"])
    every = gender.unionByName(education_prior(spark, d)).unionByName(occupation_prior(spark, d)).unionByName(ages.select(F.lit("age").alias("field"), "province", "value", (F.col("prob") * F.col("_g")).alias("prob")))
    return every.join(people, "province").groupBy("field", "value").agg(F.sum(F.col("prob") * F.col("_w")).alias("prob"))
