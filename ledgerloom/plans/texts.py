"""Profiles as text and nested records, template sentences, and the parsing, checking and replacing of generated texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from ..operators.assign import cut_lineage
from ..operators.order import running_counts
from ..sources.views import EV, LI, table, txn_ev, txn_li
from .people import USERS, percent_text, percent_text_sql, user_attributes
from .profiles import user_text_profile, user_text_sql
from .time import calendar, calendar_sql

W = Window.partitionBy
one = "*"
# Phrases of sentences about one transaction. Early mornings have none.
PERIODS = {"late_night": "late at night", "commute_morning": "during the morning commute", "workday_morning": "in the morning", "lunch": "around lunchtime", "afternoon": "in the afternoon", "commute_evening": "during the evening commute", "night": "in the evening"}
DAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
# Keyword lists in order of precedence, industries of order kinds, finer names of some categories (parameters of these queries).
KEYWORDS = [("ring", ("ring", "bolt")), ("colour", ("red", "blue", "green")), ("size", ("small", "large")), ("widget", ("widget",))]
INDUSTRIES = {"1-URGENT": ("Transport", "Health"), "2-HIGH": ("Finance", "Health", "Retail"), "3-MEDIUM": ("Retail",), "4-NOT SPECIFIED": (), "5-LOW": ("Education", "Retail")}
DETAILS = {"Brand#11": ("Corner Shops", "Kiosks"), "Brand#2": ("Canteens",), "Brand#17": ("Bakeries", "Cafes", "Tea Rooms")}


def clean_text(x: Column, default: str = "Unknown") -> Column:
    """Text without blanks at its ends; null, blank and nan: the default."""
    t = F.trim(x.cast("string"))
    return F.when(x.isNull() | (t == "") | (F.lower(t) == "nan"), default).otherwise(t)


def article(phrase: Column) -> Column:
    return F.when(F.lower(phrase).rlike("^[aeiou]"), "an").otherwise("a")


def and_list(parts: Column) -> Column:
    """a; a and b; a, b, and c."""
    n = F.size(parts)
    many = F.concat(F.array_join(F.slice(parts, F.lit(1), F.greatest(n - 1, F.lit(1))), ", "), F.lit(", and "), F.element_at(parts, -1))
    return F.when(n == 1, parts[0]).when(n == 2, F.array_join(parts, " and ")).otherwise(many)


def template_text(rows: DataFrame) -> DataFrame:
    """A sentence of three parts about each transaction (rows: calendar columns, user attributes, level2, is_out)."""
    phrase = F.coalesce(*[F.when(F.col("period_tag") == k, v) for k, v in PERIODS.items()], F.lit(""))
    day = F.element_at(F.array(*[F.lit(x) for x in DAYS]), F.col("dayofweek") + 1)
    month = F.when(F.col("is_month_start"), "at the start of the month").when(F.col("is_month_middle"), "in the middle of the month").when(F.col("is_month_end"), "at the end of the month")
    bill = F.when(F.col("is_common_bill_day"), "on a common bill-payment day")
    who = F.concat_ws(" ", F.lower(F.replace(clean_text(F.col("age_group")), F.lit("Adults"), F.lit("adult"))), F.lower(clean_text(F.col("gender"))))
    where = F.when(F.col("is_out"), "out-of-province").otherwise("local")
    text = F.concat(
        F.lit("The user is "), article(who), F.lit(" "), who, F.lit(" from "), clean_text(F.col("province")), F.lit(", has an education in "), clean_text(F.col("education")), F.lit(", and works in "), clean_text(F.col("occupation")),
        F.lit(". The user made "), article(where), F.lit(" "), where, F.lit(" transaction"), F.when(phrase == "", "").otherwise(F.concat(F.lit(" "), phrase)), F.lit(" with a merchant associated with "), clean_text(F.col("level2")),
        F.lit(". The transaction occurred "), and_list(F.array_compact(F.array(F.concat(F.lit("on "), day), month, bill))), F.lit("."))
    return rows.select("seq", text.alias("description"))


def described(spark: SparkSession, d: str) -> DataFrame:
    """Transactions with calendar, the user's attributes and the merchant's category."""
    merchants = table(spark, d, "part").select(F.col("p_partkey").alias("target"), F.col("p_type").alias("level1"), F.col("p_brand").alias("level2"))
    return calendar(txn_ev(spark, d)).join(user_attributes(spark, d), "source").join(merchants, "target").withColumn("is_out", F.pmod(F.col("seq"), F.lit(4)) == 0)


DESCRIBED = f"cal AS ({calendar_sql()}), de AS (SELECT cal.*, us.province, us.gender, us.education, us.occupation, us.age_group, p_type AS level1, p_brand AS level2, seq % 4 = 0 AS is_out FROM cal JOIN us USING (source) JOIN part ON p_partkey = target)"
TEMPLATE_SQL = (
    "SELECT seq, 'The user is ' || CASE WHEN regexp_matches(who, '^[aeiou]') THEN 'an ' ELSE 'a ' END || who || ' from ' || province || ', has an education in ' || education || ', and works in ' || occupation"
    " || '. The user made ' || CASE WHEN is_out THEN 'an out-of-province' ELSE 'a local' END || ' transaction' || " + "CASE period_tag " + " ".join(f"WHEN '{k}' THEN ' {v}'" for k, v in PERIODS.items()) + " ELSE '' END"
    " || ' with a merchant associated with ' || level2 || '. The transaction occurred ' || CASE len(l) WHEN 1 THEN l[1] WHEN 2 THEN l[1] || ' and ' || l[2] ELSE l[1] || ', ' || l[2] || ', and ' || l[3] END || '.' AS description"
    " FROM (SELECT *, lower(replace(age_group, 'Adults', 'adult')) || ' ' || lower(gender) AS who, list_filter(['on ' || " + "CASE dayofweek " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(DAYS)) + " END,"
    " CASE WHEN is_month_start THEN 'at the start of the month' WHEN is_month_middle THEN 'in the middle of the month' WHEN is_month_end THEN 'at the end of the month' END, CASE WHEN is_common_bill_day THEN 'on a common bill-payment day' END], lambda x: x IS NOT NULL) AS l FROM de)"
)


def top_values(df: DataFrame, key: str, value: str, most: int = 3) -> DataFrame:
    """(key, top): the most frequent values, ties by name."""
    order = W(key).orderBy(F.desc("n"), value)
    ranked = df.groupBy(key, value).agg(F.count(one).alias("n")).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most)
    return ranked.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", value))), lambda x: x[value]).alias("top"))


def channel_text(online: Column, remote: Column) -> Column:
    return F.when((online >= 0.2) & (online >= remote), "online-oriented").when(remote >= 0.2, "remote-oriented").otherwise("primarily local and offline")


CHANNEL_SQL = "CASE WHEN online >= 0.2 AND online >= remote THEN 'online-oriented' WHEN remote >= 0.2 THEN 'remote-oriented' ELSE 'primarily local and offline' END"


def channels(df: DataFrame, key: str) -> DataFrame:
    """Shares of out-of-province transactions with online and with other categories."""
    out = F.col("is_out")
    online = F.lower(F.concat_ws(" ", "level1", "level2")).rlike("online|internet|software|gaming|digital|promo")
    return df.groupBy(key).agg(F.avg((out & online).cast("int")).alias("online"), F.avg((out & ~online).cast("int")).alias("remote"))


def user_records(spark: SparkSession, d: str) -> DataFrame:
    """Each user's nested profile as a JSON line."""
    rows = described(spark, d)
    p = user_text_profile(txn_ev(spark, d)).join(channels(rows, "source"), "source").join(top_values(rows, "source", "level1"), "source").join(user_attributes(spark, d), "source")
    record = F.struct(
        F.col("source").cast("string").alias("Source_id"), F.struct(F.col("province").alias("Province"), F.col("gender").alias("Gender"), F.col("age_group").alias("Age"), F.col("education").alias("Education"), F.col("occupation").alias("Occupation")).alias("user_attributes"),
        F.struct(F.col("amount_preference").alias("amount_level"), "amount_volatility", F.col("frequency").alias("transaction_frequency"), F.col("intraday").alias("intraday_pattern"), F.col("week").alias("weekly_pattern"), F.col("month").alias("monthly_pattern"),
            channel_text(F.col("online"), F.col("remote")).alias("channel_tendency")).alias("transaction_profile"), F.struct(F.col("top").alias("preferred_categories")).alias("spending_preferences"))
    return p.select("source", F.to_json(record).alias("line"))


def user_sentence(spark: SparkSession, d: str) -> DataFrame:
    p = user_text_profile(txn_ev(spark, d)).join(user_attributes(spark, d), "source")
    labels = (("Province", "province"), ("Gender", "gender"), ("Age group", "age_group"), ("Education", "education"), ("Occupation", "occupation"), ("Spending level", "amount_preference"), ("Frequency", "frequency"), ("Weekly pattern", "week"))
    return p.select("source", F.concat(F.concat_ws("; ", *[F.concat(F.lit(f"{n}: "), clean_text(F.col(c))) for n, c in labels]), F.lit(".")).alias("basic_profile"))


def merchant_records(spark: SparkSession, d: str) -> DataFrame:
    """Each merchant's nested profile; merchants without transactions have defaults."""
    rows = described(spark, d)
    labels = user_text_profile(txn_ev(spark, d).withColumn("source", F.col("target")), least=1).withColumnRenamed("source", "target")
    users = rows.select("target", "source", "gender", "occupation").distinct()
    merchants = table(spark, d, "part").select(F.col("p_partkey").alias("target"), F.col("p_type").alias("level1"), F.col("p_brand").alias("level2"))
    p = details(merchants).join(labels, "target", "left").join(channels(rows, "target"), "target", "left")
    p = p.join(top_values(users, "target", "gender", 1).withColumnRenamed("top", "_g"), "target", "left").join(top_values(users, "target", "occupation").withColumnRenamed("top", "_o"), "target", "left")
    none = lambda c, x="No transactions": F.coalesce(c, F.lit(x))
    record = F.struct(
        F.col("target").cast("string").alias("Target_id"), F.struct(F.col("level1").alias("MCC_level1"), F.col("level2").alias("MCC_level2"), F.col("candidates").alias("fine_grained_candidates")).alias("merchant_category"),
        F.struct(none("amount_preference").alias("amount_level"), none("amount_volatility").alias("amount_volatility"), none("frequency", "low frequency").alias("transaction_frequency"), none("week").alias("weekly_pattern"), none("month").alias("monthly_pattern"),
            channel_text(F.coalesce("online", F.lit(0.0)), F.coalesce("remote", F.lit(0.0))).alias("channel_tendency")).alias("transaction_profile"),
        F.struct(none(F.array_join("_g", ", "), "No valid observations").alias("dominant_gender"), none(F.array_join("_o", ", "), "No valid observations").alias("occupation_top3")).alias("associated_user_profile"))
    return p.select("target", F.to_json(record).alias("line"))


def single_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Raw fields of user, transaction and merchant of those who appear once, as JSON with nulls kept (here: fraud pairs of user and merchant)."""
    rows = described(spark, d).where("label = 1").withColumn("_n", F.count(one).over(W("source", "target"))).where("_n = 1")
    record = F.struct(F.concat_ws("-", "source", "target").alias("Source_id"), F.struct("province", "gender").alias("raw_source_fields"), F.struct("seq", F.date_format("datetime", "yyyy-MM-dd'T'HH:mm:ss").alias("at"), F.lit(None).cast("string").alias("note")).alias("raw_transaction_fields"), F.struct("level1", "level2").alias("raw_target_fields"))
    return rows.select("seq", F.to_json(record, {"ignoreNullFields": "false"}).alias("line"))


def details(dim: DataFrame) -> DataFrame:
    """The finer names of each category; those without any keep their own."""
    pairs = F.create_map(*[x for k, v in DETAILS.items() for x in (F.lit(k), F.array(*[F.lit(n) for n in v]))])
    return dim.withColumn("candidates", F.coalesce(F.try_element_at(pairs, F.col("level2")), F.array("level2")))


def first_keyword(x: Column, word: bool = False) -> Column:
    """The first list one of whose keywords is in the text (as a part of it, or with `word` as a whole word)."""
    test = (lambda k: x.rlike(rf"(^|[^\p{{L}}]){k}([^\p{{L}}]|$)")) if word else (lambda k: x.contains(k))
    out = F.lit(None).cast("string")
    for name, keys in reversed(KEYWORDS):
        hit = F.lit(False)
        for k in keys:
            hit = hit | test(k)
        out = F.when(hit, name).otherwise(out)
    return out


def occupation_mix(tokens: DataFrame) -> DataFrame:
    """(source, industry, share): each token spreads evenly over its industries; tokens of none are left out."""
    of = F.create_map(*[x for k, v in INDUSTRIES.items() for x in (F.lit(k), F.array(*[F.lit(n) for n in v]).cast("array<string>"))])
    rows = tokens.select("source", F.explode(F.split("tokens", r"\|")).alias("token")).withColumn("_i", F.try_element_at(of, F.col("token")))
    rows = rows.select("source", F.size("_i").alias("_n"), F.explode("_i").alias("industry")).groupBy("source", "industry").agg(F.sum(1 / F.col("_n")).alias("w"))
    return rows.select("source", "industry", (F.col("w") / F.sum("w").over(W("source"))).alias("share"))


def hours_array(x: Column) -> Column:
    return F.transform(F.filter(F.split(x, ","), lambda h: F.trim(h) != ""), lambda h: F.trim(h).cast("int"))


def hours_text(*ranges: tuple[int, int]) -> str:
    """Hours of inclusive ranges as sorted text."""
    return ",".join(str(h) for h in sorted({h for a, z in ranges for h in range(a, z + 1)}))


def distribution_text(entries: Column) -> Column:
    """key:0.1234 of each (key, share), the largest first, joined by |."""
    ordered = F.array_sort(F.transform(entries, lambda e: F.struct((-e["share"]).alias("s"), e["key"].alias("key"))))
    return F.array_join(F.transform(ordered, lambda e: F.concat(e["key"], F.lit(":"), S.fixed(-e["s"], 4))), "|")


def distribution_map(x: Column) -> Column:
    """A map of the keys of such a text with their shares of its sum; the last colon parts a key from its value, what does not parse is left out."""
    parts = F.transform(F.split(x, r"\|"), lambda p: F.struct(F.trim(F.regexp_extract(p, "^(.*):([^:]*)$", 1)).alias("k"), F.regexp_extract(p, "^(.*):([^:]*)$", 2).try_cast("double").alias("v")))
    good = F.transform(F.filter(parts, lambda e: (e["k"] != "") & e["v"].isNotNull()), lambda e: F.struct(e["k"].alias("k"), F.greatest(e["v"], F.lit(0.0)).alias("v")))
    total = F.aggregate(good, F.lit(0.0), lambda a, e: a + e["v"])
    return F.map_from_entries(F.transform(F.filter(good, lambda _: total > 0), lambda e: F.struct(e["k"], e["v"] / total)))


def labelled(text: Column, name: str) -> Column:
    """What the last line of this label says; null if there is none or it is blank."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x.startswith(f"{name}:"))
    return F.nullif(F.trim(F.substring(F.try_element_at(lines, F.lit(-1)), F.lit(len(name) + 2), F.lit(1 << 30))), F.lit(""))


def keywords(x: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(x, "[;,|]"), lambda k: F.trim(k)), lambda k: k != ""))


def parse_generated(answers: DataFrame) -> DataFrame:
    """Name, description and keywords of generated answers (id, answer), with what is wrong in `error` in place of an exception."""
    text = S.strip_think(F.col("answer"))
    rows = answers.select("id", labelled(text, "Merchant").alias("name"), labelled(text, "Merchant_description").alias("description"), keywords(labelled(text, "Memory_keywords")).alias("_k"))
    lost = F.col("name").isNull() | F.col("description").isNull() | F.col("_k").isNull()
    error = F.when(lost, "missing field").when(~F.size("_k").between(3, 5), "keywords").when(S.has_cjk(F.concat_ws(" ", "name", "description", F.array_join("_k", " "))), "ideographs")
    return rows.select("id", "name", "description", F.array_join("_k", "; ").alias("keywords"), error.alias("error"))


def concept_memory(rows: DataFrame) -> DataFrame:
    """`name: keywords` of the last valid answer of each id (rows: id, seq, answer)."""
    good = parse_generated(rows.select(F.struct("id", "seq").alias("id"), "answer")).where("error IS NULL")
    return good.groupBy(F.col("id.id").alias("id")).agg(F.max_by(F.concat("name", F.lit(": "), "keywords"), "id.seq").alias("concept"))


#: Merchants of a category that one task writes in a row, behind one text of all names before them.
BLOCK_NAMES = 1_000


def running_concepts(dim: DataFrame, most: int | None = None, block: int = BLOCK_NAMES) -> DataFrame:
    """The names of earlier merchants of the same category, one a line, before each merchant by id; the last `most` of them, if given.

    All names are as many as the square of a category's merchants, so the result is. What is shuffled is not: merchants lie in blocks of `block`, a block
    meets the text of the blocks before it once, and blocks of a category are written by different tasks.
    """
    line, group = F.concat(F.lit("- "), "name"), ["level1", "level2"]
    if most:
        return dim.select("target", F.array_join(F.collect_list(line).over(W(*group).orderBy("target").rowsBetween(-most, -1)), "\n").alias("existing_concepts"))
    placed = running_counts(dim.select("target", F.struct(*group).alias("_key"), line.alias("_line")), "_key", ["target"], {"_i": F.lit(True)})
    placed = cut_lineage(placed.select("target", "_key", "_line", "_i", F.floor((F.col("_i") - 1) / block).alias("_b")))
    text = F.transform(F.array_sort(F.collect_list(F.when(F.col("_line").isNotNull(), F.struct("_i", "_line")))), lambda x: x["_line"])
    texts = placed.groupBy("_key", "_b").agg(text.alias("_t")).select("_key", "_b", F.when(F.size("_t") > 0, F.array_join("_t", "\n")).alias("_t"))
    before = texts.select(F.col("_key").alias("_h"), F.col("_b").alias("_c"), F.collect_list("_t").over(W("_key").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    before = before.select("_h", "_c", F.when(F.size("_before") > 0, F.array_join("_before", "\n")).alias("_before"))
    # A count of parts keeps them apart: by what is shuffled they would be merged into a task or two, which then write all texts.
    parts = 2 * int(dim.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = placed.repartition(parts, "_key", "_b").withColumn("_own", F.collect_list("_line").over(W("_key", "_b").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.join(before, (F.col("_key") == F.col("_h")) & (F.col("_b") == F.col("_c")), "left")
    return rows.select("target", F.array_join(F.concat(F.array("_before"), "_own"), "\n").alias("existing_concepts"))


def accept_renames(used: DataFrame, proposals: DataFrame) -> DataFrame:
    """Proposed names (id, name) that no one has and that come first of their kind."""
    p = proposals.withColumn("norm", S.normalize_name(F.col("name"))).where("norm <> ''")
    free = p.join(used.select(S.normalize_name(F.col("name")).alias("norm")).distinct(), "norm", "left_anti")
    return free.withColumn("_r", F.row_number().over(W("norm").orderBy("id"))).where("_r = 1").select("id", "name")


def json_answer(x: Column, field: str) -> Column:
    """A field of a JSON answer, in a code fence or not."""
    return F.get_json_object(F.trim(F.regexp_replace(F.trim(S.strip_think(x)), "^```(?:json)?|```$", "")), f"$.{field}")


def audit_reason(fraud: Column, rate: Column, dims: Column, old_fit: Column, new_fit: Column, old_risk: Column, new_risk: Column) -> Column:
    a = F.when(fraud > 0, F.concat(F.lit("fraud_rate_labeled="), S.fixed(F.coalesce(rate, F.lit(0.0)), 3), F.lit(", fraud_count="), fraud.cast("string")))
    b = F.when(dims > 0, F.concat(F.lit("residual_dims="), dims.cast("string")))
    c = F.concat(F.lit("fit "), S.fixed(old_fit, 3), F.lit("->"), S.fixed(new_fit, 3), F.lit(", risk "), S.fixed(old_risk, 3), F.lit("->"), S.fixed(new_risk, 3))
    return F.concat_ws("; ", a, b, c)


def answers(spark: SparkSession, d: str) -> DataFrame:
    """Texts as a model may answer, right and wrong (made of the given merchants)."""
    k = F.col("p_partkey")
    words = F.when(k % 11 == 0, "one; two").when(k % 13 == 0, "a, b | c; d, e; f").otherwise(F.concat(F.lit("shop; "), F.col("p_brand"), F.lit(", "), F.col("p_type"), F.lit(" | shop")))
    text = F.concat(F.when(k % 3 == 0, "<think>Merchant: no\n</think>").otherwise(""), F.lit("Merchant: "), F.when(k % 17 == 0, "店").otherwise(F.col("p_name")), F.lit(" "), k.cast("string"), F.lit("\n  Merchant_description:  Sells: "), F.col("p_name"), F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("\nMemory_keywords: "), words)))
    return table(spark, d, "part").select(k.alias("id"), text.alias("answer"))


ANSWERS = """aw AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN '<think>Merchant: no' || chr(10) || '</think>' ELSE '' END || 'Merchant: ' || CASE WHEN p_partkey % 17 = 0 THEN '店' ELSE p_name END || ' ' || p_partkey || chr(10) || '  Merchant_description:  Sells: ' || p_name ||
    CASE WHEN p_partkey % 7 = 0 THEN '' ELSE chr(10) || 'Memory_keywords: ' || CASE WHEN p_partkey % 11 = 0 THEN 'one; two' WHEN p_partkey % 13 = 0 THEN 'a, b | c; d, e; f' ELSE 'shop; ' || p_brand || ', ' || p_type || ' | shop' END END AS answer FROM part)"""
_LINE = "nullif(trim(substr(list_filter(list_transform(string_split(trim(regexp_replace(answer, '(?is)<think>.*?</think>', '', 'g')), chr(10)), lambda x: trim(x)), lambda x: starts_with(x, '{0}:'))[-1], {1})), '')"
PARSED = f"""pz AS (SELECT *, {_LINE.format("Merchant", 10)} AS name, {_LINE.format("Merchant_description", 22)} AS description, {_LINE.format("Memory_keywords", 17)} AS kw FROM aw),
    py AS (SELECT *, list_filter(list_transform(string_split_regex(kw, '[;,|]'), lambda x: trim(x)), lambda x: x <> '') AS k0 FROM pz), px AS (SELECT *, list_filter(k0, lambda x, i: list_position(k0, x) = i) AS k FROM py),
    pr AS (SELECT *, array_to_string(k, '; ') AS keywords, CASE WHEN name IS NULL OR description IS NULL OR kw IS NULL THEN 'missing field' WHEN len(k) NOT BETWEEN 3 AND 5 THEN 'keywords' WHEN regexp_matches(name || description, '[\\x{{3400}}-\\x{{4dbf}}\\x{{4e00}}-\\x{{9fff}}]') THEN 'ideographs' END AS error FROM px)"""


def queries() -> dict:
    ev, li = txn_ev, txn_li
    part = lambda s, d: table(s, d, "part").select(F.col("p_partkey").alias("target"), F.col("p_type").alias("level1"), F.col("p_brand").alias("level2"), F.col("p_name").alias("name"))
    utp = f"ut AS (SELECT * FROM ({user_text_sql()}))"
    sentence = " || '; ' || ".join(f"'{n}: ' || {c}" for n, c in (("Province", "province"), ("Gender", "gender"), ("Age group", "age_group"), ("Education", "education"), ("Occupation", "occupation"), ("Spending level", "amount_preference"), ("Frequency", "frequency"), ("Weekly pattern", "week")))
    ch = lambda k: f"(SELECT {k}, avg((is_out AND o)::INT) AS online, avg((is_out AND NOT o)::INT) AS remote FROM (SELECT *, regexp_matches(lower(level1 || ' ' || level2), 'online|internet|software|gaming|digital|promo') AS o FROM de) GROUP BY 1)"
    top = lambda k, v, src, n=3: f"(SELECT {k}, list({v} ORDER BY r) AS top FROM (SELECT {k}, {v}, row_number() OVER (PARTITION BY {k} ORDER BY count(*) DESC, {v}) AS r FROM {src} GROUP BY {k}, {v}) WHERE r <= {n} GROUP BY {k})"
    det = "CASE p_brand " + " ".join(f"WHEN '{k}' THEN {list(v)}" for k, v in DETAILS.items()) + " ELSE [p_brand] END"
    kw = lambda f: "CASE " + " ".join(f"WHEN {' OR '.join(f(k) for k in keys)} THEN '{n}'" for n, keys in KEYWORDS) + " END"
    tok = "t AS (SELECT DISTINCT o_custkey AS source, o_orderpriority AS token FROM orders)"
    ind = "i(token, industry, n) AS (VALUES " + ", ".join(f"('{k}', '{x}', {len(v)})" for k, v in INDUSTRIES.items() for x in v) + ")"
    mix = f"WITH {tok}, {ind}, m AS (SELECT source, industry, sum(1.0::DOUBLE / n) AS w FROM t JOIN i USING (token) GROUP BY 1, 2), x AS (SELECT source, industry, w / sum(w) OVER (PARTITION BY source) AS share FROM m)"
    tokens = lambda s, d: table(s, d, "orders").groupBy(F.col("o_custkey").alias("source")).agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), "|").alias("tokens"))
    cdist = f"WITH {LI}, c AS (SELECT level1, level2, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY level1) AS share FROM li GROUP BY 1, 2)"
    dist = lambda s, d: li(s, d).groupBy("level1", "level2").agg(F.count(one).alias("n")).withColumn("share", F.col("n") / F.sum("n").over(W("level1"))).groupBy("level1").agg(F.collect_list(F.struct(F.concat(F.lit("b:"), "level2").alias("key"), "share")).alias("e"))
    wide = lambda s, d: table(s, d, "customer").groupBy("c_nationkey").agg(*[F.avg((F.col("c_mktsegment") == v).cast("int")).alias(v.lower()) for v in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")])
    segs = ["automobile", "building", "furniture", "household", "machinery"]
    wsql = "w AS (SELECT c_nationkey, " + ", ".join(f"avg((c_mktsegment = '{x.upper()}')::INT) AS {x}" for x in segs) + " FROM customer GROUP BY 1)"
    messy = {0: "' 7.5 '", 1: "''", 2: "'x'", 3: "'nan'", 4: "'12'"}
    messy_sql = "CASE seq % 5 " + " ".join(f"WHEN {k} THEN {v}" for k, v in messy.items()) + " END"
    messy_col = lambda: F.coalesce(*[F.when(F.pmod(F.col("seq"), F.lit(5)) == k, v.strip("'")) for k, v in messy.items()])
    return {
        "template_text": (lambda s, d: template_text(described(s, d)), f"WITH {EV}, {USERS}, {DESCRIBED} {TEMPLATE_SQL}"),
        "publish_user_description": (lambda s, d: template_text(described(s, d)).join(ev(s, d).groupBy("source").agg(F.min("seq").alias("seq")), "seq").select(F.col("source").cast("string").alias("Source_id"), F.col("description").alias("Source_description")), f"WITH {EV}, {USERS}, {DESCRIBED}, t AS ({TEMPLATE_SQL}) SELECT source::VARCHAR AS Source_id, description AS Source_description FROM t JOIN (SELECT source, min(seq) AS seq FROM ev GROUP BY 1) USING (seq)"),
        "user_sentence": (user_sentence, f"WITH {EV}, {USERS}, {utp} SELECT source, {sentence} || '.' AS basic_profile FROM ut JOIN us USING (source)"),
        "user_profile_json": (user_records, f"""WITH {EV}, {USERS}, {DESCRIBED}, {utp} SELECT source, to_json({{'Source_id': source::VARCHAR, 'user_attributes': {{'Province': province, 'Gender': gender, 'Age': age_group, 'Education': education, 'Occupation': occupation}},
            'transaction_profile': {{'amount_level': amount_preference, 'amount_volatility': amount_volatility, 'transaction_frequency': frequency, 'intraday_pattern': intraday, 'weekly_pattern': week, 'monthly_pattern': month, 'channel_tendency': {CHANNEL_SQL}}}, 'spending_preferences': {{'preferred_categories': top}}}})::VARCHAR AS line
            FROM ut JOIN us USING (source) JOIN {ch("source")} USING (source) JOIN {top("source", "level1", "de")} USING (source)"""),
        "merchant_text_profile": (merchant_records, f"""WITH {EV}, {USERS}, {DESCRIBED}, em AS (SELECT * REPLACE (target AS source) FROM ev), mt AS (SELECT source AS target, * EXCLUDE (source) FROM ({user_text_sql(least=1).replace(f"WITH {EV}", "WITH ev AS (SELECT * FROM em)")})),
            uu AS (SELECT DISTINCT target, source, gender, occupation FROM de) SELECT p_partkey AS target, to_json({{'Target_id': p_partkey::VARCHAR, 'merchant_category': {{'MCC_level1': p_type, 'MCC_level2': p_brand, 'fine_grained_candidates': {det}}},
            'transaction_profile': {{'amount_level': coalesce(amount_preference, 'No transactions'), 'amount_volatility': coalesce(amount_volatility, 'No transactions'), 'transaction_frequency': coalesce(frequency, 'low frequency'), 'weekly_pattern': coalesce(week, 'No transactions'), 'monthly_pattern': coalesce(month, 'No transactions'), 'channel_tendency': {CHANNEL_SQL}}},
            'associated_user_profile': {{'dominant_gender': coalesce(array_to_string(g.top, ', '), 'No valid observations'), 'occupation_top3': coalesce(array_to_string(o.top, ', '), 'No valid observations')}}}})::VARCHAR AS line
            FROM part LEFT JOIN mt ON mt.target = p_partkey LEFT JOIN {ch("target")} c ON c.target = p_partkey LEFT JOIN {top("target", "gender", "uu", 1)} g ON g.target = p_partkey LEFT JOIN {top("target", "occupation", "uu")} o ON o.target = p_partkey"""),
        "single_context_json": (single_contexts, f"""WITH {EV}, {USERS}, {DESCRIBED} SELECT seq, to_json({{'Source_id': source || '-' || target, 'raw_source_fields': {{'province': province, 'gender': gender}}, 'raw_transaction_fields': {{'seq': seq, 'at': strftime(datetime, '%Y-%m-%dT%H:%M:%S'), 'note': NULL}}, 'raw_target_fields': {{'level1': level1, 'level2': level2}}}})::VARCHAR AS line FROM de WHERE label = 1 QUALIFY count(*) OVER (PARTITION BY source, target) = 1"""),
        "scalar_json_safe": (lambda s, d: ev(s, d).select("seq", F.to_json(F.struct("seq", F.date_format("datetime", "yyyy-MM-dd'T'HH:mm:ss").alias("at"), F.when(F.col("label") == 1, "fraud").alias("kind")), {"ignoreNullFields": "false"}).alias("line")), f"WITH {EV} SELECT seq, to_json({{'seq': seq, 'at': strftime(datetime, '%Y-%m-%dT%H:%M:%S'), 'kind': CASE WHEN label = 1 THEN 'fraud' END}})::VARCHAR AS line FROM ev"),
        "detail_candidates": (lambda s, d: details(part(s, d)).select("target", "level2", F.array_join("candidates", "; ").alias("candidates")), f"SELECT p_partkey AS target, p_brand AS level2, array_to_string({det}, '; ') AS candidates FROM part"),
        "keyword_match": (lambda s, d: part(s, d).select("target", first_keyword(F.col("name")).alias("part_of"), first_keyword(F.col("name"), True).alias("word")), f"SELECT p_partkey AS target, {kw(lambda k: f'contains(p_name, {chr(39)}{k}{chr(39)})')} AS part_of, {kw(lambda k: f'list_contains(string_split(p_name, {chr(39)} {chr(39)}), {chr(39)}{k}{chr(39)})')} AS word FROM part"),
        "occupation_mix": (lambda s, d: occupation_mix(tokens(s, d)), f"{mix} SELECT * FROM x"),
        "occupation_top3": (lambda s, d: occupation_mix(tokens(s, d)).withColumn("_r", F.row_number().over(W("source").orderBy(F.desc(F.round("share", 9)), "industry"))).where("_r <= 3").groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "industry"))), lambda x: x["industry"]), "|").alias("top3")), f"{mix} SELECT source, string_agg(industry, '|' ORDER BY r) AS top3 FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(share, 9) DESC, industry) AS r FROM x) WHERE r <= 3 GROUP BY 1"),
        "scalar_hours_list": (lambda s, d: ev(s, d).groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.hour("datetime"))), lambda h: h.cast("string")), ",").alias("hours")).select("source", "hours", F.size(F.array_intersect(hours_array(F.col("hours")), hours_array(F.lit(hours_text((7, 8), (11, 13), (17, 21)))))).alias("active")), f"WITH {EV}, h AS (SELECT source, list_sort(list_distinct(list(hour(datetime)::INT))) AS l FROM ev GROUP BY 1) SELECT source, array_to_string(l, ',') AS hours, len(list_intersect(l, [7, 8, 11, 12, 13, 17, 18, 19, 20, 21]))::INT AS active FROM h"),
        "scalar_distribution_text": (lambda s, d: dist(s, d).select("level1", distribution_text(F.col("e")).alias("text")), f"{cdist} SELECT level1, string_agg('b:' || level2 || ':' || {S.fixed_sql('share', 4)}, '|' ORDER BY share DESC, level2) AS text FROM c GROUP BY 1"),
        "scalar_distribution_map": (lambda s, d: dist(s, d).select("level1", F.explode(distribution_map(F.concat(distribution_text(F.col("e")), F.lit("|bad|:0.3|worse:x")))).alias("key", "share")), f"{cdist} SELECT level1, 'b:' || level2 AS key, {S.fixed_sql('share', 4)}::DOUBLE / sum({S.fixed_sql('share', 4)}::DOUBLE) OVER (PARTITION BY level1) AS share FROM c"),
        "scalar_pct_label": (lambda s, d: li(s, d).groupBy("level1").agg(F.count(one).alias("n")).select("level1", F.concat("level1", F.lit("("), percent_text(F.col("n") / F.sum("n").over(W(F.lit(0)))), F.lit(")")).alias("label")), f"WITH {LI}, c AS (SELECT level1, count(*)::DOUBLE / sum(count(*)) OVER () AS s FROM li GROUP BY 1) SELECT level1, level1 || '(' || {percent_text_sql('s')} || ')' AS label FROM c"),
        "scalar_channel_text": (lambda s, d: channels(described(s, d), "source").select("source", channel_text(F.col("online"), F.col("remote")).alias("channel")), f"WITH {EV}, {USERS}, {DESCRIBED} SELECT source, {CHANNEL_SQL} AS channel FROM {ch('source')}"),
        "scalar_audit_reason": (lambda s, d: ev(s, d).groupBy("target").agg(F.count_if(F.col("label") == 1).alias("f"), F.count_if(F.col("label") != 2).alias("k"), F.count(one).alias("n")).select("target", audit_reason(F.col("f"), F.try_divide("f", "k"), F.col("n") % 3, F.lit(0.25), 1 / F.col("n"), F.lit(0.5), F.col("n") / 1024).alias("reason")),
            f"WITH {EV}, g AS (SELECT target, count(*) FILTER (label = 1) AS f, count(*) FILTER (label <> 2) AS k, count(*) AS n FROM ev GROUP BY 1) SELECT target, concat_ws('; ', CASE WHEN f > 0 THEN 'fraud_rate_labeled=' || {S.fixed_sql('coalesce(f::DOUBLE / nullif(k, 0), 0)', 3)} || ', fraud_count=' || f END, CASE WHEN n % 3 > 0 THEN 'residual_dims=' || n % 3 END, 'fit 0.250->' || {S.fixed_sql('1.0::DOUBLE / n', 3)} || ', risk 0.500->' || {S.fixed_sql('n / 1024.0::DOUBLE', 3)}) AS reason FROM g"),
        "scalar_dominant": (lambda s, d: wide(s, d).select("c_nationkey", S.dominant(*segs).alias("dominant")), f"WITH {wsql} SELECT c_nationkey, CASE greatest({', '.join(segs)}) {' '.join(f'WHEN {x} THEN {chr(39)}{x}{chr(39)}' for x in segs)} END AS dominant FROM w"),
        "prior_long": (lambda s, d: wide(s, d).unpivot("c_nationkey", segs, "value", "prob"), f"WITH {wsql} SELECT c_nationkey, unnest([{', '.join(chr(39) + x + chr(39) for x in segs)}]) AS value, unnest([{', '.join(segs)}]) AS prob FROM w"),
        "prior_struct": (lambda s, d: wide(s, d).select("c_nationkey", F.to_json(F.struct(F.floor(F.col("building") * 100).cast("int").alias("building"), F.struct(F.when(F.col("household") >= 0.2, "high").otherwise("low").alias("household"), hours_array(F.lit("8,9,10")).alias("hours")).alias("habits"))).alias("prior")), f"WITH {wsql} SELECT c_nationkey, to_json({{'building': floor(building * 100)::INT, 'habits': {{'household': CASE WHEN household >= 0.2 THEN 'high' ELSE 'low' END, 'hours': [8, 9, 10]}}}})::VARCHAR AS prior FROM w"),
        "scalar_defaults": (lambda s, d: ev(s, d).withColumn("raw", messy_col()).select("seq", clean_text(F.col("raw")).alias("text"), F.coalesce(F.nullif(F.trim("raw").try_cast("double"), F.lit(float("nan"))), F.lit(-1.0)).alias("number"), clean_text(F.col("raw"), "Not provided").alias("field")), f"WITH {EV}, r AS (SELECT seq, {messy_sql} AS raw FROM ev) SELECT seq, CASE WHEN trim(raw) IN ('', 'nan') THEN 'Unknown' ELSE trim(raw) END AS text, CASE WHEN trim(raw) = 'nan' THEN -1.0 ELSE coalesce(try_cast(trim(raw) AS DOUBLE), -1.0) END AS number, CASE WHEN trim(raw) IN ('', 'nan') THEN 'Not provided' ELSE trim(raw) END AS field FROM r"),
        "model_input_fields": (lambda s, d: table(s, d, "documents").select("doc_id", *[clean_text(F.when(F.col("doc_id") % 9 == i, " ").otherwise(F.col(c)), "Not provided").alias(c) for i, c in enumerate(("lang", "source"))]), "SELECT doc_id, CASE WHEN doc_id % 9 = 0 OR lang IS NULL THEN 'Not provided' ELSE trim(lang) END AS lang, CASE WHEN doc_id % 9 = 1 OR source IS NULL THEN 'Not provided' ELSE trim(source) END AS source FROM documents"),
        "parse_generated": (lambda s, d: parse_generated(answers(s, d)), f"WITH {ANSWERS}, {PARSED} SELECT id, name, description, keywords, error FROM pr"),
        "concept_memory": (lambda s, d: concept_memory(answers(s, d).select((F.col("id") % 20).alias("id"), F.col("id").alias("seq"), "answer")), f"WITH {ANSWERS}, {PARSED} SELECT id % 20 AS id, arg_max(name || ': ' || keywords, pr.id) AS concept FROM pr WHERE error IS NULL GROUP BY pr.id % 20"),
        "scalar_parse_json_answer": (lambda s, d: part(s, d).select("target", json_answer(F.concat(F.when(F.col("target") % 2 == 0, "```json\n").otherwise("<think>x</think> "), F.to_json(F.struct(F.col("name").alias("new_merchant"))), F.when(F.col("target") % 2 == 0, "\n```").otherwise("")), "new_merchant").alias("name"), json_answer(F.concat(F.lit("no json "), "name"), "new_merchant").alias("none")), "SELECT p_partkey AS target, p_name AS name, NULL AS none FROM part"),
        "running_concepts": (lambda s, d: running_concepts(part(s, d)), "SELECT p_partkey AS target, coalesce(string_agg('- ' || p_name, chr(10) ORDER BY p_partkey) OVER (PARTITION BY p_type, p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS existing_concepts FROM part"),
        "accept_renames": (lambda s, d: accept_renames(part(s, d), part(s, d).select(F.col("target").alias("id"), F.when(F.col("target") % 3 == 0, F.col("name")).otherwise(F.concat("name", F.lit(" - "), (F.col("target") % 5).cast("string"))).alias("name"))), r"WITH p AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_name || ' - ' || p_partkey % 5 END AS name FROM part), n AS (SELECT *, regexp_replace(lower(trim(name)), '[^\p{L}\p{N}]+', '', 'g') AS norm FROM p) SELECT id, name FROM n WHERE norm NOT IN (SELECT regexp_replace(lower(trim(p_name)), '[^\p{L}\p{N}]+', '', 'g') FROM part) QUALIFY row_number() OVER (PARTITION BY norm ORDER BY id) = 1"),
    }
