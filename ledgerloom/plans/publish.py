"""The descriptions of the publication: one text a user and a merchant, what they contain and what they must not break."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.views import EV, table, txn_ev
from . import texts
from .contracts import digest32, published

one = "*"
#: Each part of a merchant's description: what stands before it, and where the merchant's profile has it.
PARTS = [
    ("The merchant belongs to ", "merchant_category.MCC_level2"), (" (", "merchant_category.MCC_level1"), ("). Its amounts are ", "transaction_profile.amount_level"), (", with volatility ", "transaction_profile.amount_volatility"),
    (" and ", "transaction_profile.transaction_frequency"), (". By week: ", "transaction_profile.weekly_pattern"), ("; by month: ", "transaction_profile.monthly_pattern"), ("; by channel: ", "transaction_profile.channel_tendency"),
    (". Most of its customers: ", "associated_user_profile.dominant_gender"), ("; they work in ", "associated_user_profile.occupation_top3"),
]


def merchant_descriptions(spark: SparkSession, d: str) -> DataFrame:
    """(Target, Merchant_description): the merchant's profile in sentences. The texts of the published set come from a model and may replace these."""
    part = lambda path: F.get_json_object("line", f"$.{path}")
    text = F.concat(*[x for lead, path in PARTS for x in (F.lit(lead), part(path))], F.lit("."))
    return texts.merchant_records(spark, d).select(F.col("target").cast("string").alias("Target"), text.alias("Merchant_description"))


def user_descriptions(spark: SparkSession, d: str) -> DataFrame:
    """(Source, User_description): the sentence of each user's first transaction."""
    first = txn_ev(spark, d).groupBy("source").agg(F.min("seq").alias("seq"))
    return texts.template_text(texts.described(spark, d)).join(first, "seq").select(F.col("source").cast("string").alias("Source"), F.col("description").alias("User_description"))


def description_violations(table_name: str, described: DataFrame, key: str, text: str, dimension: DataFrame) -> DataFrame:
    """How many keys or rows break each rule: a key with two texts, no text, ideographs, a key that the dimension has not, one that has no text row."""
    rule = lambda name, df: df.agg(F.lit(f"{table_name}: {name}").alias("rule"), F.count(one).alias("n"))
    keys = dimension.select(F.col(dimension.columns[0]).cast("string").alias(key))
    out = rule("repeated key", described.groupBy(key).agg(F.count(one).alias("_k")).where("_k > 1"))
    out = out.unionByName(rule("empty", described.where(F.col(key).isNull() | (F.coalesce(F.trim(text), F.lit("")) == ""))))
    out = out.unionByName(rule("ideographs", described.where(S.has_cjk(F.col(text)))))
    out = out.unionByName(rule("not in dimension", described.select(key).join(keys, key, "left_anti")))
    return out.unionByName(rule("without description", keys.join(described, key, "left_anti")))


def five_tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return published(spark, d) | {"user_description": user_descriptions(spark, d), "merchant_description": merchant_descriptions(spark, d)}


def inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """A row a table: rows, columns, and a digest of all of a text table's rows (null for the others, which `publish_manifest` covers)."""
    digest = lambda t: F.coalesce(F.sum(digest32(*[F.col(c) for c in t.columns])), F.lit(0)).cast("string")
    rows = [t.agg(F.lit(n).alias("table"), F.count(one).alias("rows"), F.lit(", ".join(t.columns)).alias("columns"), (digest(t) if n.endswith("description") else F.lit(None).cast("string")).alias("digest")) for n, t in tables.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def queries() -> dict:
    profile = texts.queries()["merchant_text_profile"][1]
    text = " || ".join([x for lead, path in PARTS for x in (f"'{lead}'", f"json_extract_string(line, '$.{path}')")] + ["'.'"])
    shops = f"sd AS (SELECT target::VARCHAR AS Target, {text} AS Merchant_description FROM ({profile}))"
    people = f"ud AS (SELECT source::VARCHAR AS Source, description AS User_description FROM ({texts.queries()['template_text'][1]}) JOIN (SELECT source, min(seq) AS seq FROM ev GROUP BY 1) USING (seq))"
    d32 = lambda *c: "coalesce(sum(('0x' || substr(md5(concat_ws('|', " + ", ".join(f"coalesce({x}, '__NA__')" for x in c) + ")), 1, 8))::BIGINT), 0)::DECIMAL(38,0)::VARCHAR"
    counts = {"transaction": ("ev", "seq, source, target, amount, label, datetime"), "merchant": ("part", "target, merchant_name, behavior_level1, behavior_level2"), "user": ("customer", "source, province, attribute")}
    listed = " UNION ALL ".join([f"SELECT '{n}' AS \"table\", count(*) AS rows, '{c}' AS columns, NULL::VARCHAR AS digest FROM {t}" for n, (t, c) in counts.items()] + [f"SELECT '{n}', count(*), '{', '.join(c)}', {d32(*c)} FROM {t}" for n, t, c in (("user_description", "ud", ("Source", "User_description")), ("merchant_description", "sd", ("Target", "Merchant_description")))])
    han = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]"

    def broken(name: str, t: str, key: str, text: str, dim: str, dim_key: str) -> str:
        rules = {"repeated key": f"(SELECT {key} FROM {t} GROUP BY 1 HAVING count(*) > 1)", "empty": f"(SELECT 1 FROM {t} WHERE {key} IS NULL OR trim(coalesce({text}, '')) = '')", "ideographs": f"(SELECT 1 FROM {t} WHERE regexp_matches({text}, '{han}'))",
            "not in dimension": f"(SELECT 1 FROM {t} WHERE {key} NOT IN (SELECT {dim_key}::VARCHAR FROM {dim}))", "without description": f"(SELECT 1 FROM {dim} WHERE {dim_key}::VARCHAR NOT IN (SELECT {key} FROM {t}))"}
        return " UNION ALL ".join(f"SELECT '{name}: {k}' AS rule, count(*) AS n FROM {v} v" for k, v in rules.items())

    both = f"{broken('user_description', 'ud', 'Source', 'User_description', 'customer', 'c_custkey')} UNION ALL {broken('merchant_description', 'sd', 'Target', 'Merchant_description', 'part', 'p_partkey')}"
    return {
        "publish_merchant_description": (merchant_descriptions, f"WITH {shops} SELECT * FROM sd"),
        "publish_inventory": (lambda s, d: inventory(five_tables(s, d)), f"WITH {EV}, {shops}, {people} {listed}"),
        "description_violations": (lambda s, d: description_violations("user_description", user_descriptions(s, d), "Source", "User_description", table(s, d, "customer").select("c_custkey")).unionByName(description_violations("merchant_description", merchant_descriptions(s, d), "Target", "Merchant_description", table(s, d, "part").select("p_partkey"))), f"WITH {EV}, {shops}, {people} {both}"),
    }
