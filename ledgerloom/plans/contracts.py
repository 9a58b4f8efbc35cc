"""Sources and their checks, joins that report, snapshots before and after, publication and its contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..functions import scalars as S
from ..operators.order import global_rank
from ..sources.views import EV, LI, table, txn_ev, txn_li
from .profiles import exact_sum
from .refine import M_SQL, MP_SQL, P_SQL, S_SQL, merchant_proposals
from .time import calendar, calendar_sql

W = Window.partitionBy
one = "*"


def clean_header(df: DataFrame) -> DataFrame:
    """Column names without byte order mark and blanks."""
    return df.toDF(*[c.replace("﻿", "").strip() for c in df.columns])


def read_clean_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A CSV file with a header; cells stay text unless a schema is given."""
    reader = spark.read.option("header", True).option("encoding", "UTF-8").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
    return clean_header((reader.schema(schema) if schema else reader).csv(path))


def optional_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, or no rows of `schema` where there is none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def require_columns(df: DataFrame, names: list[str], what: str = "table") -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks {', '.join(missing)}")
    return df


def resume_pending(todo: DataFrame, done: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """Rows whose key has no result yet; with `most`, the first so many by key."""
    left = todo.join(done.select(key).distinct(), key, "left_anti")
    return left.orderBy(key).limit(most) if most else left


def left_join_suffix(left: DataFrame, right: DataFrame, key: str, suffix: str) -> DataFrame:
    """Left join; columns of `right` whose names clash get a suffix."""
    return left.join(right.select(key, *[F.col(c).alias(c + suffix if c in left.columns else c) for c in right.columns if c != key]), key, "left")


def merge_labels(facts: DataFrame, labels: DataFrame, key: str, names: tuple[str, ...] = ("isFraud", "label", "fraud", "target")) -> DataFrame:
    """Facts with the label of another table in place of their own: its first column of `names`, else its only other one; no label: 0."""
    others = [c for c in labels.columns if c != key]
    found = next((n for n in names if n in others), others[0] if len(others) == 1 else None)
    if found is None:
        raise ValueError(f"no label among {', '.join(others)}")
    return facts.drop("label").join(labels.select(key, F.col(found).alias("label")), key, "left").withColumn("label", F.coalesce("label", F.lit(0)))


def join_report(facts: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """What a many-to-one join would do: rows, rows without a match, keys that repeat in the dimension."""
    keys = dim.groupBy(key).agg(F.count(one).alias("_k"))
    return facts.groupBy(key).agg(F.count(one).alias("_n")).join(keys, key, "left").agg(
        F.sum("_n").alias("rows"), F.coalesce(F.sum(F.when(F.col("_k").isNull(), F.col("_n"))), F.lit(0)).alias("unmatched"), F.count_if(F.col("_k") > 1).alias("repeated"))


def one_to_one_violations(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that are not once on both sides, with how often they are."""
    count = lambda d, n: d.groupBy(key).agg(F.count(one).alias(n))
    both = count(left, "in_left").join(count(right, "in_right"), key, "full").na.fill(0, ["in_left", "in_right"])
    return both.where("in_left <> 1 OR in_right <> 1")


def affected(facts: DataFrame, changed: DataFrame, by: str, want: str) -> DataFrame:
    """Entities that have a transaction with a changed one."""
    return facts.join(changed.select(by).distinct(), by, "left_semi").select(want).distinct()


def overlay(computed: DataFrame, prior: DataFrame, key: str) -> DataFrame:
    """Values of the prior table where it has them, else the computed ones, column by column."""
    shared = [c for c in computed.columns if c != key]
    p = prior.select(key, *[F.col(c).alias(f"_{c}") for c in shared])
    return computed.join(p, key, "left").select(key, *[F.coalesce(f"_{c}", c).alias(c) for c in shared])


def apply_changes(dim: DataFrame, changes: DataFrame, key: str, field: str) -> DataFrame:
    """A dimension after changes (key, new); facts take its values when they are read, so no copy of them is rewritten."""
    new = changes.select(key, F.col("new").alias("_new"))
    return dim.join(new, key, "left").withColumn(field, F.coalesce("_new", field)).drop("_new")


def replace_rows(rows: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Rows with the values of their update; others, and columns that updates lack, stay."""
    own = [c for c in updates.columns if c != key]
    u = updates.select(key, *[F.col(c).alias(f"_{c}") for c in own])
    return rows.join(u, key, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in own else c for c in rows.columns])


def changed_rows(before: DataFrame, after: DataFrame, key: str, field: str) -> DataFrame:
    b = before.select(key, F.col(field).alias("old"))
    return b.join(after.select(key, F.col(field).alias("new")), key).where(~F.col("old").eqNullSafe(F.col("new")))


def share_change(before: DataFrame, after: DataFrame, group: str, value: str) -> DataFrame:
    """Counts, transactions and amounts a value of a group has before and after, and how its shares move. Rows: key, group, value, n, total."""

    def side(d: DataFrame, name: str) -> DataFrame:
        g = d.groupBy(group, value).agg(F.count(one).alias("k"), F.sum("n").alias("n"), F.sum("total").alias("a"))
        share = lambda c: F.col(c).cast("double") / F.sum(c).over(W(group)).cast("double")
        return g.select(group, value, F.col("k").alias(f"count_{name}"), F.col("n").alias(f"tx_{name}"), share("k").alias(f"count_share_{name}"), share("n").alias(f"tx_share_{name}"), share("a").alias(f"amount_share_{name}"))

    both = side(before, "before").join(side(after, "after"), [group, value], "full").na.fill(0)
    moved = lambda c: (F.col(f"{c}_after") - F.col(f"{c}_before")).alias(f"{c}_delta")
    return both.select("*", moved("count"), moved("count_share"), moved("amount_share"))


def level_limits(dim: DataFrame, rate: float = 0.08) -> DataFrame:
    """How many merchants of a level1 may change, and the share each level2 has in it."""
    k = dim.groupBy("level1", "level2").agg(F.count(one).alias("k"))
    n = F.sum("k").over(W("level1"))
    return k.select("level1", "level2", (F.col("k") / n).alias("share"), F.greatest(F.lit(1), F.floor(n * rate)).cast("long").alias("most_changes"))


def merchants_dim(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("target"), F.col("p_type").alias("level1"), F.col("p_brand").alias("level2"))


def sized_merchants(spark: SparkSession, d: str) -> DataFrame:
    stats = txn_li(spark, d).groupBy("target").agg(F.count(one).alias("n"), F.sum(F.col("amount").cast("decimal(18,4)")).alias("total"))
    return merchants_dim(spark, d).join(stats, "target", "left").na.fill(0, ["n"]).withColumn("total", F.coalesce("total", F.lit(0).cast("decimal(28,4)")))


def changed_dim(spark: SparkSession, d: str, dim: DataFrame) -> DataFrame:
    return apply_changes(dim, merchant_proposals(txn_li(spark, d)), "target", "level2")


def digest32(*columns: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("__NA__")) for c in columns])), 1, 8), 16, 10).cast("decimal(20,0)")


#: Published tables: key, and the columns that a manifest's digest covers.
PUBLISHED = {"transaction": ("seq", ["seq", "source", "target", "label"]), "merchant": ("target", ["target", "merchant_name", "behavior_level1", "behavior_level2"]), "user": ("source", ["source", "province", "attribute"])}


def published(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("province"))
    return {
        "transaction": txn_ev(spark, d).select("seq", "source", "target", "amount", "label", "datetime"),
        "merchant": table(spark, d, "part").select(F.col("p_partkey").alias("target"), F.col("p_name").alias("merchant_name"), F.col("p_type").alias("behavior_level1"), F.col("p_brand").alias("behavior_level2")),
        "user": table(spark, d, "customer").join(nation, "c_nationkey").select(F.col("c_custkey").alias("source"), "province", F.col("c_mktsegment").alias("attribute")),
    }


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """A row a published table: rows, columns and an order-free digest of its rows."""
    parts = [t.agg(F.lit(n).alias("table"), F.count(one).alias("rows"), F.lit(len(t.columns)).alias("columns"), F.coalesce(F.sum(digest32(*[F.col(c) for c in PUBLISHED[n][1]])), F.lit(0)).cast("string").alias("digest")) for n, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def contract_violations(tables: dict[str, DataFrame], raw: DataFrame) -> DataFrame:
    """How many rows of the published tables break each rule: repeated or null keys, keys of facts and dimensions that do not meet, names with
    ideographs, rows that differ from the raw ones of their order number."""
    tx, merchant, user = (tables[n] for n in ("transaction", "merchant", "user"))
    rule = lambda name, df: df.agg(F.lit(name).alias("rule"), F.count(one).alias("n"))
    out = [rule(f"{n}: repeated key", t.groupBy(PUBLISHED[n][0]).agg(F.count(one).alias("_k")).where("_k > 1")) for n, t in tables.items()]
    out += [rule(f"{n}: null", t.where(" OR ".join(f"{c} IS NULL" for c in t.columns))) for n, t in tables.items()]
    out += [rule(f"{k}: not in dimension", tx.select(k).distinct().join(t, k, "left_anti")) for k, t in (("source", user), ("target", merchant))]
    out += [rule(f"{k}: not in facts", t.select(k).join(tx.select(k), k, "left_anti")) for k, t in (("source", user), ("target", merchant))]
    out.append(rule("merchant: ideographs", merchant.where(S.has_cjk(F.col("merchant_name")))))
    pairs = tx.alias("p").join(raw.alias("r"), "seq", "full")
    same = F.lit(True)
    for c in ("source", "target", "amount", "label"):
        same = same & F.col(f"p.{c}").eqNullSafe(F.col(f"r.{c}"))
    out.append(rule("transaction: differs from raw", pairs.where(~same)))
    total = out[0]
    for p in out[1:]:
        total = total.unionByName(p)
    return total


def snapshot(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: how many rows and an order-free digest of each column with its key."""
    return df.agg(F.count(one).alias("rows"), *[F.coalesce(F.sum(digest32(F.col("seq"), F.col(c))), F.lit(0)).cast("string").alias(c) for c in columns])


def frozen_check(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """Whether each frozen column is the same in both states of the facts, by digests of whole columns."""
    b, a = snapshot(before, columns), snapshot(after, columns).toDF("_rows", *[f"_{c}" for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), (F.col(c) == F.col(f"_{c}")).alias("same")) for c in ["rows", *columns]])
    return b.join(F.broadcast(a)).select(F.inline(rows))  # one row each


def queries() -> dict:
    li, ev = txn_li, txn_ev
    docs = lambda s, d: table(s, d, "documents")
    labels = lambda s, d: table(s, d, "labels")
    people = lambda s, d: table(s, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(one).alias("people"), exact_sum(F.col("c_acctbal")).alias("funds"))
    prior = lambda s, d: table(s, d, "nation").where("n_regionkey = 0").select("n_nationkey", (F.col("n_nationkey") * 10).cast("long").alias("people"), F.when(F.col("n_nationkey") > 5, 1.5).alias("funds"))
    proposals = f"{M_SQL}, {P_SQL}, {S_SQL}, {MP_SQL}"
    dim_sql = "dm AS (SELECT p_partkey AS target, p_type AS level1, p_brand AS level2 FROM part), da AS (SELECT dm.target, dm.level1, coalesce(mp.new, level2) AS level2 FROM dm LEFT JOIN mp ON mp.target = dm.target)"
    money_text = lambda: F.when(F.col("event_type") == "error", "n/a").otherwise(F.concat(F.lit("￥"), F.format_string("%,d", F.floor("value").cast("long")), F.lit(".50")))
    side = lambda t, n: f"{n} AS (SELECT level1, level2, count(*) AS k, sum(n)::BIGINT AS nt, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY level1) AS ks, sum(n)::DOUBLE / sum(sum(n)) OVER (PARTITION BY level1) AS ns, sum(total)::DOUBLE / (sum(sum(total)) OVER (PARTITION BY level1))::DOUBLE AS as_ FROM (SELECT {t}.*, coalesce(st.n, 0) AS n, coalesce(st.total, 0) AS total FROM {t} LEFT JOIN st USING (target)) GROUP BY 1, 2)"
    rules = {
        "transaction: repeated key": "(SELECT seq FROM ev GROUP BY 1 HAVING count(*) > 1)", "merchant: repeated key": "(SELECT p_partkey FROM part GROUP BY 1 HAVING count(*) > 1)", "user: repeated key": "(SELECT c_custkey FROM customer GROUP BY 1 HAVING count(*) > 1)",
        "transaction: null": "(SELECT 1 FROM ev WHERE seq IS NULL OR source IS NULL OR target IS NULL OR amount IS NULL OR label IS NULL OR datetime IS NULL)", "merchant: null": "(SELECT 1 FROM part WHERE p_partkey IS NULL OR p_name IS NULL OR p_type IS NULL OR p_brand IS NULL)", "user: null": "(SELECT 1 FROM customer WHERE c_custkey IS NULL OR c_mktsegment IS NULL)",
        "source: not in dimension": "(SELECT DISTINCT source FROM ev WHERE source NOT IN (SELECT c_custkey FROM customer))", "target: not in dimension": "(SELECT DISTINCT target FROM ev WHERE target NOT IN (SELECT p_partkey FROM part))",
        "source: not in facts": "(SELECT 1 FROM customer WHERE c_custkey NOT IN (SELECT source FROM ev))", "target: not in facts": "(SELECT 1 FROM part WHERE p_partkey NOT IN (SELECT target FROM ev))",
        "merchant: ideographs": r"(SELECT 1 FROM part WHERE regexp_matches(p_name, '[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]'))",
        "transaction: differs from raw": "(SELECT 1 FROM ev WHERE seq % 50 = 0 AND NOT amount IS NOT DISTINCT FROM amount + 1)",
    }
    d32 = lambda *c: "sum(('0x' || substr(md5(concat_ws('|', " + ", ".join(f"coalesce({x}::VARCHAR, '__NA__')" for x in c) + ")), 1, 8))::BIGINT)::DECIMAL(38,0)::VARCHAR"
    changed_raw = lambda s, d: ev(s, d).withColumn("amount", F.when(F.col("seq") % 50 == 0, F.col("amount") + 1).otherwise(F.col("amount")))
    return {
        "scan_clean": (lambda s, d: clean_header(table(s, d, "nation").toDF("﻿n_nationkey", " n_name ", "n_regionkey\t")), "SELECT * FROM nation"),
        "prior_fallback": (lambda s, d: overlay(people(s, d), optional_table(s, f"{d}/no_such_prior.parquet", "n_nationkey int, people long, funds double"), "n_nationkey"), "SELECT c_nationkey AS n_nationkey, count(*) AS people, sum(c_acctbal::DECIMAL(18,4))::DOUBLE AS funds FROM customer GROUP BY 1"),
        "prior_overlay": (lambda s, d: overlay(people(s, d), prior(s, d), "n_nationkey"), """WITH c AS (SELECT c_nationkey AS n_nationkey, count(*) AS people, sum(c_acctbal::DECIMAL(18,4))::DOUBLE AS funds FROM customer GROUP BY 1), p AS (SELECT n_nationkey, n_nationkey * 10 AS people, CASE WHEN n_nationkey > 5 THEN 1.5 END AS funds FROM nation WHERE n_regionkey = 0)
            SELECT c.n_nationkey, coalesce(p.people, c.people)::BIGINT AS people, coalesce(p.funds, c.funds)::DOUBLE AS funds FROM c LEFT JOIN p USING (n_nationkey)"""),
        "jsonl_flatten": (lambda s, d: table(s, d, "conversations").select(F.to_json(F.struct(F.struct("conv_id", "turn").alias("place"), F.struct("role", F.length("text").alias("chars")).alias("message"))).alias("line"))
            .select(F.from_json("line", "place struct<conv_id: long, turn: long>, message struct<role: string, chars: int>").alias("r"), "line").select("r.place.conv_id", "r.place.turn", "r.message.role", "r.message.chars", F.md5("line").alias("line_md5")),
            """SELECT conv_id, turn, role, length(text)::INT AS chars, md5('{"place":{"conv_id":' || conv_id || ',"turn":' || turn || '},"message":{"role":"' || role || '","chars":' || length(text) || '}}') AS line_md5 FROM conversations"""),
        "time_variants_core": (lambda s, d: calendar(ev(s, d)).select("seq", "source", "target", "amount", "label", "datetime"), f"WITH {EV} SELECT seq, source, target, amount, label, datetime FROM ev"),
        "time_variants_detail": (lambda s, d: calendar(ev(s, d)).select("seq", "date", "hour", "dayofweek", "is_weekend", "is_common_bill_day", "period_tag"), f"WITH {EV}, t AS ({calendar_sql()}) SELECT seq, date, hour, dayofweek, is_weekend, is_common_bill_day, period_tag FROM t"),
        "resume_pending": (lambda s, d: resume_pending(docs(s, d), labels(s, d), "doc_id").select("doc_id", "source"), "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
        "clean_amounts": (lambda s, d: table(s, d, "events").select("event_id", "user_id", money_text().alias("raw")).withColumn("amount", S.money(F.col("raw"))).na.drop(subset=["user_id", "amount"]), "SELECT event_id, user_id, '￥' || format('{:,}', floor(value)::BIGINT) || '.50' AS raw, floor(value) + 0.5::DOUBLE AS amount FROM events WHERE event_type <> 'error'"),
        "merge_identity": (lambda s, d: left_join_suffix(table(s, d, "orders").select(F.col("o_custkey").alias("source"), "o_orderkey", F.col("o_orderpriority").alias("kind")), table(s, d, "customer").select(F.col("c_custkey").alias("source"), F.col("c_mktsegment").alias("kind"), "c_name"), "source", "_identity"),
            "SELECT o_custkey AS source, o_orderkey, o_orderpriority AS kind, c_mktsegment AS kind_identity, c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey"),
        "merge_labels": (lambda s, d: merge_labels(docs(s, d).select("doc_id", "lang", F.lit(9).alias("label")), labels(s, d).select("doc_id", F.col("toxic").alias("isFraud"), "quality"), "doc_id"), "SELECT doc_id, lang, coalesce(toxic, 0) AS label FROM documents LEFT JOIN labels USING (doc_id)"),
        "star_join": (lambda s, d: join_report(ev(s, d).select("target"), table(s, d, "part").select((F.col("p_partkey") % 90).alias("target")), "target"), f"WITH {EV}, p AS (SELECT p_partkey % 90 AS target, count(*) AS k FROM part GROUP BY 1) SELECT count(*) AS rows, count(*) FILTER (k IS NULL) AS unmatched, (SELECT count(*) FROM p WHERE k > 1 AND target IN (SELECT target FROM ev)) AS repeated FROM ev LEFT JOIN p USING (target)"),
        "one_to_one_violations": (lambda s, d: one_to_one_violations(table(s, d, "customer").select(F.col("c_custkey").alias("source")), table(s, d, "orders").select(F.col("o_custkey").alias("source")), "source"), "WITH o AS (SELECT o_custkey, count(*) AS k FROM orders GROUP BY 1) SELECT coalesce(c_custkey, o_custkey) AS source, (CASE WHEN c_custkey IS NULL THEN 0 ELSE 1 END)::BIGINT AS in_left, coalesce(k, 0) AS in_right FROM customer FULL JOIN o ON c_custkey = o_custkey WHERE c_custkey IS NULL OR k IS NULL OR k <> 1"),
        "affected_sources": (lambda s, d: affected(li(s, d), merchants_dim(s, d).where("level2 = 'Brand#11'"), "target", "source"), f"WITH {LI} SELECT DISTINCT source FROM li WHERE level2 = 'Brand#11'"),
        "affected_targets": (lambda s, d: affected(li(s, d), table(s, d, "customer").where("c_mktsegment = 'MACHINERY' AND c_acctbal < 0").select(F.col("c_custkey").alias("source")), "source", "target"), f"WITH {LI} SELECT DISTINCT target FROM li JOIN customer ON c_custkey = source WHERE c_mktsegment = 'MACHINERY' AND c_acctbal < 0"),
        "apply_changes": (lambda s, d: changed_dim(s, d, merchants_dim(s, d)), f"WITH {LI}, {proposals}, {dim_sql} SELECT * FROM da"),
        "changed_merchants": (lambda s, d: changed_rows(merchants_dim(s, d), changed_dim(s, d, merchants_dim(s, d)), "target", "level2"), f"WITH {LI}, {proposals}, {dim_sql} SELECT target, dm.level2 AS old, da.level2 AS new FROM dm JOIN da USING (target) WHERE dm.level2 <> da.level2"),
        "dist_before_after": (lambda s, d: share_change(sized_merchants(s, d), changed_dim(s, d, sized_merchants(s, d)), "level1", "level2"), f"""WITH {LI}, {proposals}, {dim_sql}, st AS (SELECT target, count(*) AS n, sum(amount::DECIMAL(18,4)) AS total FROM li GROUP BY 1), {side("dm", "b")}, {side("da", "a")},
            f AS (SELECT coalesce(b.level1, a.level1) AS level1, coalesce(b.level2, a.level2) AS level2, coalesce(b.k, 0) AS bk, coalesce(a.k, 0) AS ak, coalesce(b.nt, 0) AS bn, coalesce(a.nt, 0) AS an, coalesce(b.ks, 0) AS bks, coalesce(a.ks, 0) AS aks, coalesce(b.ns, 0) AS bns, coalesce(a.ns, 0) AS ans, coalesce(b.as_, 0) AS ba, coalesce(a.as_, 0) AS aa FROM b FULL JOIN a ON a.level1 = b.level1 AND a.level2 = b.level2)
            SELECT level1, level2, bk AS count_before, ak AS count_after, bn AS tx_before, an AS tx_after, bks AS count_share_before, aks AS count_share_after, bns AS tx_share_before, ans AS tx_share_after, ba AS amount_share_before, aa AS amount_share_after, ak - bk AS count_delta, aks - bks AS count_share_delta, aa - ba AS amount_share_delta FROM f"""),
        "level1_limits": (lambda s, d: level_limits(merchants_dim(s, d)), "SELECT p_type AS level1, p_brand AS level2, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY p_type) AS share, greatest(1, floor(sum(count(*)) OVER (PARTITION BY p_type) * 0.08::DOUBLE))::BIGINT AS most_changes FROM part GROUP BY 1, 2"),
        "union_texts": (lambda s, d: docs(s, d).where("doc_id % 2 = 0").select("doc_id", F.length("text").alias("chars")).unionByName(docs(s, d).where("doc_id % 2 <> 0").select(F.length("text").alias("chars"), "doc_id")), "SELECT doc_id, length(text)::INT AS chars FROM documents"),
        "union_texts_violations": (lambda s, d: docs(s, d).select("doc_id", "text").unionByName(docs(s, d).where("lang = 'de'").select("doc_id", "text")).groupBy("doc_id").agg(F.count(one).alias("n"), F.count_if(F.coalesce(F.trim("text"), F.lit("")) == "").alias("empty")).where("n > 1 OR empty > 0"), "WITH u AS (SELECT doc_id, text FROM documents UNION ALL SELECT doc_id, text FROM documents WHERE lang = 'de') SELECT doc_id, count(*) AS n, count(*) FILTER (trim(coalesce(text, '')) = '') AS empty FROM u GROUP BY 1 HAVING count(*) > 1 OR count(*) FILTER (trim(coalesce(text, '')) = '') > 0"),
        "replace_rows": (lambda s, d: replace_rows(docs(s, d).select("doc_id", "lang", "source"), labels(s, d).where("quality = 0").select("doc_id", F.concat(F.lit("redone "), F.col("toxic").cast("string")).alias("source")), "doc_id"), "SELECT doc_id, lang, CASE WHEN quality = 0 THEN 'redone ' || toxic ELSE source END AS source FROM documents LEFT JOIN labels USING (doc_id)"),
        "replace_rows_unknown": (lambda s, d: labels(s, d).select((F.col("doc_id") + 50).alias("doc_id")).join(docs(s, d), "doc_id", "left_anti"), "SELECT doc_id + 50 AS doc_id FROM labels WHERE doc_id + 50 NOT IN (SELECT doc_id FROM documents)"),
        "id_suffix_order": (lambda s, d: global_rank(table(s, d, "customer").select("c_name", F.regexp_extract("c_name", r"(\d+)$", 1).try_cast("long").alias("suffix")).withColumn("_k", F.coalesce("suffix", F.lit((1 << 63) - 1))), ["_k", "c_name"]).drop("_k"), r"WITH c AS (SELECT c_name, try_cast(regexp_extract(c_name, '(\d+)$', 1) AS BIGINT) AS suffix FROM customer) SELECT *, row_number() OVER (ORDER BY suffix NULLS LAST, c_name) AS rank FROM c"),
        "assignment_order": (lambda s, d: global_rank(sized_merchants(s, d).select("target", "n", "total", (-F.col("total")).alias("_a"), (-F.col("n")).alias("_n")), ["_a", "_n", "target"]).select("target", "n", F.col("total").cast("double").alias("total"), "rank"), f"WITH {LI}, st AS (SELECT target, count(*) AS n, sum(amount::DECIMAL(18,4)) AS total FROM li GROUP BY 1) SELECT p_partkey AS target, coalesce(n, 0) AS n, coalesce(total, 0)::DOUBLE AS total, row_number() OVER (ORDER BY coalesce(total, 0) DESC, coalesce(n, 0) DESC, p_partkey) AS rank FROM part LEFT JOIN st ON st.target = p_partkey"),
        "publish_manifest": (lambda s, d: manifest(published(s, d)), f"""WITH {EV} SELECT 'transaction' AS "table", count(*) AS rows, 6 AS columns, {d32("seq", "source", "target", "label")} AS digest FROM ev UNION ALL SELECT 'merchant', count(*), 4, {d32("p_partkey", "p_name", "p_type", "p_brand")} FROM part UNION ALL SELECT 'user', count(*), 3, {d32("c_custkey", "n_name", "c_mktsegment")} FROM customer JOIN nation ON c_nationkey = n_nationkey"""),
        "contract_violations": (lambda s, d: contract_violations(published(s, d), changed_raw(s, d)), f"WITH {EV} " + " UNION ALL ".join(f"SELECT '{k}' AS rule, count(*) AS n FROM {v} v" for k, v in rules.items())),
        "frozen_check": (lambda s, d: frozen_check(ev(s, d), changed_raw(s, d).withColumn("amount", F.round("amount", 2)), ["source", "target", "label", "datetime"]), f"WITH {EV} SELECT unnest(['rows', 'source', 'target', 'label', 'datetime']) AS \"column\", (count(*) > 0) AS same FROM ev"),
        "frozen_check_broken": (lambda s, d: frozen_check(ev(s, d), ev(s, d).withColumn("label", F.when(F.col("seq") == 7, 2 - F.col("label")).otherwise(F.col("label"))).withColumn("target", F.when(F.col("seq") == 9, F.lit(-1)).otherwise(F.col("target"))), ["source", "target", "label"]), f"WITH {EV}, b AS (SELECT *, CASE WHEN seq = 7 THEN 2 - label ELSE label END AS l, CASE WHEN seq = 9 THEN -1 ELSE target END AS t FROM ev) SELECT unnest(['rows', 'source', 'target', 'label']) AS \"column\", unnest([true, true, bool_and(target = t), bool_and(label = l)]) AS same FROM b"),
    }
