"""Rhythms, behaviour profiles, bursts, blocks and calendars of ordered transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from ..sources.views import EV, txn_ev

# Days on which bills are common.
BILL_DAYS = (1, 5, 10, 15, 20, 25, 28)


def calendar(df: DataFrame, rule: str = "generator") -> DataFrame:
    t = F.col("datetime")
    day, hour = F.dayofmonth(t), F.hour(t)
    if rule == "generator":
        start, middle, end = day <= 3, day.isin(14, 15, 16), day >= 28
    else:
        start, middle, end = day <= 10, (day > 10) & (day <= 20), day > 20
    return df.withColumns({
        "date": F.date_format(t, "yyyy-MM-dd"), "year": F.year(t), "month": F.month(t), "day": day, "hour": hour, "minute": F.minute(t), "second": F.second(t).cast("int"),
        "dayofweek": F.weekday(t), "is_weekend": F.weekday(t) >= 5, "is_month_start": start, "is_month_middle": middle, "is_month_end": end,
        "is_common_bill_day": day.isin(*BILL_DAYS), "period_tag": S.day_part(hour, rule)})


def calendar_sql(rule: str = "generator") -> str:
    m = ["day(datetime) <= 3", "day(datetime) IN (14, 15, 16)", "day(datetime) >= 28"] if rule == "generator" else ["day(datetime) <= 10", "day(datetime) BETWEEN 11 AND 20", "day(datetime) > 20"]
    return f"""SELECT *, strftime(datetime, '%Y-%m-%d') AS date, year(datetime)::INT AS year, month(datetime)::INT AS month, day(datetime)::INT AS day, hour(datetime)::INT AS hour,
        minute(datetime)::INT AS minute, second(datetime)::INT AS second, (isodow(datetime) - 1)::INT AS dayofweek, isodow(datetime) >= 6 AS is_weekend, {m[0]} AS is_month_start,
        {m[1]} AS is_month_middle, {m[2]} AS is_month_end, day(datetime) IN {BILL_DAYS} AS is_common_bill_day, {S.day_part_sql("hour(datetime)", rule)} AS period_tag FROM ev"""


def how_bin(t):
    """Half hour of the week: 0 (Monday, midnight) to 335."""
    return (F.weekday(t) * 48 + F.hour(t) * 2 + F.floor(F.minute(t) / 30)).cast("int")


HOW_SQL = "((isodow(datetime) - 1) * 48 + hour(datetime) * 2 + minute(datetime) // 30)::INT"


def smoothed(df: DataFrame, key: str, bins: int, first: int = 0, alpha: float = 1.0) -> DataFrame:
    """Share of every bin with additive smoothing; bins without rows included. The window sees the bins, not the facts."""
    counts = df.groupBy(F.col(key).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(first, first + bins).select(F.col("id").cast("int").alias("bin"))
    filled = every.join(F.broadcast(counts), "bin", "left").select("bin", (F.coalesce("n", F.lit(0)) + alpha).alias("w"))
    return filled.select("bin", (F.col("w") / F.sum("w").over(Window.partitionBy(F.lit(0)))).alias("prob"))


def smoothed_sql(key: str, bins: int, first: int = 0, where: str = "true") -> str:
    return f"""WITH {EV}, c AS (SELECT {key} AS bin, count(*) AS n FROM ev WHERE {where} GROUP BY 1), f AS (SELECT r.i::INT AS bin, coalesce(n, 0) + 1.0::DOUBLE AS w FROM range({first}, {first + bins}) r(i) LEFT JOIN c ON c.bin = r.i)
        SELECT bin, w / sum(w) OVER () AS prob FROM f"""


def behavior_profile(df: DataFrame, least: int = 20) -> DataFrame:
    n, a = F.count(F.lit(1)), F.col("amount")
    mean, std = F.avg(a), F.stddev_pop(a)
    return df.groupBy("source").agg(
        n.alias("n"), F.log1p(n.cast("double")).alias("log_n"), F.avg((F.col("label") == 1).cast("int")).alias("fraud_ratio"), F.log1p(F.abs(mean)).alias("log_mean"), F.log1p(F.abs(std)).alias("log_std"),
        F.least(std / (F.abs(mean) + 1e-6), F.lit(10.0)).alias("cv"), F.avg((F.bround(a, 0) == a).cast("int")).alias("round_share"),
        (F.count_distinct("target") / n).alias("target_share"), (1 - F.count_distinct(F.bround(a, 2)) / n).alias("repeat_share")).where(F.col("n") >= least)


PROFILE_SQL = """SELECT source, count(*) AS n, ln(1 + count(*)::DOUBLE) AS log_n, avg((label = 1)::INT) AS fraud_ratio, ln(1 + abs(avg(amount))) AS log_mean, ln(1 + abs(stddev_pop(amount))) AS log_std,
    least(stddev_pop(amount) / (abs(avg(amount)) + 1e-6), 10.0) AS cv, avg((round_even(amount, 0) = amount)::INT) AS round_share, count(DISTINCT target)::DOUBLE / count(*) AS target_share,
    1 - count(DISTINCT round_even(amount, 2))::DOUBLE / count(*) AS repeat_share FROM ev GROUP BY source HAVING count(*) >= 20"""

FEATURES = ("log_n", "fraud_ratio", "log_mean", "log_std", "cv", "round_share", "target_share", "repeat_share")


def knn_match(left: DataFrame, right: DataFrame, k: int = 5, most: int = 5000) -> DataFrame:
    """The k nearest reference profiles of each profile, but its own, with softmax weights. Both sides are bounded to `most` by
    volume, so the right side is broadcast within a proven bound; z-scores are common to both sides."""
    top = lambda d: d.orderBy(F.desc("n"), "source").limit(most)
    a, b = top(left), top(right)
    both = a.select(*FEATURES).union(b.select(*FEATURES))
    scale = both.agg(*[x for f in FEATURES for x in (F.avg(f).alias(f"m_{f}"), F.stddev_samp(f).alias(f"s_{f}"))])

    def z(d, name):
        own = [((F.col(f) - F.col(f"m_{f}")) / F.coalesce(F.nullif(F.col(f"s_{f}"), F.lit(0.0)), F.lit(1.0))) for f in FEATURES]
        return d.join(F.broadcast(scale)).select(F.col("source").alias(name), F.array(*own).alias(f"z_{name}"))

    pairs = z(a, "source").join(F.broadcast(z(b, "ref")), F.col("source") != F.col("ref"))
    square = F.aggregate(F.zip_with("z_source", "z_ref", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    ranked = pairs.select("source", "ref", F.sqrt(square).alias("distance")).withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy("distance", "ref"))).where(F.col("rank") <= k)
    own = Window.partitionBy("source")
    e = F.exp(F.min("distance").over(own) - F.col("distance"))
    return ranked.withColumn("_e", e).select("source", "ref", "distance", "rank", (F.col("_e") / F.sum("_e").over(own)).alias("weight"))


def knn_sql() -> str:
    z = lambda s: ", ".join(f"(p.{f} - m_{f}) / coalesce(nullif(s_{f}, 0), 1) AS z{i}" for i, f in enumerate(FEATURES))
    stats = ", ".join(f"avg({f}) AS m_{f}, stddev_samp({f}) AS s_{f}" for f in FEATURES)
    dist = " + ".join(f"(a.z{i} - b.z{i}) ** 2" for i in range(len(FEATURES)))
    return f"""WITH {EV}, p AS ({PROFILE_SQL} ORDER BY n DESC, source LIMIT 5000), s AS (SELECT {stats} FROM (FROM p UNION ALL FROM p)), z AS (SELECT source, {z("p")} FROM p, s),
        d AS (SELECT a.source, b.source AS ref, sqrt({dist}) AS distance FROM z a, z b WHERE a.source <> b.source),
        r AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY distance, ref))::INT AS rank FROM d QUALIFY rank <= 5)
        SELECT *, exp(min(distance) OVER w - distance) / sum(exp(-distance)) OVER w / exp(min(distance) OVER w) AS weight FROM r WINDOW w AS (PARTITION BY source)"""


def fraud_bursts(df: DataFrame, gap: int = 600, most: int | None = 500) -> DataFrame:
    """Runs of a user's fraud rows with no gap over `gap` seconds, of two rows at least."""
    own = Window.partitionBy("source").orderBy("datetime", "seq")
    s = F.unix_micros(F.col("datetime").cast("timestamp")) / 1e6
    rows = df.where("label = 1").withColumn("_s", s).withColumn("_new", F.coalesce((F.col("_s") - F.lag("_s").over(own) > gap).cast("int"), F.lit(1)))
    runs = rows.withColumn("run", F.sum("_new").over(own)).groupBy("source", "run").agg(
        F.count(F.lit(1)).alias("n"), F.min("_s").alias("_start"), F.max("_s").alias("_end"), (F.stddev_pop("amount") / (F.abs(F.avg("amount")) + 1e-6)).alias("cv"),
        F.sort_array(F.collect_list("_s")).alias("_t")).where("n >= 2")
    out = runs.select("source", "_start", "n", (F.col("_end") - F.col("_start")).alias("span"), "cv", F.when(F.col("cv") <= 0.01, "equal_amount").otherwise("mixed").alias("kind"),
        F.array_join(F.transform("_t", lambda t: F.format_string("%.1f", F.rint((t - F.col("_start")) * 10) / 10)), ",").alias("deltas"))
    out = out.withColumnRenamed("_start", "start")
    return out.orderBy("source", "start").limit(most) if most else out


def bursts_sql(gap: int, most: int | None) -> str:
    return f"""WITH {EV}, s AS (SELECT *, epoch_us(datetime) / 1e6 AS s FROM ev WHERE label = 1), b AS (SELECT *, coalesce((s - lag(s) OVER w > {gap})::INT, 1) AS brk FROM s WINDOW w AS (PARTITION BY source ORDER BY datetime, seq)),
        r AS (SELECT *, sum(brk) OVER (PARTITION BY source ORDER BY datetime, seq) AS run FROM b), g AS (SELECT source, run, count(*) AS n, min(s) AS st, max(s) - min(s) AS span, stddev_pop(amount) / (abs(avg(amount)) + 1e-6) AS cv, list(s ORDER BY s) AS t FROM r GROUP BY 1, 2 HAVING count(*) >= 2)
        SELECT source, st AS start, n, span, cv, CASE WHEN cv <= 0.01 THEN 'equal_amount' ELSE 'mixed' END AS kind, array_to_string(list_transform(t, lambda x: printf('%.1f', x - st)), ',') AS deltas FROM g {"ORDER BY source, st LIMIT " + str(most) if most else ""}"""


def phase_calibration(df: DataFrame) -> DataFrame:
    """The hour shift whose quietest three hours start nearest to 2 o'clock; works on the 24-row histogram."""
    hist = df.groupBy(F.hour("datetime").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    hours = lambda n: df.sparkSession.range(24).select(F.col("id").cast("int").alias(n))
    full = hours("h").join(F.broadcast(hist), "h", "left").select("h", F.coalesce("n", F.lit(0)).alias("n"))
    sums = F.broadcast(hours("shift")).join(F.broadcast(hours("start"))).join(full, F.pmod(F.col("h") + F.col("shift") - F.col("start"), F.lit(24)) < 3).groupBy("shift", "start").agg(F.sum("n").alias("quiet"))
    best = sums.groupBy("shift").agg(F.min(F.struct("quiet", "start")).alias("b")).select("shift", "b.start", "b.quiet")
    ranked = best.withColumn("distance", S.circular_distance(F.col("start"), F.lit(2), 24))
    return ranked.agg(F.min(F.struct("distance", "quiet", "shift", "start")).alias("b")).select("b.shift", "b.start", "b.quiet", "b.distance")


def calendar_bins(df: DataFrame) -> DataFrame:
    """Half-hour bins of the calendar with weights of week rhythm times month rhythm and their running share (14,592 rows: a window over bins, not facts)."""
    t = df.withColumn("how", how_bin(F.col("datetime"))).withColumn("dom", F.dayofmonth("datetime"))
    how, dom = smoothed(t, "how", 336), smoothed(t, "dom", 31, 1)
    bins = df.sparkSession.sql("SELECT explode(sequence(timestamp_ntz'2021-01-01 00:00:00', timestamp_ntz'2021-10-31 23:30:00', interval 30 minutes)) AS datetime")
    w = bins.withColumn("bin", how_bin(F.col("datetime"))).join(F.broadcast(how.withColumnRenamed("prob", "p")), "bin").withColumn("dom", F.dayofmonth("datetime"))
    w = w.join(F.broadcast(dom.select(F.col("bin").alias("dom"), F.col("prob").alias("q"))), "dom").select("datetime", (F.col("p") * F.col("q")).alias("w"))
    one = Window.partitionBy(F.lit(0))
    return w.select(F.col("datetime").alias("bin_start"), (F.col("w") / F.sum("w").over(one)).alias("prob"), (F.sum("w").over(one.orderBy("datetime").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("w").over(one)).alias("cdf"))


def blocks_normal(df: DataFrame, size: int = 20) -> DataFrame:
    """Chunks of at most `size` rows inside every run of non-fraud rows of one user, in order."""
    own = Window.partitionBy("source").orderBy("seq")
    rows = df.withColumn("_run", F.sum((F.col("label") == 1).cast("int")).over(own)).where("label <> 1")
    place = F.row_number().over(Window.partitionBy("source", "_run").orderBy("seq")) - 1
    return rows.withColumn("_chunk", F.floor(place / size)).groupBy("source", "_run", "_chunk").agg(F.count(F.lit(1)).alias("rows"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.sum("amount").alias("amount")).drop("_run", "_chunk")


def user_rhythm(df: DataFrame, least: int = 20, alpha: float = 1.0) -> DataFrame:
    """Smoothed half-hour-of-week shares of each user of at least `least` rows, empty bins included: 336 rows a user."""
    counts = df.groupBy("source", how_bin(F.col("datetime")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    users = df.groupBy("source").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    bins = users.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(335))))
    return bins.join(counts, ["source", "bin"], "left").select("source", "bin", ((F.coalesce("n", F.lit(0)) + alpha) / (F.col("_n") + 336 * alpha)).alias("prob"))


USER_RHYTHM = f"uc AS (SELECT source, {HOW_SQL} AS bin, count(*) AS n FROM ev GROUP BY 1, 2), uu AS (SELECT source, count(*) AS n FROM ev GROUP BY 1 HAVING count(*) >= 20), ur AS (SELECT uu.source, r.i::INT AS bin, (coalesce(uc.n, 0) + 1)::DOUBLE / (uu.n + 336) AS prob FROM uu CROSS JOIN range(336) r(i) LEFT JOIN uc ON uc.source = uu.source AND uc.bin = r.i)"


def queries() -> dict:
    ev = txn_ev
    timed = lambda s, d: ev(s, d).withColumn("how", how_bin(F.col("datetime"))).withColumn("dom", F.dayofmonth("datetime"))
    q = {
        "calendar_features": (lambda s, d: calendar(ev(s, d)), f"WITH {EV} {calendar_sql()}"),
        "calendar_features_fallback": (lambda s, d: calendar(ev(s, d), "fallback"), f"WITH {EV} {calendar_sql('fallback')}"),
        "how_bins": (lambda s, d: timed(s, d).select("seq", "how", "dom"), f"WITH {EV} SELECT seq, {HOW_SQL} AS how, day(datetime)::INT AS dom FROM ev"),
        "fraud_flag": (lambda s, d: ev(s, d).select("seq", F.coalesce(F.col("label").cast("string").try_cast("double") == 1, F.lit(False)).alias("is_fraud")), f"WITH {EV} SELECT seq, coalesce(try_cast(label::VARCHAR AS DOUBLE) = 1, false) AS is_fraud FROM ev"),
        "rhythm_hour_of_week": (lambda s, d: smoothed(timed(s, d), "how", 336), smoothed_sql(HOW_SQL, 336)),
        "rhythm_day_of_month": (lambda s, d: smoothed(timed(s, d), "dom", 31, 1), smoothed_sql("day(datetime)", 31, 1)),
        "rhythm_fraud": (lambda s, d: smoothed(timed(s, d).where("label = 1"), "how", 336), smoothed_sql(HOW_SQL, 336, where="label = 1")),
        "behavior_profile": (lambda s, d: behavior_profile(ev(s, d)), f"WITH {EV} {PROFILE_SQL}"),
        "knn_profile_match": (lambda s, d: knn_match(behavior_profile(ev(s, d)), behavior_profile(ev(s, d))), knn_sql()),
        "fraud_bursts": (lambda s, d: fraud_bursts(ev(s, d)), bursts_sql(600, 500)),
        "fraud_bursts_wide": (lambda s, d: fraud_bursts(ev(s, d), 21_600, None), bursts_sql(21_600, None)),
        "phase_calibration": (lambda s, d: phase_calibration(ev(s, d)), f"""WITH {EV}, h AS (SELECT r.i AS h, count(seq) AS n FROM range(24) r(i) LEFT JOIN ev ON hour(datetime) = r.i GROUP BY 1),
            w AS (SELECT s.i AS shift, t.i AS start, sum(n)::BIGINT AS quiet FROM range(24) s(i), range(24) t(i), h WHERE (h.h + s.i - t.i + 24) % 24 < 3 GROUP BY 1, 2), b AS (SELECT DISTINCT ON (shift) * FROM w ORDER BY shift, quiet, start)
            SELECT shift::INT AS shift, start::INT AS start, quiet, least(abs(start - 2) % 24, 24 - abs(start - 2) % 24)::INT AS distance FROM b ORDER BY distance, quiet, shift LIMIT 1"""),
        "calendar_cdf": (lambda s, d: calendar_bins(ev(s, d)), f"""WITH {EV}, hc AS (SELECT {HOW_SQL} AS bin, count(*) AS n FROM ev GROUP BY 1), hw AS (SELECT r.i AS bin, (coalesce(n, 0) + 1.0::DOUBLE) / sum(coalesce(n, 0) + 1.0::DOUBLE) OVER () AS p FROM range(336) r(i) LEFT JOIN hc ON hc.bin = r.i),
            dc AS (SELECT day(datetime) AS bin, count(*) AS n FROM ev GROUP BY 1), dm AS (SELECT r.i AS bin, (coalesce(n, 0) + 1.0::DOUBLE) / sum(coalesce(n, 0) + 1.0::DOUBLE) OVER () AS q FROM range(1, 32) r(i) LEFT JOIN dc ON dc.bin = r.i),
            b AS (SELECT unnest(generate_series(TIMESTAMP '2021-01-01', TIMESTAMP '2021-10-31 23:30:00', INTERVAL 30 MINUTE)) AS datetime), w AS (SELECT datetime, p * q AS w FROM b JOIN hw ON hw.bin = {HOW_SQL} JOIN dm ON dm.bin = day(datetime))
            SELECT datetime AS bin_start, w / sum(w) OVER () AS prob, sum(w) OVER (ORDER BY datetime) / sum(w) OVER () AS cdf FROM w"""),
        "ffsd_blocks_normal": (lambda s, d: blocks_normal(ev(s, d)), f"""WITH {EV}, r AS (SELECT *, sum((label = 1)::INT) OVER (PARTITION BY source ORDER BY seq) AS run FROM ev), n AS (SELECT *, (row_number() OVER (PARTITION BY source, run ORDER BY seq) - 1) // 20 AS chunk FROM r WHERE label <> 1)
            SELECT source, count(*) AS rows, min(seq) AS first_seq, max(seq) AS last_seq, sum(amount) AS amount FROM n GROUP BY source, run, chunk"""),
        "time_order_violations": (lambda s, d: ev(s, d).withColumn("_p", F.lag("datetime").over(Window.partitionBy("source").orderBy("seq"))).agg(
            F.count_if(F.col("datetime").isNull()).alias("nulls"), F.count_if(F.col("datetime") < F.col("_p")).alias("backward"), F.min("datetime").alias("first"), F.max("datetime").alias("last")),
            f"WITH {EV}, l AS (SELECT *, lag(datetime) OVER (PARTITION BY source ORDER BY seq) AS p FROM ev) SELECT count(*) FILTER (datetime IS NULL) AS nulls, count(*) FILTER (datetime < p) AS backward, min(datetime) AS first, max(datetime) AS last FROM l"),
        "user_rhythm": (lambda s, d: user_rhythm(ev(s, d)), f"WITH {EV}, {USER_RHYTHM} SELECT source, bin, prob FROM ur"),
    }
    return q
