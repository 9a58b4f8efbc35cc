"""Times for ordered transactions: blocks take places in a calendar in order, and their rows follow at short gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from ..operators.order import global_rank, neighbours, running_max
from ..operators.segments import prefix, segments
from ..sources.views import EV, txn_ev
from .time import HOW_SQL, USER_RHYTHM, behavior_profile, bursts_sql, calendar_bins, fraud_bursts, how_bin, knn_match, knn_sql, smoothed, smoothed_sql, user_rhythm

W = Window.partitionBy
one = "*"
#: A calendar bin in seconds; the widest gaps inside blocks of fraud and of other rows.
BIN, FRAUD_GAP, GAP = 1800, 89, 44


#: Least amount in relative comparisons.
LEAST = 1e-6


def block_rule(look: str, tolerance: float = 0.01) -> tuple[Column, Column]:
    """Rows and kind of a block that begins at the first of the next rows. A fraud block is the longest run of fraud rows with one amount (against its
    first), one target or one source, of whomever they are; a single one is isolated. Any other block ends before the next fraud row."""
    first = F.get(look, F.lit(0))
    near = lambda x: F.abs(x["amount"] - first["amount"]) <= tolerance * F.greatest(F.abs(x["amount"]), F.abs(first["amount"]), F.lit(LEAST))
    same = lambda c: prefix(look, lambda x: (x["label"] == 1) & (x[c] == first[c]))
    equal, target, source = prefix(look, lambda x: (x["label"] == 1) & near(x)), same("target"), same("source")
    n = F.greatest(equal, target, source, F.lit(1))
    other = prefix(look, lambda x: F.coalesce(x["label"], F.lit(0)) != 1)
    kind = F.when(n < 2, "isolated_fraud").when(equal == n, "equal_amount").when((target == n) & (source == n), "same_pair").when(target == n, "same_target").otherwise("same_source")
    return F.when(other > 0, other).otherwise(n), F.when(other > 0, "normal").otherwise(kind)


def block_rows(df: DataFrame, size: int = 20, tolerance: float = 0.01, parts: int | None = None) -> DataFrame:
    """Rows with their block of at most `size` rows in the one order of all transactions: blocks cross users. Adds block, k (place in it), n, kind."""
    cut = segments(df, "seq", ["label", "source", "target", "amount"], size, lambda look: block_rule(look, tolerance), parts)
    return df.select("seq", "source", "target", "amount", "label").join(cut, "seq")


def blocks(rows: DataFrame) -> DataFrame:
    """A row a block with its number in order (`ord`, from 1) among `many` blocks."""
    b = rows.where("k = 0").select("block", "source", "kind", "n")
    total = b.agg(F.count(one).alias("many"))
    return global_rank(b, ["block"], "ord").join(F.broadcast(total))  # one row


def matches(df: DataFrame) -> DataFrame:
    p = behavior_profile(df)
    return knn_match(p, p)


def mixed_rhythm(df: DataFrame) -> DataFrame:
    """Rhythm of each matched user: those of its neighbours by weight, made to sum to one, shrunk towards the global one by 0.4."""
    mix = matches(df).join(user_rhythm(df).withColumnRenamed("source", "ref"), "ref").groupBy("source", "bin").agg(F.sum(F.col("weight") * F.col("prob")).alias("p"))
    mix = mix.withColumn("p", F.col("p") / F.sum("p").over(W("source")))
    everyone = smoothed(df.withColumn("how", how_bin(F.col("datetime"))), "how", 336).withColumnRenamed("prob", "g")
    return mix.join(F.broadcast(everyone), "bin").select("source", "bin", (0.6 * F.col("p") + 0.4 * F.col("g")).alias("prob"))  # 336 rows


def quantile_bins(points: DataFrame, q: str, bins: DataFrame, out: str) -> DataFrame:
    """The bin that holds a quantile: how many running shares (both to 12 digits) lie below it, by halving over the calendar, which is one array of 14,592 numbers."""
    cdf = bins.agg(F.transform(F.array_sort(F.collect_list(F.struct("bin_start", "cdf"))), lambda x: F.round(x["cdf"], 12)).alias("_cdf"))
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(14))])
    below = F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.coalesce(F.try_element_at("_cdf", at + s) < F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(q, 12))), F.lit(False)), at + s).otherwise(at))
    return points.join(F.broadcast(cdf)).withColumn(out, F.least(below, F.size("_cdf") - 1)).drop("_cdf")


def block_starts(df: DataFrame, rows: DataFrame) -> DataFrame:
    """The start of each block: the i-th of B blocks owns the calendar's shares from (i - 1)/B to i/B. Among the bins of its segment one is drawn
    by half the calendar's weight and half the block's rhythm, then a second in it; no block starts before one before it. Adds _until, the end of the segment."""
    b = blocks(rows).withColumn("_q0", (F.col("ord") - 1) / F.col("many")).withColumn("_q1", F.col("ord") / F.col("many"))
    cal = calendar_bins(df)
    b = quantile_bins(quantile_bins(b, "_q0", cal, "left"), "_q1", cal, "right")
    numbered = cal.withColumn("i", F.row_number().over(W(F.lit(0)).orderBy("bin_start")) - 1).select("i", "bin_start", F.col("prob").alias("_w"), how_bin(F.col("bin_start")).alias("bin"))  # 14,592 bins
    hours = df.withColumn("how", how_bin(F.col("datetime")))
    everyone, fraud = (smoothed(x, "how", 336).withColumnRenamed("prob", n) for x, n in ((hours, "_g"), (hours.where("label = 1"), "_f")))
    segment = b.select("block", "source", "kind", "ord", F.explode(F.sequence("left", F.greatest("left", "right"))).alias("i")).join(F.broadcast(numbered), "i")
    segment = segment.join(F.broadcast(everyone), "bin").join(F.broadcast(fraud), "bin").join(mixed_rhythm(df).withColumnRenamed("prob", "_m"), ["source", "bin"], "left")
    user = F.coalesce("_m", "_g")
    rhythm = F.when(F.col("kind") != "normal", 0.5 * F.col("_f") + 0.3 * user + 0.2 * F.col("_g")).when(F.col("_m").isNotNull(), 0.6 * F.col("_m") + 0.4 * F.col("_g")).otherwise(F.col("_g"))
    weighed = segment.withColumn("w", 0.5 * F.col("_w") + 0.5 * rhythm)
    inside = W("block").orderBy("i")
    upto = F.sum("w").over(inside.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("w").over(W("block"))
    last = F.row_number().over(W("block").orderBy(F.desc("i"))) == 1
    drawn = weighed.withColumn("_upto", upto).withColumn("_u", S.keyed_uniform("bin", F.col("block"))).withColumn("_last", last).where("_upto > _u OR _last").groupBy("block").agg(F.min_by("bin_start", "i").alias("bin_start"))
    until = numbered.select(F.col("i").alias("right"), F.unix_timestamp(F.col("bin_start").cast("timestamp")).alias("_end"))
    starts = b.join(drawn, "block").join(F.broadcast(until), "right")
    second = F.floor(S.keyed_uniform("second", F.col("block")) * BIN).cast("long")
    starts = starts.select("block", "source", "kind", "n", "ord", (F.unix_timestamp(F.col("bin_start").cast("timestamp")) + second).alias("drawn"), (F.col("_end") + BIN - 1).alias("until"))
    return running_max(starts, ["ord"], "drawn", "start")


def template_table(df: DataFrame, size: int = 20) -> DataFrame:
    """For each block length, of equal amounts or not, the deltas of the burst of nearest length (at most 500 bursts; the first by user and time)."""
    bursts = fraud_bursts(df).select("kind", "deltas", F.col("n").alias("_n"), F.row_number().over(W(F.lit(0)).orderBy("source", "start")).alias("id"))
    lengths = df.sparkSession.range(1, size + 1).select(F.col("id").cast("int").alias("n"))
    both = F.broadcast(lengths).join(bursts).withColumn("equal", F.explode(F.array(F.lit(True), F.lit(False))))  # 20 lengths, 500 bursts
    other = F.col("equal") & (F.col("kind") != "equal_amount")
    best = both.groupBy("n", "equal").agg(F.min_by(F.struct("id", "deltas"), F.struct(other, F.abs(F.col("_n") - F.col("n")), "id")).alias("b"))
    return best.select("n", "equal", F.col("b.id").alias("template"), F.transform(F.split("b.deltas", ","), lambda x: F.floor(x.cast("double")).cast("long")).alias("_deltas"))


def ordered_times(df: DataFrame) -> DataFrame:
    """A time for each row, in order: the block's start and a gap in it, from a template or drawn, squeezed into what lies between the block's start and
    the next one's or the end of its segment. Adds where the time came from."""
    rows = block_rows(df)
    starts = neighbours(block_starts(df, rows), ["ord"], "start", "_before", "_next")
    room = F.greatest(F.lit(0), F.least(F.col("until"), F.coalesce("_next", F.col("until"))) - F.col("start"))
    starts = starts.select("block", "ord", "start", room.alias("room"))
    fraud = F.col("kind") != "normal"
    gap = 1 + F.floor(S.keyed_uniform("gap", F.col("seq")) * F.when(fraud, FRAUD_GAP).otherwise(GAP)).cast("long")
    timed = rows.join(starts, "block").withColumn("equal", F.col("kind") == "equal_amount")
    templates = template_table(df).select(F.col("n").alias("_tn"), F.col("equal").alias("_te"), "template", "_deltas")
    timed = timed.join(F.broadcast(templates), (F.col("n") == F.col("_tn")) & (F.col("equal") == F.col("_te")) & fraud, "left")
    inside = W("block").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    held = F.coalesce(F.size("_deltas"), F.lit(0))
    # Gaps count from the second row on, or behind the template's end.
    counted = F.when(F.col("k") >= F.greatest(held, F.lit(1)), gap).otherwise(0)
    delta = F.when(F.col("k") < held, F.try_element_at("_deltas", F.least(F.col("k") + 1, F.greatest(held, F.lit(1))))).otherwise(F.coalesce(F.element_at("_deltas", -1), F.lit(0)) + F.sum(counted).over(inside))
    timed = timed.withColumn("_d", delta).withColumn("_most", F.max("_d").over(W("block"))).withColumn("_d", F.when(F.col("_most") <= 0, F.col("k")).otherwise(F.col("_d"))).withColumn("_most", F.greatest("_most", F.when(F.col("_most") <= 0, F.col("n") - 1)))
    least = F.least(F.col("room"), F.greatest(F.col("n") - 1, F.lit(1)))
    reserve = 1 + F.floor(S.keyed_uniform("reserve", F.col("block")) * F.least(F.lit(300), F.col("room") - least)).cast("long")
    target = F.when(F.col("room") > least, F.greatest(least, F.col("room") - reserve)).otherwise(F.col("room"))
    offset = F.when(F.col("room") <= 0, 0).when(F.col("_most") > F.col("room"), F.floor(F.col("_d") * target / F.col("_most"))).otherwise(F.col("_d")).cast("long")
    known = F.broadcast(matches(df).groupBy(F.col("source").alias("_s")).agg(F.count(one).alias("matched_users")))  # at most 5,000 users
    timed = timed.join(known, F.col("source") == F.col("_s"), "left").withColumn("matched_users", F.coalesce("matched_users", F.lit(0)))
    origin = F.when(F.col("template").isNotNull(), "fraud_template").when(F.col("matched_users") > 0, "matched_users").otherwise("global")
    return timed.select("seq", "source", "label", "block", "ord", "k", "kind", "template", origin.alias("time_source"), "matched_users", "start", offset.alias("offset"), (F.col("start") + offset).alias("t"))


def on_boundary(t: Column) -> Column:
    """The last second of a half hour."""
    return F.pmod(t, F.lit(1800)) == 1799


def boundary_runs(times: DataFrame) -> DataFrame:
    """Runs of one time at the end of a half hour, with the different times before and behind them."""
    distinct = times.groupBy("t").agg(F.count(one).alias("run"))
    return neighbours(distinct, ["t"], "t", "before", "behind").where(on_boundary(F.col("t")))


def declustered(times: DataFrame) -> DataFrame:
    """Rows of such a run spread, in order, over seconds before it (behind it where there is no room); others keep their time."""
    runs = boundary_runs(times).withColumn("_back", F.coalesce(F.col("t") - F.col("before"), F.lit(BIN))).withColumn("_on", F.coalesce(F.col("behind") - F.col("t"), F.lit(BIN)))
    wide = F.greatest(F.lit(30), F.least(F.lit(300), 3 * F.col("run")))
    runs = runs.select("t", "run", F.when(F.col("_back") > 1, F.least(F.col("_back") - 1, wide)).alias("_earlier"), F.when((F.col("_back") <= 1) & (F.col("_on") > 1), F.least(F.col("_on") - 1, wide)).alias("_later"))
    rows = times.join(runs, "t", "left").withColumn("_k", F.row_number().over(W("t").orderBy("ord", "k")))
    step = lambda span: F.least(F.col(span), F.greatest(F.lit(1), F.floor(F.col("_k") * F.col(span) / (F.col("run") + 1)).cast("long")))
    moved = F.when(F.col("_earlier").isNotNull(), F.col("t") - (F.col("_earlier") - step("_earlier") + 1)).when(F.col("_later").isNotNull(), F.col("t") + step("_later")).otherwise(F.col("t"))
    return rows.withColumn("t", moved).drop("run", "_earlier", "_later", "_k")


def final_times(df: DataFrame) -> DataFrame:
    return declustered(ordered_times(df)).withColumn("datetime", F.timestamp_seconds("t").cast("timestamp_ntz"))


def violations(times: DataFrame) -> DataFrame:
    """Nulls, steps back inside a user's order, and the range of times."""
    own = W("source").orderBy("seq")
    return times.withColumn("_p", F.lag("t").over(own)).agg(F.count_if(F.col("t").isNull()).alias("nulls"), F.count_if(F.col("t") < F.col("_p")).alias("backward"), F.count(one).alias("rows"))


def report(times: DataFrame) -> DataFrame:
    """Rows, blocks and labels by kind of block."""
    return times.groupBy("kind", "time_source").agg(F.count(one).alias("rows"), F.count_if(F.col("k") == 0).alias("blocks"), F.count_if(F.col("label") == 1).alias("fraud"), F.count_if(F.col("label") == 0).alias("normal"))


def pseudo_ids(df: DataFrame, tiers: list[list[str]], session: list[str], merchant: list[str], least: tuple[int, ...] = (4, 3, 1), most: float = 0.95) -> DataFrame:
    """Ids from hashed columns: users by the first tier of which enough columns exist and whose distinct keys are at most `most` of all rows
    (else the last one); sessions by user and device columns; the tier is told. One aggregation finds the ratios."""
    have = [[c for c in t if c in df.columns] for t in tiers]
    ratios = df.agg(*[(F.count_distinct(S.stable_id("u", *[F.col(c) for c in h])) / F.count(one)).alias(f"_{i}") if h else F.lit(1.0).alias(f"_{i}") for i, h in enumerate(have)]).first()
    tier = next((i for i, h in enumerate(have) if len(h) >= least[min(i, len(least) - 1)] and (ratios[i] or 0) <= most), len(tiers) - 1)
    user = S.stable_id("u", *[F.col(c) for c in have[tier]])
    return df.withColumn("pseudo_user", user).withColumn("pseudo_session", S.stable_id("s", F.col("pseudo_user"), *[F.col(c) for c in session if c in df.columns])).withColumn("pseudo_merchant", S.stable_id("m", *[F.col(c) for c in merchant if c in df.columns])).withColumn("tier", F.lit(tier))


ROWS_SQL = """lk AS (SELECT *, row_number() OVER (ORDER BY seq) AS i, list({'f': label = 1, 's': source, 't': target, 'a': amount}) OVER (ORDER BY seq ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS l FROM ev),
    pf AS (SELECT * EXCLUDE (l), coalesce(nullif(list_position(list_transform(l, lambda x: x.f AND abs(x.a - l[1].a) <= 0.01::DOUBLE * greatest(abs(x.a), abs(l[1].a), 1e-6)), false), 0) - 1, len(l)) AS pe,
        coalesce(nullif(list_position(list_transform(l, lambda x: x.f AND x.t = l[1].t), false), 0) - 1, len(l)) AS pt, coalesce(nullif(list_position(list_transform(l, lambda x: x.f AND x.s = l[1].s), false), 0) - 1, len(l)) AS ps,
        coalesce(nullif(list_position(list_transform(l, lambda x: NOT x.f), false), 0) - 1, len(l)) AS po FROM lk),
    rn AS (SELECT *, CASE WHEN po > 0 THEN po ELSE greatest(pe, pt, ps, 1) END AS n FROM pf),
    rk AS (SELECT *, CASE WHEN po > 0 THEN 'normal' WHEN n < 2 THEN 'isolated_fraud' WHEN pe = n THEN 'equal_amount' WHEN pt = n AND ps = n THEN 'same_pair' WHEN pt = n THEN 'same_target' ELSE 'same_source' END AS kind FROM rn),
    ju AS (SELECT i AS at, i FROM (SELECT i, lag(label = 1) OVER (ORDER BY seq) AS before, label = 1 AS f FROM rk) WHERE before IS NULL OR before <> f UNION ALL SELECT ju.at, rk.i + rk.n FROM ju JOIN rk USING (i) JOIN rk nx ON nx.i = rk.i + rk.n AND (nx.label = 1) = (rk.label = 1)),
    bk AS (SELECT rk.i, rk.seq AS block, rk.n, rk.kind FROM ju JOIN rk USING (i)),
    br AS (SELECT r.seq, r.source, r.target, r.amount, r.label, bk.block, (r.i - bk.i)::INT AS k, bk.n::INT AS n, bk.kind FROM rk r ASOF JOIN bk ON r.i >= bk.i),
    bl AS (SELECT block, source, kind, n, row_number() OVER (ORDER BY block) AS ord, count(*) OVER () AS many FROM br WHERE k = 0)"""
MIX_SQL = f"""kn AS (SELECT * FROM ({knn_sql()})), {USER_RHYTHM}, gl AS (SELECT bin, prob AS g FROM ({smoothed_sql(HOW_SQL, 336)})), fl AS (SELECT bin, prob AS fp FROM ({smoothed_sql(HOW_SQL, 336, where="label = 1")})),
    mx AS (SELECT kn.source, bin, sum(weight * prob) AS p FROM kn JOIN ur ON ur.source = kn.ref GROUP BY 1, 2), mr AS (SELECT source, bin, 0.6::DOUBLE * (p / sum(p) OVER (PARTITION BY source)) + 0.4::DOUBLE * g AS prob FROM mx JOIN gl USING (bin))"""
CAL_SQL = f"""dm AS (SELECT bin, prob AS q FROM ({smoothed_sql("day(datetime)", 31, 1)})), cb AS (SELECT unnest(generate_series(TIMESTAMP '2021-01-01', TIMESTAMP '2021-10-31 23:30:00', INTERVAL 30 MINUTE)) AS datetime),
    cw AS (SELECT datetime, {HOW_SQL} AS bin, g * q AS w FROM cb JOIN gl ON gl.bin = {HOW_SQL} JOIN dm ON dm.bin = day(datetime)),
    cl AS (SELECT datetime, bin, w / sum(w) OVER () AS w, round(sum(w) OVER (ORDER BY datetime) / sum(w) OVER (), 12) AS cdf, row_number() OVER (ORDER BY datetime) - 1 AS i FROM cw), cx AS (SELECT list(cdf ORDER BY i) AS l FROM cl)"""
START_SQL = """bq AS (SELECT *, least((SELECT count(*) FROM cl WHERE cdf < round((ord - 1) / many, 12)), 14591) AS left_, least((SELECT count(*) FROM cl WHERE cdf < round(ord / many, 12)), 14591) AS right_ FROM (SELECT block, source, kind, n, ord, many::DOUBLE AS many FROM bl)),
    sg AS (SELECT bq.block, bq.kind, cl.i, cl.datetime, 0.5::DOUBLE * cl.w + 0.5::DOUBLE * CASE WHEN kind <> 'normal' THEN 0.5::DOUBLE * fp + 0.3::DOUBLE * coalesce(mr.prob, g) + 0.2::DOUBLE * g WHEN mr.prob IS NOT NULL THEN 0.6::DOUBLE * mr.prob + 0.4::DOUBLE * g ELSE g END AS w
        FROM bq JOIN cl ON cl.i BETWEEN left_ AND greatest(left_, right_) JOIN gl ON gl.bin = cl.bin JOIN fl ON fl.bin = cl.bin LEFT JOIN mr ON mr.source = bq.source AND mr.bin = cl.bin),
    sd AS (SELECT *, sum(w) OVER (PARTITION BY block ORDER BY i) / sum(w) OVER (PARTITION BY block) AS upto, i = max(i) OVER (PARTITION BY block) AS last, ('0x' || substr(md5(block::VARCHAR || '|bin'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM sg),
    sc AS (SELECT block, arg_min(datetime, i) AS bin_start FROM sd WHERE upto > u OR last GROUP BY 1),
    s0 AS (SELECT bq.block, bq.source, bq.kind, n, ord, epoch(bin_start)::BIGINT + floor(('0x' || substr(md5(bq.block::VARCHAR || '|second'), 1, 8))::BIGINT / 4294967296.0::DOUBLE * 1800)::BIGINT AS drawn, epoch(cl.datetime)::BIGINT + 1799 AS until FROM bq JOIN sc USING (block) JOIN cl ON cl.i = right_),
    bs AS (SELECT *, max(drawn) OVER (ORDER BY ord) AS start FROM s0)"""
TIME_SQL = f"""tb AS (SELECT kind, deltas, n, row_number() OVER (ORDER BY source, start) AS id FROM ({bursts_sql(600, 500)})), tl AS (SELECT l.n, e AS equal, arg_min(id, k) AS template, arg_min(deltas, k) AS deltas FROM (SELECT l.i AS n, e.e, id, deltas, ((CASE WHEN e.e AND kind <> 'equal_amount' THEN 1 ELSE 0 END) * 1000 + abs(tb.n - l.i)) * 1000 + id AS k FROM range(1, 21) l(i), (VALUES (true), (false)) e(e), tb) l GROUP BY 1, 2),
    tt AS (SELECT n, equal, template, list_transform(string_split(deltas, ','), lambda x: floor(x::DOUBLE)::BIGINT) AS ds FROM tl),
    b2 AS (SELECT *, greatest(0, least(until, coalesce(lead(start) OVER (ORDER BY ord), until)) - start) AS room FROM bs),
    t1 AS (SELECT br.*, ord, start, room, template, ds, coalesce(len(ds), 0) AS held, 1 + floor(('0x' || substr(md5(seq::VARCHAR || '|gap'), 1, 8))::BIGINT / 4294967296.0::DOUBLE * CASE WHEN br.kind <> 'normal' THEN 89 ELSE 44 END)::BIGINT AS gap
        FROM br JOIN b2 USING (block) LEFT JOIN tt ON tt.n = br.n AND tt.equal = (br.kind = 'equal_amount') AND br.kind <> 'normal'),
    t2 AS (SELECT *, CASE WHEN k < held THEN ds[k + 1] ELSE coalesce(ds[-1], 0) + sum(CASE WHEN k >= greatest(held, 1) THEN gap ELSE 0 END) OVER (PARTITION BY block ORDER BY k)::BIGINT END AS d0 FROM t1), t3 AS (SELECT *, max(d0) OVER (PARTITION BY block) AS m0 FROM t2),
    t4 AS (SELECT *, CASE WHEN m0 <= 0 THEN k ELSE d0 END AS d, CASE WHEN m0 <= 0 THEN greatest(m0, n - 1) ELSE m0 END AS m, least(room, greatest(n - 1, 1)) AS least_ FROM t3),
    t5 AS (SELECT *, CASE WHEN room > least_ THEN greatest(least_, room - (1 + floor(('0x' || substr(md5(block::VARCHAR || '|reserve'), 1, 8))::BIGINT / 4294967296.0::DOUBLE * least(300, room - least_))::BIGINT)) ELSE room END AS goal FROM t4),
    t6 AS (SELECT *, (CASE WHEN room <= 0 THEN 0 WHEN m > room THEN floor((d * goal)::DOUBLE / m) ELSE d END)::BIGINT AS "offset" FROM t5), km AS (SELECT source, count(*) AS matched FROM kn GROUP BY 1),
    ot AS (SELECT seq, t6.source, label, block, ord, k, kind, template, CASE WHEN template IS NOT NULL THEN 'fraud_template' WHEN matched > 0 THEN 'matched_users' ELSE 'global' END AS time_source, coalesce(matched, 0) AS matched_users, start, "offset", start + "offset" AS t FROM t6 LEFT JOIN km ON km.source = t6.source)"""
RUNS_SQL = "du AS (SELECT t, count(*) AS run FROM ot GROUP BY 1), dn AS (SELECT t, run, lag(t) OVER (ORDER BY t) AS before, lead(t) OVER (ORDER BY t) AS behind FROM du), ru AS (SELECT * FROM dn WHERE t % 1800 = 1799)"
FINAL_SQL = """dw AS (SELECT t, run, CASE WHEN coalesce(t - before, 1800) > 1 THEN least(coalesce(t - before, 1800) - 1, greatest(30, least(300, 3 * run))) END AS e, CASE WHEN coalesce(t - before, 1800) <= 1 AND coalesce(behind - t, 1800) > 1 THEN least(coalesce(behind - t, 1800) - 1, greatest(30, least(300, 3 * run))) END AS l FROM ru),
    dr AS (SELECT ot.*, run, e, l, row_number() OVER (PARTITION BY ot.t ORDER BY ord, k) AS r FROM ot LEFT JOIN dw ON dw.t = ot.t),
    ft AS (SELECT * REPLACE (CASE WHEN e IS NOT NULL THEN t - (e - least(e, greatest(1, floor((r * e)::DOUBLE / (run + 1))::BIGINT)) + 1) WHEN l IS NOT NULL THEN t + least(l, greatest(1, floor((r * l)::DOUBLE / (run + 1))::BIGINT)) ELSE t END AS t) FROM dr)"""


def queries() -> dict:
    ev = txn_ev
    head = f"WITH RECURSIVE {EV}, {ROWS_SQL}, {MIX_SQL}, {CAL_SQL}, {START_SQL}, {TIME_SQL}, {RUNS_SQL}, {FINAL_SQL}"
    ids = lambda s, d: pseudo_ids(ev(s, d), [["source", "target", "amount", "card"], ["source", "target", "label"], ["source", "target"], ["source"]], ["label"], ["target"])
    h = lambda p, *c: f"'{p}_' || md5(concat_ws(chr(31), " + ", ".join(f"coalesce({x}::VARCHAR, '__NA__')" for x in c) + "))"
    points = lambda s, d: s.range(0, 1001).select((F.col("id") / 1000.0).alias("q"))
    return {
        "ffsd_blocks": (lambda s, d: block_rows(ev(s, d)).select("seq", "source", "block", "k", "n", "kind"), f"WITH RECURSIVE {EV}, {ROWS_SQL} SELECT seq, source, block, k, n, kind FROM br"),
        "mixed_rhythm": (lambda s, d: mixed_rhythm(ev(s, d)), f"WITH {EV}, {MIX_SQL} SELECT * FROM mr"),
        "quantile_bin_asof": (lambda s, d: quantile_bins(points(s, d), "q", calendar_bins(ev(s, d)), "bin"), f"WITH {EV}, {MIX_SQL}, {CAL_SQL} SELECT r.i / 1000.0::DOUBLE AS q, least((SELECT count(*) FROM cl WHERE cdf < round(r.i / 1000.0::DOUBLE, 12)), 14591)::INT AS bin FROM range(1001) r(i)"),
        "block_start": (lambda s, d: block_starts(ev(s, d), block_rows(ev(s, d))), f"{head} SELECT * FROM bs"),
        "monotone_times": (lambda s, d: running_max(ev(s, d).select("seq", "amount"), ["seq"], "amount", "upto"), f"WITH {EV} SELECT seq, amount, max(amount) OVER (ORDER BY seq) AS upto FROM ev"),
        "block_offsets": (lambda s, d: ordered_times(ev(s, d)).select("seq", "block", "k", "start", "offset"), f'{head} SELECT seq, block, k, start, "offset" FROM ot'),
        "boundary_runs": (lambda s, d: boundary_runs(ordered_times(ev(s, d)).withColumn("t", F.col("t") - F.pmod(F.col("t"), F.lit(600)) + 599)).na.fill(-1), f"{head.replace('start + \"offset\" AS t FROM', 'start + \"offset\" - (start + \"offset\") % 600 + 599 AS t FROM')} SELECT t, run, coalesce(before, -1) AS before, coalesce(behind, -1) AS behind FROM ru"),
        "declustered_times": (lambda s, d: declustered(ordered_times(ev(s, d)).withColumn("t", F.col("t") - F.pmod(F.col("t"), F.lit(600)) + 599)).select("seq", "t"), f"{head.replace('start + \"offset\" AS t FROM', 'start + \"offset\" - (start + \"offset\") % 600 + 599 AS t FROM')} SELECT seq, t FROM ft"),
        "ordered_times": (lambda s, d: final_times(ev(s, d)).select("seq", "source", "block", "kind", F.coalesce("template", F.lit(-1)).alias("template"), "time_source", "matched_users", "t"), f"{head} SELECT seq, source, block, kind, coalesce(template, -1) AS template, time_source, matched_users, t FROM ft"),
        "ordered_times_violations": (lambda s, d: violations(final_times(ev(s, d))), f"WITH {EV} SELECT 0 AS nulls, 0 AS backward, count(*) AS rows FROM ev"),
        "ts_report": (lambda s, d: report(final_times(ev(s, d))), f"{head} SELECT kind, time_source, count(*) AS rows, count(*) FILTER (k = 0) AS blocks, count(*) FILTER (label = 1) AS fraud, count(*) FILTER (label = 0) AS normal FROM ft GROUP BY 1, 2"),
        "pseudo_ids": (lambda s, d: ids(s, d).select("seq", "pseudo_user", "pseudo_session", "pseudo_merchant", "tier"), f"WITH {EV}, r AS (SELECT count(DISTINCT (source, target, label))::DOUBLE / count(*) AS b FROM ev), p AS (SELECT seq, label, target, CASE WHEN b <= 0.95 THEN 1 ELSE 2 END AS tier, CASE WHEN b <= 0.95 THEN {h('u', 'source', 'target', 'label')} ELSE {h('u', 'source', 'target')} END AS pseudo_user FROM ev, r) SELECT seq, pseudo_user, {h('s', 'pseudo_user', 'label')} AS pseudo_session, {h('m', 'target')} AS pseudo_merchant, tier FROM p"),
    }


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole job over one folder's events."""
    return final_times(txn_ev(spark, sf_dir))
