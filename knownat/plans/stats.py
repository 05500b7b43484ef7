"""Queries H1-H11."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from knownat.functions import numeric as num
from knownat.functions.numeric import day_text, key_day, rounded, stamp_text
from knownat.functions.scale import exact_quantile, trimmed_mean
from knownat.operators import calendar as cal
from knownat.operators import stats
from knownat.plans import fixtures as fx
from knownat.plans.registry import cte, query
from knownat.plans.rules import forward_out, forward_sql, judge_out, judge_sql
from knownat.sources.tables import load

cte("rec", """SELECT *, r - avg(r) OVER (PARTITION BY day) AS excess FROM (SELECT instrument_id, day, (close / open - 1) * 100 AS r, ((instrument_id * 31 + dayofyear(day) * 7) % 41 - 20) / 10.0 AS overlay_points,
  CASE dayofyear(day) % 4 WHEN 0 THEN 'RISK_ON' WHEN 1 THEN 'NEUTRAL' WHEN 2 THEN 'RISK_OFF' ELSE 'UNKNOWN' END AS regime, ((instrument_id * 7 + dayofyear(day)) % 120) / 10.0 - 0.5 AS age_days, 'I' || instrument_id AS question FROM bars)""", "bars")


def records(spark, sf):
    doy = F.dayofyear("day")
    rows = fx.bars(spark, sf).select(
        "instrument_id", "day", num.percent_change("open", "close").alias("r"), (((F.col("instrument_id") * 31 + doy * 7) % 41 - 20) / 10.0).alias("overlay_points"),
        F.element_at(F.array(*[F.lit(x) for x in ("RISK_ON", "NEUTRAL", "RISK_OFF", "UNKNOWN")]), doy % 4 + 1).alias("regime"),
        (((F.col("instrument_id") * 7 + doy) % 120) / 10.0 - 0.5).alias("age_days"), F.concat(F.lit("I"), F.col("instrument_id").cast("string")).alias("question"))
    return rows.withColumn("excess", F.col("r") - F.avg("r").over(W.partitionBy("day")))


MT = "round(avg({0}), 6) AS mean, round(CASE WHEN count({0}) >= 2 AND stddev_samp({0}) > 0 THEN avg({0}) / (stddev_samp({0}) / sqrt(count({0}))) END, 5) AS t"


@query("h1_mean_t", "rec", f"SELECT question, count(*) AS days, {MT.format('r')} FROM rec GROUP BY 1")
def h1(spark, sf):
    out = stats.mean_t(records(spark, sf), ["question"], "r")
    return out.select("question", "days", rounded("mean").alias("mean"), rounded("t", 5).alias("t"))


@query("h2_split_halves", "rec", """
SELECT question, held, half, count(*) AS days, CAST(min(day) AS VARCHAR) AS first_day, CAST(max(day) AS VARCHAR) AS last_day FROM (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY question, held ORDER BY day) <= count(*) OVER (PARTITION BY question, held) // 2 THEN 1 ELSE 2 END AS half FROM rec JOIN (
    SELECT day, row_number() OVER (ORDER BY day DESC) <= 60 AS held FROM (SELECT DISTINCT day FROM rec)) USING (day)) GROUP BY 1, 2, 3""")
def h2(spark, sf):
    rows = records(spark, sf)
    tagged = rows.join(stats.split_days(rows, 60), "day")
    out = stats.halves(tagged, ["question", "held"])
    return out.groupBy("question", "held", "half").agg(F.count(F.lit(1)).alias("days"), day_text(F.min("day")).alias("first_day"), day_text(F.max("day")).alias("last_day"))


@query("h3_verdicts", "rec", judge_sql("(SELECT question, day, excess AS value FROM rec)", "rec", 60, 20, 2.0))
def h3(spark, sf):
    rows = records(spark, sf)
    return judge_out(stats.judge(rows.select("question", "day", F.col("excess").alias("value")), stats.split_days(rows, 60)))


@query("h3_forward_verdicts", "rec", forward_sql("(SELECT question, day, r AS value FROM rec)"))
def h3b(spark, sf):
    return forward_out(stats.forward_judge(records(spark, sf).select("question", "day", F.col("r").alias("value"))))


def spread_sql(source, keys):
    return f"""SELECT {keys}, coalesce(max(d) FILTER (side = 'good'), 0) AS good_days, coalesce(max(d) FILTER (side = 'bad'), 0) AS bad_days, max(m) FILTER (side = 'good') - max(m) FILTER (side = 'bad') AS difference,
  (max(m) FILTER (side = 'good') - max(m) FILTER (side = 'bad')) / sqrt(pow(max(se) FILTER (side = 'good'), 2) + pow(max(se) FILTER (side = 'bad'), 2)) AS t
 FROM (SELECT {keys}, side, count(*) AS d, avg(v) AS m, stddev_samp(v) / sqrt(count(*)) AS se FROM (SELECT {keys}, side, day, avg(excess) AS v FROM (
   SELECT *, CASE WHEN overlay_points >= 1 THEN 'good' WHEN overlay_points <= -1 THEN 'bad' END AS side FROM {source}) WHERE side IS NOT NULL GROUP BY {keys}, side, day) GROUP BY {keys}, side) GROUP BY {keys}"""


@query("h5_good_bad_spread", "rec", f"SELECT regime, good_days, bad_days, round(difference, 6) AS difference, round(t, 5) AS t FROM ({spread_sql('rec', 'regime')})")
def h5(spark, sf):
    out = stats.spread(records(spark, sf), ["regime"], good=F.col("overlay_points") >= 1, bad=F.col("overlay_points") <= -1, value="excess")
    return out.select("regime", "good_days", "bad_days", rounded("difference").alias("difference"), rounded("t", 5).alias("t"))


@query("h6_overlay_decision", "rec", f"""
WITH d AS (SELECT day, row_number() OVER (ORDER BY day) AS k FROM (SELECT DISTINCT day FROM rec)), n AS (SELECT max(k) AS entry_days FROM d),
 s60 AS ({spread_sql("(SELECT *, 1 AS one FROM rec JOIN d USING (day) WHERE k <= 60)", "one")}),
 pick AS (SELECT entry_days, CASE WHEN entry_days < 60 THEN NULL WHEN good_days >= 20 AND bad_days >= 20 THEN 60 WHEN entry_days >= 120 THEN 120 END AS sample_days FROM n, s60),
 ch AS (SELECT rec.*, k, sample_days, entry_days FROM rec JOIN d USING (day), pick WHERE k <= coalesce(sample_days, entry_days)),
 sl AS (SELECT *, unnest(['whole', CASE WHEN k <= coalesce(sample_days, entry_days) // 2 THEN 'first_half' ELSE 'second_half' END, CASE WHEN regime = 'RISK_ON' THEN 'risk_on' WHEN regime <> 'UNKNOWN' THEN 'other_regimes' END]) AS slice FROM ch),
 sp AS ({spread_sql("(SELECT * FROM sl WHERE slice IS NOT NULL)", "slice")}),
 h AS (SELECT slice, good_days, bad_days, difference, t, CASE WHEN good_days >= 5 AND bad_days >= 5 THEN difference > 0 END AS held FROM sp)
SELECT p.entry_days, CAST(p.sample_days AS BIGINT) AS sample_days, w.good_days, w.bad_days, round(w.difference, 6) AS difference, round(w.t, 5) AS t,
  (SELECT held FROM h WHERE slice = 'first_half') AS first_half, (SELECT held FROM h WHERE slice = 'second_half') AS second_half, (SELECT held FROM h WHERE slice = 'risk_on') AS risk_on, (SELECT held FROM h WHERE slice = 'other_regimes') AS other_regimes,
  w.good_days >= 20 AND w.bad_days >= 20 AND w.difference > 0 AND w.t >= 2 AND coalesce((SELECT held FROM h WHERE slice = 'first_half'), false) AND coalesce((SELECT held FROM h WHERE slice = 'second_half'), false)
    AND coalesce((SELECT held FROM h WHERE slice = 'risk_on'), true) AND coalesce((SELECT held FROM h WHERE slice = 'other_regimes'), true) AS passed
FROM pick p, h w WHERE w.slice = 'whole'""")
def h6(spark, sf):
    out = stats.overlay_review(records(spark, sf))
    return out.select(F.col("entry_days").cast("long").alias("entry_days"), F.col("sample_days").cast("long").alias("sample_days"), "good_days", "bad_days",
                      rounded("difference").alias("difference"), rounded("t", 5).alias("t"), "first_half", "second_half", "risk_on", "other_regimes", "passed")


@query("h7_by_age", "rec", f"""
SELECT bucket, count(*) AS days, {MT.format('v')} FROM (SELECT bucket, day, avg(excess) AS v FROM (SELECT *, CASE WHEN age_days < 1 THEN 'under 1 day' WHEN age_days < 3 THEN '1-3 days' WHEN age_days < 7 THEN '3-7 days' ELSE '7+ days' END AS bucket
  FROM rec WHERE age_days >= 0) GROUP BY 1, 2) GROUP BY 1""")
def h7(spark, sf):
    out = stats.by_age(records(spark, sf).select("age_days", "day", F.col("excess").alias("value")))
    return out.select("bucket", "days", rounded("mean").alias("mean"), rounded("t", 5).alias("t"))


@query("h8_gate_dates", "sess", """
WITH l AS (SELECT max(ordinal) AS lo, max(day) AS ld FROM sess)
SELECT o_orderkey, strftime(s.close_at, '%Y-%m-%d %H:%M:%S') AS earliest FROM (
  SELECT o_orderkey, CASE WHEN have < 60 AND d < ld THEN least(f + 60 - have + 5 - 1, lo) END AS ordinal FROM (
    SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, o_custkey % 80 AS have, (SELECT min(ordinal) FROM sess WHERE day >= CAST(o_orderdate AS DATE)) AS f FROM orders
    WHERE CAST(o_orderdate AS DATE) BETWEEN (SELECT min(day) FROM sess) AND (SELECT max(day) FROM sess)), l) x LEFT JOIN sess s USING (ordinal)""")
def h8(spark, sf):
    sess = fx.sessions(spark, sf)
    asks = load(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), (F.col("o_custkey") % 80).alias("have"), F.lit(60).alias("need"), F.lit(5).alias("horizon"))
    return stats.gate_dates(asks, cal.day_spine(sess), sess).select("o_orderkey", stamp_text("earliest").alias("earliest"))


@query("h9_sign_test", "rec", """
SELECT question, wins, losses, round(CASE WHEN wins + losses > 0 THEN (SELECT sum(exp(lgamma(wins + losses + 1.0) - lgamma(k + 1.0) - lgamma(wins + losses - k + 1.0) - (wins + losses) * ln(2.0))) FROM range(wins, wins + losses + 1) x(k)) END, 6) AS p
FROM (SELECT question, CAST(count(*) FILTER (excess > 0) AS BIGINT) AS wins, CAST(count(*) FILTER (excess < 0) AS BIGINT) AS losses FROM rec GROUP BY 1)""")
def h9(spark, sf):
    rows = records(spark, sf).groupBy("question").agg(F.count(F.when(F.col("excess") > 0, 1)).alias("wins"), F.count(F.when(F.col("excess") < 0, 1)).alias("losses"))
    return rows.select("question", "wins", "losses", rounded(stats.sign_test("wins", "losses")).alias("p"))


@query("h10_trimmed_mean", "rec", """
SELECT question, round(avg(r) FILTER (rn > cut AND rn <= n - cut), 6) AS trimmed, round(median(r), 6) AS median, count(*) AS n FROM (SELECT *, CAST(floor(n * 0.1) AS BIGINT) AS cut FROM (
  SELECT question, r, row_number() OVER (PARTITION BY question ORDER BY r) AS rn, count(*) OVER (PARTITION BY question) AS n FROM rec)) GROUP BY 1""")
def h10(spark, sf):
    rows = records(spark, sf).select("question", "r")
    t = trimmed_mean(rows, ["question"], "r")
    m = exact_quantile(rows, ["question"], "r").drop("n")
    return t.join(m, "question").select("question", rounded("trimmed").alias("trimmed"), rounded("median").alias("median"), "n")


@query("h11_ols_cluster")
def h11(spark, sf):
    """Signal-day difference with month effects and week clusters; X'X and scores are Spark sums."""
    days = records(spark, sf).groupBy("day").agg(F.avg("r").alias("f"), F.max(F.when(F.col("overlay_points") >= 1.9, 1).otherwise(0)).alias("signal"))
    days = days.withColumns({"month": F.date_format("day", "yyyy-MM"), "week": F.date_trunc("week", "day"), "monday": (F.weekday("day") == 0).cast("int"), "long": (F.dayofmonth("day") % 7 == 0).cast("int")})
    fit = stats.ols_cluster(days, "f", ["signal", "long", "monday"], "week", "signal", group="month")
    return spark.createDataFrame([(fit["b"], fit["t"], fit["n"], fit["clusters"], fit["dropped"])], "b double, t double, n long, clusters long, dropped string")
