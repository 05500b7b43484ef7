"""Queries T1-T12 (batch; the stream itself is tested in tests/test_streaming.py)."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from knownat.functions.numeric import day_text, key_day, rounded, stamp_text
from knownat.operators import intraday as intra
from knownat.plans import fixtures as fx
from knownat.plans.registry import cte, query
from knownat.sources.tables import load
from knownat.streaming import ticks as live

FMT = "'%Y-%m-%d %H:%M:%S'"
cte("tick", "SELECT 'C' || user_id % 20 AS code, ts, value AS price, event_id AS arrival, 1 + event_id % 50 AS volume FROM events")


def ticks(spark, sf):
    return load(spark, sf, "events").select(
        F.concat(F.lit("C"), (F.col("user_id") % 20).cast("string")).alias("code"), "ts", F.col("value").alias("price"),
        F.col("event_id").alias("arrival"), (F.col("event_id") % 50 + 1).alias("volume"))


def bar_sql(unit):
    return f"""SELECT code, strftime(date_trunc('{unit}', ts), {FMT}) AS start, arg_min(price, arrival) AS open, max(price) AS high, min(price) AS low,
  arg_max(price, arrival) AS close, CAST(sum(volume) AS BIGINT) AS volume, count(*) AS ticks FROM tick GROUP BY code, date_trunc('{unit}', ts)"""


def bar_out(df):
    return df.select("code", stamp_text("start").alias("start"), "open", "high", "low", "close", "volume", "ticks")


@query("t1_minute_bars", "tick", bar_sql("minute"))
def t1(spark, sf):
    return bar_out(live.bars(ticks(spark, sf), "1 minute"))


@query("t1_second_bars", "tick", bar_sql("second"))
def t1b(spark, sf):
    return bar_out(live.bars(ticks(spark, sf), "1 second"))


@query("t3_saved_bars", "tick", bar_sql("second"))
def t3(spark, sf):
    """Second bars saved batch by batch: ticks come in seven batches out of order, and what was saved before folds with what comes."""
    rows = ticks(spark, sf)
    saved = None
    for k in range(7):
        batch = live.partial_bars(rows.where(F.col("arrival") * 31 % 7 == k), "1 second")
        saved = batch if saved is None else saved.unionByName(batch)
        saved = live.folded(saved) if k == 3 else saved  # a compaction on the way
    return bar_out(live.folded(saved))


@query("t2_frame_parse", "", """
SELECT user_id % 20 AS code, strftime(ts, '%H%M%S') AS at, value AS price, CAST(1 + event_id % 50 AS BIGINT) AS volume FROM events WHERE event_id % 13 <> 0""")
def t2(spark, sf):
    """Events written as wire frames (two records each) and parsed back; broken records drop out."""
    rows = load(spark, sf, "events")
    fields = [F.lit("0")] * live.WIDTH
    fields[live.CODE] = (F.col("user_id") % 20).cast("string")
    fields[live.TIME] = F.date_format("ts", "HHmmss")
    fields[live.PRICE] = F.when(F.col("event_id") % 13 == 0, F.lit("x")).otherwise(F.col("value").cast("string"))
    fields[live.VOLUME] = (F.col("event_id") % 50 + 1).cast("string")
    record = F.concat_ws("^", *fields)
    # pair neighbours by id so a frame carries one or two records
    pairs = rows.select((F.col("event_id") / 2).cast("long").alias("f"), "event_id", record.alias("r"))
    frames = pairs.groupBy("f").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "r"))), lambda x: x["r"]), "^").alias("body"),
                                    F.count(F.lit(1)).alias("n"))
    raw = frames.select(F.concat(F.lit(f"0|{live.TRADE}|"), F.col("n").cast("string"), F.lit("|"), F.col("body")).alias("raw"))
    return live.parse_frames(raw).select(F.col("code").cast("long").alias("code"), "at", "price", "volume")


@query("t4_seed_minutes", "tick", f"""
WITH t AS (SELECT code, date_trunc('minute', ts) AS start, arg_max(price, arrival) AS close FROM tick WHERE arrival % 2 = 0 GROUP BY 1, 2),
 s AS (SELECT code, date_trunc('minute', ts) AS start, arg_min(price, arrival) AS close FROM tick WHERE arrival % 3 = 0 GROUP BY 1, 2)
SELECT coalesce(t.code, s.code) AS code, strftime(coalesce(t.start, s.start), {FMT}) AS start, coalesce(t.close, s.close) AS close, CASE WHEN t.code IS NOT NULL THEN 'TICK' ELSE 'SEED' END AS origin
FROM t FULL JOIN s ON t.code = s.code AND t.start = s.start""")
def t4(spark, sf):
    rows = ticks(spark, sf)
    own = live.bars(rows.where("arrival % 2 = 0"), "1 minute").select("code", "start", "close")
    seed = rows.where("arrival % 3 = 0").groupBy("code", F.date_trunc("minute", "ts").alias("start")).agg(F.min_by("price", "arrival").alias("close"))
    return intra.seeded(own, seed, ["code", "start"]).select("code", stamp_text("start").alias("start"), "close", "origin")


@query("t5_thinned_series", "mbars", """
SELECT instrument_id, CAST(day AS VARCHAR) AS day, minute, round(close, 6) AS close FROM (
  SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY instrument_id, day) AS n FROM mbars WINDOW w AS (PARTITION BY instrument_id, day ORDER BY minute)) b
WHERE n <= 20 OR i IN (SELECT round_even(k * (n - 1) / 19.0, 0) FROM range(20) t(k))""")
def t5(spark, sf):
    out = intra.thinned(fx.minute_bars(spark, sf), ["instrument_id", "day"], "minute", 20)
    return out.select(*key_day(), "minute", rounded("close").alias("close"))


BUCKET = "greatest(least({0} // 30, 12), 0)"


@query("t6_half_hours", "mbars", f"""
SELECT {BUCKET.format('minute')} AS bucket, count(*) AS bars, round(sum(volume), 4) AS volume FROM mbars GROUP BY 1""")
def t6(spark, sf):
    return fx.minute_bars(spark, sf).groupBy(intra.half_hour("minute").alias("bucket")).agg(
        F.count(F.lit(1)).alias("bars"), rounded(F.sum("volume"), 4).alias("volume"))


cte("summary", """
SELECT instrument_id, day, bars, open, close, volume, high_at, low_at, peak_volume_at, vwap, (close / open - 1) * 100 AS return_pct, (high / open - 1) * 100 AS mfe_pct, (low / open - 1) * 100 AS mae_pct,
  high_at - first_at AS minutes_to_high, (close / vwap - 1) * 100 AS close_vs_vwap_pct, CASE WHEN rn >= 2 THEN sqrt(r2) * 100 END AS volatility_pct, (hour_close / open - 1) * 100 AS first_hour_pct
FROM (SELECT instrument_id, day, count(*) AS bars, arg_min(open, minute) AS open, arg_max(close, minute) AS close, max(high) AS high, min(low) AS low, min(minute) AS first_at,
   arg_min(minute, row(-high, minute)) AS high_at, arg_min(minute, row(low, minute)) AS low_at, sum(volume) AS volume, sum((high + low + close) / 3 * volume) / sum(volume) AS vwap,
   sum(r * r) AS r2, count(r) AS rn, arg_min(minute, CASE WHEN minute NOT IN (0, 390) THEN row(-volume, minute) END) AS peak_volume_at, arg_max(close, minute) FILTER (minute < 60) AS hour_close
  FROM (SELECT *, ln(close / lag(close) OVER (PARTITION BY instrument_id, day ORDER BY minute)) AS r FROM mbars) GROUP BY 1, 2)""", "mbars")
SUMMARY_COLS = ["vwap", "return_pct", "mfe_pct", "mae_pct", "close_vs_vwap_pct", "volatility_pct", "first_hour_pct"]


@query("t7_day_summary", "summary", f"""
SELECT instrument_id, CAST(day AS VARCHAR) AS day, bars, high_at, low_at, minutes_to_high, peak_volume_at, {', '.join(f'round({c}, 5) AS {c}' for c in SUMMARY_COLS)} FROM summary""")
def t7(spark, sf):
    out = intra.day_summary(fx.minute_bars(spark, sf))
    return out.select(*key_day(), "bars", "high_at", "low_at", "minutes_to_high", "peak_volume_at", *[rounded(c, 5).alias(c) for c in SUMMARY_COLS])


cte("bucket", f"""SELECT instrument_id, day, bucket, bars, (c / o - 1) * 100 AS return_pct, v / sum(v) OVER (PARTITION BY instrument_id, day) AS volume_share FROM (
  SELECT instrument_id, day, {BUCKET.format('minute')} AS bucket, count(*) AS bars, arg_min(open, minute) AS o, arg_max(close, minute) AS c, sum(volume) AS v FROM mbars GROUP BY 1, 2, 3)""", "mbars")


@query("t7_day_buckets", "bucket", "SELECT instrument_id, CAST(day AS VARCHAR) AS day, bucket, bars, round(return_pct, 6) AS return_pct, round(volume_share, 6) AS volume_share FROM bucket")
def t7b(spark, sf):
    bars = fx.minute_bars(spark, sf)
    nested = intra.with_buckets(intra.day_summary(bars), intra.day_buckets(bars))
    return nested.select("instrument_id", "day", F.explode("buckets").alias("b")).select(
        *key_day(), "b.bucket", "b.bars", rounded("b.return_pct").alias("return_pct"), rounded("b.volume_share").alias("volume_share"))


FULL = 34
cte("market", f"""SELECT coalesce(a.day, b.day) AS day, CASE WHEN n = {FULL} THEN (c / o - 1) * 100 WHEN dopen > 0 THEN (dc / dopen - 1) * 100 END AS market_return_pct,
  CASE WHEN n = {FULL} THEN 'INDEX_MINUTE' WHEN dopen > 0 THEN 'DAILY' END AS market_source FROM
  (SELECT day, count(*) AS n, arg_min(open, minute) AS o, arg_max(close, minute) AS c FROM mbars WHERE instrument_id = 0 GROUP BY 1) a
  FULL JOIN (SELECT day, arg_min(open, minute) AS dopen, arg_max(close, minute) AS dc FROM mbars WHERE instrument_id = 1 GROUP BY 1) b ON a.day = b.day""", "mbars")


def market(spark, sf):
    """Instrument 0 plays the index by minute, instrument 1 its daily bar."""
    bars = fx.minute_bars(spark, sf)
    daily = bars.where("instrument_id = 1").groupBy("day").agg(F.min_by("open", "minute").alias("open"), F.max_by("close", "minute").alias("close"))
    return intra.index_days(bars.where("instrument_id = 0"), daily, full=FULL)


@query("t8_index_day", "market", "SELECT CAST(day AS VARCHAR) AS day, round(market_return_pct, 6) AS market_return_pct, market_source FROM market")
def t8(spark, sf):
    return market(spark, sf).select(day_text("day").alias("day"), rounded("market_return_pct").alias("market_return_pct"), "market_source")


STATUS = "CASE event_type WHEN 'click' THEN 'COMPLETE' WHEN 'view' THEN 'PARTIAL' ELSE 'EMPTY' END"


@query("t9_incremental_days", "", f"""
WITH f AS (SELECT user_id AS instrument_id, CAST(ts AS DATE) AS day, {STATUS} AS status, ts, event_id FROM events),
 now AS (SELECT instrument_id, day, arg_max(status, row(ts, event_id)) AS status FROM f GROUP BY 1, 2),
 done AS (SELECT instrument_id, day, arg_max(status, row(ts, event_id)) AS status FROM f WHERE event_id % 2 = 0 GROUP BY 1, 2)
SELECT n.instrument_id, CAST(n.day AS VARCHAR) AS day, n.status, CASE WHEN d.status IS NULL THEN 'NEW' ELSE 'REPLACED' END AS change FROM now n LEFT JOIN done d USING (instrument_id, day)
WHERE d.status IS NULL OR NOT (d.status IN ('COMPLETE', 'UNMEASURABLE') OR d.status = n.status)""")
def t9(spark, sf):
    status = F.when(F.col("event_type") == "click", "COMPLETE").when(F.col("event_type") == "view", "PARTIAL").otherwise("EMPTY")
    rows = load(spark, sf, "events").select(F.col("user_id").alias("instrument_id"), F.to_date("ts").alias("day"), status.alias("status"),
                                            F.col("ts").alias("fetched_at"), F.col("event_id").alias("id"))
    out = intra.to_analyse(intra.latest_status(rows), intra.latest_status(rows.where("id % 2 = 0")))
    return out.select(*key_day(), "status", "change")


@query("t9_fill_market", "summary, market", """
SELECT instrument_id, CAST(day AS VARCHAR) AS day, round(s.return_pct, 6) AS return_pct, round(m.market_return_pct, 6) AS market_return_pct, m.market_source FROM summary s LEFT JOIN market m USING (day)""")
def t9b(spark, sf):
    rows = intra.day_summary(fx.minute_bars(spark, sf)).withColumns({"market_return_pct": F.lit(None).cast("double"), "market_source": F.lit(None).cast("string")})
    out = intra.fill_market(rows, market(spark, sf))
    return out.select(*key_day(), rounded("return_pct").alias("return_pct"), rounded("market_return_pct").alias("market_return_pct"), "market_source")


@query("t10_bucket_baseline", "summary, bucket", f"""
SELECT bucket, round(volume_share, 6) AS volume_share, round(abs_return, 6) AS abs_return, round(high_share, 6) AS high_share FROM
 (SELECT bucket, avg(volume_share) AS volume_share, avg(abs(return_pct)) AS abs_return FROM bucket GROUP BY 1) FULL JOIN
 (SELECT {BUCKET.format('high_at')} AS bucket, count(*) / (SELECT count(*) FROM summary) AS high_share FROM summary GROUP BY 1) USING (bucket)""")
def t10(spark, sf):
    bars = fx.minute_bars(spark, sf)
    out = intra.bucket_baseline(intra.day_summary(bars), intra.day_buckets(bars))
    return out.select("bucket", *[rounded(c).alias(c) for c in ("volume_share", "abs_return", "high_share")])


@query("t10_excursion_medians", "summary", """
SELECT 'mfe' AS measure, round(median(mfe_pct), 6) AS median, count(*) AS n FROM summary UNION ALL SELECT 'mae', round(median(mae_pct), 6), count(*) FROM summary""")
def t10b(spark, sf):
    return intra.excursion_medians(intra.day_summary(fx.minute_bars(spark, sf))).select("measure", rounded("median").alias("median"), "n")


@query("t11_half_hour_peak", "mbars", """
SELECT instrument_id, CAST(day AS VARCHAR) AS day, round((h / o - 1) * 100, 6) AS peak_930, coalesce(h = l, false) AS flat_930, coalesce(top = bottom, false) AS locked FROM (
  SELECT instrument_id, day, arg_min(open, minute) AS o, max(high) FILTER (minute < 30) AS h, min(low) FILTER (minute < 30) AS l,
    max(greatest(open, high, low, close)) FILTER (minute < 30) AS top, min(least(open, high, low, close)) FILTER (minute < 30) AS bottom FROM mbars GROUP BY 1, 2)""")
def t11(spark, sf):
    return intra.half_hour_peak(fx.minute_bars(spark, sf)).select(*key_day(), rounded("peak_930").alias("peak_930"), "flat_930", "locked")


cte("path", """SELECT instrument_id, day, any_value(e) AS entry, any_value(h25) AS hit_25, any_value(h5) AS hit_5, (min(low) FILTER (h25 IS NULL OR minute <= h25) / any_value(e) - 1) * 100 AS low_before_25,
   (arg_max(close, minute) FILTER (minute >= 1) / any_value(e) - 1) * 100 AS at_10 FROM (
  SELECT *, min(minute) FILTER (minute >= 1 AND high >= e * 1.025) OVER (PARTITION BY instrument_id, day) AS h25, min(minute) FILTER (minute >= 1 AND high >= e * 1.05) OVER (PARTITION BY instrument_id, day) AS h5 FROM (
   SELECT *, max(open) FILTER (minute = 0) OVER (PARTITION BY instrument_id, day) AS e FROM mbars WHERE minute < 60) WHERE e > 0) GROUP BY 1, 2 HAVING count(*) FILTER (minute >= 1) > 0""", "mbars")


@query("t12_early_path", "path", """SELECT instrument_id, CAST(day AS VARCHAR) AS day, round(entry, 6) AS entry, hit_25, hit_5, round(low_before_25, 6) AS low_before_25, round(at_10, 6) AS at_10 FROM path""")
def t12(spark, sf):
    out = intra.early_path(fx.minute_bars(spark, sf))
    return out.select(*key_day(), rounded("entry").alias("entry"), "hit_25", "hit_5", rounded("low_before_25").alias("low_before_25"), rounded("at_10").alias("at_10"))
