"""Queries I1-I9."""

from __future__ import annotations

from pyspark.sql import functions as F

from knownat.functions import numeric as num
from knownat.functions.numeric import day_text, key_day, rounded
from knownat.operators import indicators as ind
from knownat.plans import fixtures as fx
from knownat.plans.registry import cte, query

W20 = "(PARTITION BY instrument_id ORDER BY day ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
W60 = W20.replace("19", "59")
W250 = W20.replace("19", "249")


@query("i1_sma", "bars", f"""
SELECT instrument_id, CAST(day AS VARCHAR) AS day, round(CASE WHEN count(*) OVER {W20} = 20 THEN avg(close) OVER {W20} END, 6) AS sma20,
  round(CASE WHEN count(*) OVER {W60} = 60 THEN avg(close) OVER {W60} END, 6) AS sma60 FROM bars""")
def i1(spark, sf):
    return fx.bars(spark, sf).select(*key_day(), rounded(ind.sma("close", 20)).alias("sma20"), rounded(ind.sma("close", 60)).alias("sma60"))


cte("hist", f"""SELECT instrument_id, day, close, volume, list(close) OVER {W250} AS c FROM bars""", "bars")


@query("i2_ema", "hist", """
SELECT instrument_id, CAST(day AS VARCHAR) AS day, round(CASE WHEN len(c) = 20 THEN list_avg(c) WHEN len(c) > 20 THEN
  list_reduce(c[21:], lambda a, x: (x - a) * (2.0 / 21) + a, list_avg(c[1:20])) END, 6) AS ema20 FROM hist""")
def i2(spark, sf):
    return ind.recursive(fx.bars(spark, sf).select("instrument_id", "day", "close"), ["ema20"]).select(*key_day(), rounded("ema20").alias("ema20"))


cte("moves", """SELECT *, list_transform(range(2, len(c) + 1), lambda i: greatest(c[i] - c[i - 1], 0.0)) AS g,
  list_transform(range(2, len(c) + 1), lambda i: greatest(c[i - 1] - c[i], 0.0)) AS l FROM hist""", "hist")
SMOOTH = "CASE WHEN len({0}) = 14 THEN list_avg({0}) WHEN len({0}) > 14 THEN list_reduce({0}[15:], lambda a, x: (a * 13 + x) / 14, list_avg({0}[1:14])) END"
cte("rsi", f"""SELECT instrument_id, day, CASE WHEN len(c) >= 15 THEN CASE WHEN al = 0 THEN CASE WHEN ag > 0 THEN 100.0 ELSE 50.0 END
  ELSE 100.0 - 100.0 / (1.0 + ag / al) END END AS rsi FROM (SELECT *, {SMOOTH.format('g')} AS ag, {SMOOTH.format('l')} AS al FROM moves)""", "moves")


@query("i3_rsi", "rsi", "SELECT instrument_id, CAST(day AS VARCHAR) AS day, round(rsi, 6) AS rsi FROM rsi")
def i3(spark, sf):
    return ind.recursive(fx.bars(spark, sf).select("instrument_id", "day", "close"), ["rsi"]).select(*key_day(), rounded("rsi").alias("rsi"))


# the same recurrences as list folds: state [fast, slow, k, line, seed, signal]
cte("macd", """SELECT instrument_id, day, CASE WHEN len(c) >= 35 THEN s[4] END AS macd, CASE WHEN len(c) >= 35 THEN s[6] END AS signal,
  CASE WHEN len(c) >= 35 THEN s[4] - s[6] END AS histogram FROM (
  SELECT instrument_id, day, c, list_reduce(list_transform(c[27:], lambda x: [x]), lambda a, x: [
     (x[1] - a[1]) * (2.0 / 13) + a[1], (x[1] - a[2]) * (2.0 / 27) + a[2], a[3] + 1,
     ((x[1] - a[1]) * (2.0 / 13) + a[1]) - ((x[1] - a[2]) * (2.0 / 27) + a[2]),
     CASE WHEN a[3] + 1 <= 9 THEN a[5] + ((x[1] - a[1]) * (2.0 / 13) + a[1]) - ((x[1] - a[2]) * (2.0 / 27) + a[2]) ELSE a[5] END,
     CASE WHEN a[3] + 1 < 9 THEN 0.0 WHEN a[3] + 1 = 9 THEN (a[5] + ((x[1] - a[1]) * (2.0 / 13) + a[1]) - ((x[1] - a[2]) * (2.0 / 27) + a[2])) / 9.0
          ELSE (((x[1] - a[1]) * (2.0 / 13) + a[1]) - ((x[1] - a[2]) * (2.0 / 27) + a[2]) - a[6]) * 0.2 + a[6] END],
     [f0, s0, 1.0, f0 - s0, f0 - s0, 0.0]) AS s
  FROM (SELECT *, list_reduce(c[13:26], lambda a, x: (x - a) * (2.0 / 13) + a, list_avg(c[1:12])) AS f0, list_avg(c[1:26]) AS s0 FROM hist WHERE len(c) >= 27)
  UNION ALL SELECT instrument_id, day, c, NULL FROM hist WHERE len(c) < 27)""", "hist")


@query("i4_macd", "macd", """SELECT instrument_id, CAST(day AS VARCHAR) AS day, round(macd, 6) AS macd, round(signal, 6) AS signal, round(histogram, 6) AS histogram FROM macd""")
def i4(spark, sf):
    lines = ["macd", "signal", "histogram"]
    return ind.recursive(fx.bars(spark, sf).select("instrument_id", "day", "close"), lines).select(*key_day(), *[rounded(c).alias(c) for c in lines])


@query("i5_bollinger", "bars", f"""
SELECT instrument_id, CAST(day AS VARCHAR) AS day, round(CASE WHEN n = 20 THEN m + 2 * s END, 6) AS upper, round(CASE WHEN n = 20 THEN m - 2 * s END, 6) AS lower,
  round(CASE WHEN n = 20 THEN CASE WHEN s = 0 THEN 0.5 ELSE (close - (m - 2 * s)) / (4 * s) END END, 6) AS position
FROM (SELECT *, avg(close) OVER {W20} AS m, stddev_pop(close) OVER {W20} AS s, count(*) OVER {W20} AS n FROM bars)""")
def i5(spark, sf):
    upper, _, lower = ind.bollinger("close")
    out = fx.bars(spark, sf).select("instrument_id", "day", "close", upper.alias("u"), lower.alias("l"))
    return out.select(*key_day(), rounded("u").alias("upper"), rounded("l").alias("lower"), rounded(ind.band_position("close", F.col("u"), F.col("l"))).alias("position"))


@query("i6_zscore", "bars", f"""
SELECT instrument_id, CAST(day AS VARCHAR) AS day, round(CASE WHEN n = 20 THEN CASE WHEN s = 0 THEN 0.0 ELSE (volume - m) / s END END, 6) AS z
FROM (SELECT *, avg(volume) OVER {W20} AS m, stddev_pop(volume) OVER {W20} AS s, count(*) OVER {W20} AS n FROM bars)""")
def i6(spark, sf):
    return fx.bars(spark, sf).select(*key_day(), rounded(ind.zscore("volume", 20)).alias("z"))


@query("i7_percent_distance", "bars", """
SELECT instrument_id, CAST(day AS VARCHAR) AS day, round((close - open) / open * 100, 6) AS from_open, CASE WHEN close - close <> 0 THEN 1.0 END AS from_zero FROM bars""")
def i7(spark, sf):
    return fx.bars(spark, sf).select(*key_day(), rounded(num.percent_distance("close", "open")).alias("from_open"),
                                     num.percent_distance("close", F.lit(0.0)).alias("from_zero"))


@query("i8_percentile_rank", "bars", """
SELECT instrument_id, volume, round((below + 0.5 * equal) / n * 100, 6) AS pct_rank FROM (
  SELECT DISTINCT instrument_id, volume, rank() OVER (PARTITION BY instrument_id ORDER BY volume) - 1 AS below,
    count(*) OVER (PARTITION BY instrument_id, volume) AS equal, count(*) OVER (PARTITION BY instrument_id) AS n FROM bars)""")
def i8(spark, sf):
    ranked = ind.percentile_rank(fx.bars(spark, sf).select("instrument_id", "volume"), ["instrument_id"], "volume")
    return ranked.select("instrument_id", "volume", rounded("pct_rank").alias("pct_rank"))


@query("i9_scales", "bars", """
SELECT instrument_id, CAST(day AS VARCHAR) AS day, round(least(1, greatest(0, (close - 105) / 20)) * 100, 6) AS b, round((1 - least(1, greatest(0, (close - 105) / 20))) * 100, 6) AS inv,
  round(greatest(0, 1 - abs(close - 130) / 25) * 100, 6) AS peak, round(greatest(0, least(100, close - 50)), 10) AS clamped FROM bars""")
def i9(spark, sf):
    return fx.bars(spark, sf).select(*key_day(), rounded(num.bounded("close", 105, 125)).alias("b"), rounded(num.bounded("close", 105, 125, invert=True)).alias("inv"),
                                     rounded(num.peak_at("close", 130, 25)).alias("peak"), rounded(num.clamp(F.col("close") - 50), 10).alias("clamped"))
