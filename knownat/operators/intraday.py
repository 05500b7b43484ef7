"""Minute-bar analytics.  Minutes count from 09:00 (0) to 15:30 (390).

A (instrument, day) group holds at most 391 minute bars however many ticks built them, so windows
and aggregates over a day are bounded; all of a day's work happens after one shuffle on that key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from knownat.functions import numeric as num
from knownat.functions.scale import exact_quantile, newest

OPEN_AUCTION, CLOSE_AUCTION = 0, 390
BUCKETS = 13
DAY = ("instrument_id", "day")


def half_hour(minute: Column | str) -> Column:
    """Half-hour bucket 0..12; the closing auction belongs to the last one."""
    m = F.col(minute) if isinstance(minute, str) else minute
    return F.greatest(F.least(F.floor(m / 30), F.lit(BUCKETS - 1)), F.lit(0)).cast("long")


def day_summary(bars: DataFrame) -> DataFrame:
    """One row per (instrument, day); days whose first open is not positive drop out."""
    w = W.partitionBy(*DAY).orderBy("minute")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    good = F.when(F.col("close") > 0, F.col("close"))
    step = F.log(good / F.last(good, ignorenulls=True).over(before))
    rows = bars.withColumn("_r", step)
    inside = ~F.col("minute").isin(OPEN_AUCTION, CLOSE_AUCTION)
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3 * F.col("volume")
    agg = rows.groupBy(*DAY).agg(
        F.count(F.lit(1)).alias("bars"),
        F.min_by("open", "minute").alias("open"),
        F.max_by("close", "minute").alias("close"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.min("minute").alias("_first"),
        F.min_by("minute", F.struct(-F.col("high"), "minute")).alias("high_at"),
        F.min_by("minute", F.struct("low", "minute")).alias("low_at"),
        F.sum("volume").alias("volume"),
        F.sum(typical).alias("_typical"),
        F.sum(F.col("_r") * F.col("_r")).alias("_r2"),
        F.count("_r").alias("_rn"),
        F.min_by("minute", F.when(inside, F.struct(-F.col("volume"), F.col("minute")))).alias("peak_volume_at"),
        F.max_by("close", F.when(F.col("minute") < 60, F.col("minute"))).alias("_hour_close"),
    ).where("open > 0")
    vwap = F.when(F.col("volume") > 0, F.col("_typical") / F.col("volume"))
    return agg.withColumn("vwap", vwap).select(
        *DAY, "bars", "open", "close", "volume", "vwap", "high_at", "low_at", "peak_volume_at",
        num.percent_change("open", "close").alias("return_pct"),
        num.percent_change("open", "high").alias("mfe_pct"),
        num.percent_change("open", "low").alias("mae_pct"),
        (F.col("high_at") - F.col("_first")).alias("minutes_to_high"),
        num.percent_change("vwap", "close").alias("close_vs_vwap_pct"),
        F.when(F.col("_rn") >= 2, F.sqrt("_r2") * 100).alias("volatility_pct"),
        F.when(F.col("_hour_close").isNotNull(), num.percent_change("open", "_hour_close")).alias("first_hour_pct"),
    )


def day_buckets(bars: DataFrame) -> DataFrame:
    """Return and share of volume of each traded half hour."""
    per = bars.withColumn("bucket", half_hour("minute")).groupBy(*DAY, "bucket").agg(
        F.count(F.lit(1)).alias("bars"), F.min_by("open", "minute").alias("_o"), F.max_by("close", "minute").alias("_c"),
        F.sum("volume").alias("_v"),
    )
    total = F.sum("_v").over(W.partitionBy(*DAY))
    return per.select(
        *DAY, "bucket", "bars",
        F.when(F.col("_o") > 0, num.percent_change("_o", "_c")).alias("return_pct"),
        F.when(total > 0, F.col("_v") / total).alias("volume_share"),
    )


def with_buckets(summaries: DataFrame, buckets: DataFrame) -> DataFrame:
    """Summaries with their buckets nested, as stored."""
    nested = buckets.groupBy(*DAY).agg(
        F.sort_array(F.collect_list(F.struct("bucket", "return_pct", "volume_share", "bars"))).alias("buckets")
    )
    return summaries.join(nested, list(DAY))


def index_days(minutes: DataFrame, daily: DataFrame, *, full: int = 391) -> DataFrame:
    """Market return of a day: from minutes if the day is complete, else from the daily bar, and say which."""
    from_minutes = minutes.groupBy("day").agg(
        F.count(F.lit(1)).alias("_n"), F.min_by("open", "minute").alias("_o"), F.max_by("close", "minute").alias("_c")
    )
    joined = from_minutes.join(daily.select("day", F.col("open").alias("_do"), F.col("close").alias("_dc")), "day", "full")
    whole = (F.col("_n") == full) & (F.col("_o") > 0)
    by_day = F.col("_do") > 0
    return joined.select(
        "day",
        F.when(whole, num.percent_change("_o", "_c")).when(by_day, num.percent_change("_do", "_dc")).alias("market_return_pct"),
        F.when(whole, "INDEX_MINUTE").when(by_day, "DAILY").alias("market_source"),
    )


def to_analyse(statuses: DataFrame, done: DataFrame) -> DataFrame:
    """Days whose newest fetch status is new or changed; finished days are never redone."""
    prior = done.select(*DAY, F.col("status").alias("_was"))
    joined = statuses.join(prior, list(DAY), "left")
    settled = F.col("_was").isin("COMPLETE", "UNMEASURABLE") | (F.col("_was") == F.col("status"))
    return joined.where(~F.coalesce(settled, F.lit(False))).select(
        *DAY, "status", F.when(F.col("_was").isNull(), "NEW").otherwise("REPLACED").alias("change")
    )


def fill_market(summaries: DataFrame, market: DataFrame) -> DataFrame:
    """Give summaries without a market figure the one that has arrived since."""
    late = market.select("day", F.col("market_return_pct").alias("_m"), F.col("market_source").alias("_s"))
    return summaries.join(late, "day", "left").withColumns({
        "market_return_pct": F.coalesce("market_return_pct", "_m"), "market_source": F.coalesce("market_source", "_s"),
    }).drop("_m", "_s")


def bucket_baseline(summaries: DataFrame, buckets: DataFrame) -> DataFrame:
    """Mean share of volume, mean absolute return and share of day highs per half hour."""
    per = buckets.groupBy("bucket").agg(
        F.avg("volume_share").alias("volume_share"), F.avg(F.abs("return_pct")).alias("abs_return")
    )
    highs = summaries.groupBy(half_hour("high_at").alias("bucket")).agg(F.count(F.lit(1)).alias("_n"))
    total = highs.agg(F.sum("_n").alias("_all"))
    share = highs.join(total, F.col("_n").isNotNull()).select("bucket", (F.col("_n") / F.col("_all")).alias("high_share"))
    return per.join(share, "bucket", "full")


def excursion_medians(summaries: DataFrame) -> DataFrame:
    """Exact medians of the day's best and worst move over all name-days."""
    long = summaries.select(F.explode(F.array(
        F.struct(F.lit("mfe").alias("measure"), F.col("mfe_pct").alias("value")),
        F.struct(F.lit("mae").alias("measure"), F.col("mae_pct").alias("value")),
    )).alias("_m")).select("_m.*")
    return exact_quantile(long, ["measure"], "value")


def half_hour_peak(bars: DataFrame) -> DataFrame:
    """Best price before 09:30 against the first open, and whether every bar until then was one price."""
    first = bars.groupBy(*DAY).agg(
        F.min_by("open", "minute").alias("_o"),
        F.max(F.when(F.col("minute") < 30, F.col("high"))).alias("_h"),
        F.min(F.when(F.col("minute") < 30, F.col("low"))).alias("_l"),
        *[f(F.when(F.col("minute") < 30, g("open", "high", "low", "close"))).alias(n)
          for f, g, n in ((F.max, F.greatest, "_top"), (F.min, F.least, "_bottom"))],
    )
    usable = F.col("_h").isNotNull() & (F.col("_o") > 0)
    return first.select(
        *DAY,
        F.when(usable, num.percent_change("_o", "_h")).alias("peak_930"),
        F.coalesce(usable & (F.col("_h") == F.col("_l")), F.lit(False)).alias("flat_930"),
        F.coalesce(F.col("_top") == F.col("_bottom"), F.lit(False)).alias("locked"),
    )


def early_path(bars: DataFrame) -> DataFrame:
    """First hour from the 09:00 open: first minute (from 09:01) at +2.5 % and +5 %, low until then, 10:00."""
    day = W.partitionBy(*DAY)
    hour = bars.where("minute >= 0 AND minute < 60").withColumn(
        "_e", F.max(F.when(F.col("minute") == 0, F.col("open"))).over(day)
    ).where("_e > 0")
    sellable = F.col("minute") >= 1

    def hit(target: float) -> Column:
        return F.min(F.when(sellable & (F.col("high") >= F.col("_e") * (1 + target)), F.col("minute"))).over(day)

    marked = hour.withColumns({"_h25": hit(0.025), "_h5": hit(0.05)})
    upto = F.col("_h25").isNull() | (F.col("minute") <= F.col("_h25"))
    return marked.groupBy(*DAY).agg(
        F.first("_e").alias("entry"),
        F.first("_h25").alias("hit_25"),
        F.first("_h5").alias("hit_5"),
        F.min(F.when(upto, F.col("low"))).alias("_low"),
        F.max_by("close", F.when(sellable, F.col("minute"))).alias("_last"),
        F.count(F.when(sellable, 1)).alias("_n"),
    ).where("_n > 0").select(
        *DAY, "entry", "hit_25", "hit_5",
        ((F.col("_low") / F.col("entry") - 1) * 100).alias("low_before_25"),
        ((F.col("_last") / F.col("entry") - 1) * 100).alias("at_10"),
    )


def ohlc(ticks: DataFrame, keys: Sequence[str], *, price: str = "price", arrival: str = "arrival", volume: str = "volume") -> DataFrame:
    """Bars from ticks: open and close follow arrival order, not trade time.  Partial aggregation only."""
    return ticks.groupBy(*keys).agg(
        F.min_by(price, arrival).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
        F.max_by(price, arrival).alias("close"), F.sum(volume).alias("volume"), F.count(F.lit(1)).alias("ticks"),
    )


def seeded(ticked: DataFrame, seed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Earlier minutes from a seed; a bar built from ticks wins."""
    values = [c for c in ticked.columns if c not in keys]
    s = seed.select(*keys, *[F.col(c).alias(f"_{c}") for c in values if c in seed.columns])
    joined = ticked.withColumn("_t", F.lit(True)).join(s, list(keys), "full")
    own = F.col("_t").isNotNull()
    return joined.select(
        *keys,
        *[F.when(own, F.col(c)).otherwise(F.col(f"_{c}") if c in seed.columns else F.lit(None)).alias(c) for c in values],
        F.when(own, "TICK").otherwise("SEED").alias("origin"),
    )


def thinned(rows: DataFrame, keys: Sequence[str], order: str, n: int = 60) -> DataFrame:
    """``n`` evenly spaced rows of each series, first and last kept (all of them when there are fewer)."""
    w = W.partitionBy(*keys).orderBy(order)
    numbered = rows.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count(F.lit(1)).over(W.partitionBy(*keys))})
    step = (F.col("_n") - 1) / F.lit(float(n - 1))
    # nearest kept slot, and whether its (half-even) rounded position is this row
    slot = F.bround(F.col("_i") / step)
    near = F.array(slot - 1, slot, slot + 1)
    picked = F.exists(near, lambda s: (s >= 0) & (s <= n - 1) & (F.bround(s * step) == F.col("_i")))
    return numbered.where((F.col("_n") <= n) | F.coalesce(picked, F.lit(False))).drop("_i", "_n")


def latest_status(fetches: DataFrame) -> DataFrame:
    return newest(fetches, list(DAY), ["fetched_at", "id"])
