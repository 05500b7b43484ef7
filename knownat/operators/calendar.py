"""Trading calendar as a dimension table.

``sessions(day, ordinal, prev_day, next_day, open_at, close_at)`` holds one row per trading
day of a market, so it is bounded by the number of calendar days whatever the data volume;
the windows over it below run on at most a few tens of thousands of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from knownat.functions.numeric import col

SESSION_MINUTES = 390


def sessions_from_days(days: DataFrame, *, open_minute: int = 0, minutes: int = SESSION_MINUTES) -> DataFrame:
    """Sessions from any table with a ``day`` column (partial distinct before the one-row-per-day window)."""
    by_day = W.orderBy("day")
    midnight = F.col("day").cast("timestamp")
    open_at = F.timestamp_add("MINUTE", F.lit(open_minute), midnight)
    return days.select("day").distinct().select(
        "day",
        F.row_number().over(by_day).cast("long").alias("ordinal"),
        F.lag("day").over(by_day).alias("prev_day"),
        F.lead("day").over(by_day).alias("next_day"),
        open_at.alias("open_at"),
        F.timestamp_add("MINUTE", F.lit(minutes), open_at).alias("close_at"),
    )


def day_spine(sessions: DataFrame) -> DataFrame:
    """Every calendar day between the first and last session with the neighbouring sessions.

    ``on_or_after`` / ``after`` are the next session including / excluding the day, ``on_or_before``
    the last one not after it; ``ordinal_upto`` counts sessions up to and including the day.
    """
    span = sessions.agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    days = span.select(F.explode(F.sequence("lo", "hi")).alias("day"))
    marked = days.join(
        sessions.select("day", "ordinal", "open_at", "close_at", F.col("day").alias("session")), "day", "left"
    )
    ahead = W.orderBy("day").rowsBetween(0, W.unboundedFollowing)
    past_today = W.orderBy("day").rowsBetween(1, W.unboundedFollowing)
    back = W.orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    return marked.select(
        "day",
        F.col("session").isNotNull().alias("is_session"),
        F.min("session").over(ahead).alias("on_or_after"),
        F.min("session").over(past_today).alias("after"),
        F.max("session").over(back).alias("on_or_before"),
        F.coalesce(F.max("ordinal").over(back), F.lit(0)).alias("ordinal_upto"),
        "open_at",
        "close_at",
        F.min("open_at").over(ahead).alias("on_or_after_open"),
        F.min("open_at").over(past_today).alias("after_open"),
    )


def is_session(days: DataFrame, sessions: DataFrame) -> DataFrame:
    """Flag each ``day``: a session, and inside the calendar (its last day is not covered)."""
    span = sessions.agg(F.min("day").alias("first_session"), F.max("day").alias("last_session"))
    flagged = days.join(sessions.select("day", F.lit(True).alias("_s")), "day", "left")
    # one row on the right, so this is a broadcast of a single tuple
    return flagged.join(span, F.col("day").isNotNull(), "left").select(
        *days.columns,
        F.coalesce("_s", F.lit(False)).alias("is_session"),
        ((F.col("day") >= F.col("first_session")) & (F.col("day") < F.col("last_session"))).alias("covered"),
        "first_session",
        "last_session",
    )


def with_hours(days: DataFrame, sessions: DataFrame) -> DataFrame:
    """Open and close instants of each session day (days that are no session drop out)."""
    return days.join(sessions.select("day", "open_at", "close_at"), "day")


def next_sessions(days: DataFrame, spine: DataFrame) -> DataFrame:
    """Next session strictly after, on-or-after, and the next session's open."""
    return days.join(
        spine.select("day", F.col("after").alias("next_session"), "on_or_after", F.col("after_open").alias("next_open")),
        "day",
        "left",
    )


def next_tradable_open(instants: DataFrame, spine: DataFrame, at: str = "at", *, name: str = "tradable_at") -> DataFrame:
    """First session open strictly after ``at``: today's if still ahead, else the next one's."""
    look = spine.select(
        F.col("day").alias("_d"), F.col("on_or_after").alias("_c"), F.col("on_or_after_open").alias("_o")
    )
    following = spine.select(F.col("day").alias("_fd"), F.col("after_open").alias("_fo"))
    joined = instants.withColumn("_d", F.to_date(at)).join(look, "_d", "left")
    joined = joined.join(following, F.col("_c") == F.col("_fd"), "left")
    return joined.withColumn(name, F.when(F.col("_o") > F.col(at), F.col("_o")).otherwise(F.col("_fo"))).drop(
        "_d", "_c", "_o", "_fd", "_fo"
    )


def completed_at(start: Column | str, close_at: Column | str | None = None, *, minutes: int | None = None) -> Column:
    """When a bar is known: ``minutes`` after its start, or the session close for a daily bar."""
    if minutes is not None:
        return F.timestamp_add("MINUTE", F.lit(minutes), col(start))
    return col(close_at)


def sessions_behind(pairs: DataFrame, spine: DataFrame, start: str, end: str, *, name: str = "behind") -> DataFrame:
    """Sessions strictly after ``start`` up to ``end``; 0 when ``end`` is not later."""
    a = spine.select(F.col("day").alias(start), F.col("ordinal_upto").alias("_a"))
    b = spine.select(F.col("day").alias(end), F.col("ordinal_upto").alias("_b"))
    return pairs.join(a, start, "left").join(b, end, "left").withColumn(
        name, F.when(F.col(end) <= F.col(start), F.lit(0)).otherwise(F.col("_b") - F.col("_a")).cast("long")
    ).drop("_a", "_b")


def open_state(instants: DataFrame, sessions: DataFrame, at: str = "at") -> DataFrame:
    """``is_open`` (close excluded) and ``has_closed`` (the local day's session is over) at each instant."""
    hours = sessions.select(F.col("day").alias("_day"), F.col("open_at").alias("_o"), F.col("close_at").alias("_c"))
    joined = instants.join(hours, F.to_date(at) == F.col("_day"), "left")
    t = F.col(at)
    return joined.select(
        *instants.columns,
        F.coalesce((t >= F.col("_o")) & (t < F.col("_c")), F.lit(False)).alias("is_open"),
        F.coalesce(t >= F.col("_c"), F.lit(False)).alias("has_closed"),
        F.to_date(at).alias("local_day"),
    )


def traded_sessions(sessions: DataFrame, bars: DataFrame) -> DataFrame:
    """Sessions on which anything traded at all: drops holidays the calendar missed."""
    return sessions.join(bars.select("day").distinct(), "day", "left_semi")


def bar_boundary(at: Column | str, open_at: Column | str, minutes: int) -> Column:
    """First bar start at or after ``at``, counting ``minutes``-long bars from the open."""
    at, open_at = col(at), col(open_at)
    elapsed = (F.unix_micros(at) - F.unix_micros(open_at)) / F.lit(60e6)
    steps = F.ceil(elapsed / minutes)
    return F.timestamp_add("MINUTE", (steps * minutes).cast("int"), open_at)


def session_grid(keys: DataFrame, sessions: DataFrame) -> DataFrame:
    """Every session of every key row: ordinals are generated per key and looked up by equality."""
    span = sessions.agg(F.min("ordinal").alias("_lo"), F.max("ordinal").alias("_hi"))
    # the span is a single row
    spread = keys.join(span, F.col("_lo").isNotNull()).withColumn("ordinal", F.explode(F.sequence("_lo", "_hi"))).drop("_lo", "_hi")
    return spread.join(sessions, "ordinal")
