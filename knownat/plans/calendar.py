"""Queries C1-C10."""

from __future__ import annotations

from pyspark.sql import functions as F

from knownat.functions.numeric import day_text, key_day, stamp_text
from knownat.operators import calendar as cal
from knownat.plans import fixtures as fx
from knownat.plans.registry import cte, query
from knownat.sources.tables import load

TS = "strftime({}, '%Y-%m-%d %H:%M:%S')"


@query("c1_is_session", "sess, asked", """
SELECT CAST(a.day AS VARCHAR) AS day, s.day IS NOT NULL AS is_session,
       a.day >= (SELECT min(day) FROM sess) AND a.day < (SELECT max(day) FROM sess) AS covered,
       CAST((SELECT min(day) FROM sess) AS VARCHAR) AS first_session, CAST((SELECT max(day) FROM sess) AS VARCHAR) AS last_session
FROM asked a LEFT JOIN sess s ON a.day = s.day""")
def c1(spark, sf):
    out = cal.is_session(fx.asked_days(spark, sf), fx.sessions(spark, sf))
    return out.select(day_text("day").alias("day"), "is_session", "covered", day_text("first_session").alias("first_session"),
                      day_text("last_session").alias("last_session"))


@query("c2_session_hours", "sess, asked", f"""
SELECT CAST(a.day AS VARCHAR) AS day, {TS.format('open_at')} AS open_at, {TS.format('close_at')} AS close_at
FROM asked a JOIN sess s ON a.day = s.day""")
def c2(spark, sf):
    out = cal.with_hours(fx.asked_days(spark, sf), fx.sessions(spark, sf))
    return out.select(day_text("day").alias("day"), stamp_text("open_at").alias("open_at"), stamp_text("close_at").alias("close_at"))


NEXT = """
SELECT CAST(a.day AS VARCHAR) AS day,
       CAST((SELECT min(s.day) FROM sess s WHERE s.day > a.day) AS VARCHAR) AS next_session,
       CAST((SELECT min(s.day) FROM sess s WHERE s.day >= a.day) AS VARCHAR) AS on_or_after{extra}
FROM asked a WHERE a.day BETWEEN (SELECT min(day) FROM sess) AND (SELECT max(day) FROM sess)"""


def _next(spark, sf):
    sess = fx.sessions(spark, sf)
    spine = cal.day_spine(sess)
    asked = fx.asked_days(spark, sf).join(spine.select("day"), "day", "left_semi")
    return cal.next_sessions(asked, spine)


@query("c3_next_session", "sess, asked", NEXT.format(extra=""))
def c3(spark, sf):
    return _next(spark, sf).select(day_text("day").alias("day"), day_text("next_session").alias("next_session"),
                                   day_text("on_or_after").alias("on_or_after"))


@query("c4_next_session_open", "sess, asked", NEXT.format(
    extra=",\n strftime((SELECT min(s.open_at) FROM sess s WHERE s.day > a.day), '%Y-%m-%d %H:%M:%S') AS next_open"))
def c4(spark, sf):
    return _next(spark, sf).select(day_text("day").alias("day"), day_text("next_session").alias("next_session"),
                                   day_text("on_or_after").alias("on_or_after"), stamp_text("next_open").alias("next_open"))


# instants: order days shifted by up to a day in minutes
cte("instant", """SELECT DISTINCT o_orderdate + to_minutes(o_custkey * 37 % 1440) AS at FROM orders
  WHERE CAST(o_orderdate AS DATE) BETWEEN (SELECT min(day) FROM sess) AND (SELECT max(day) FROM sess)""", "sess")


def instants(spark, sf, spine):
    rows = load(spark, sf, "orders").select(
        F.timestamp_add("MINUTE", (F.col("o_custkey") * 37 % 1440).cast("int"), F.col("o_orderdate")).alias("at"),
        F.to_date("o_orderdate").alias("day"))
    return rows.join(spine.select("day"), "day", "left_semi").select("at").distinct()


@query("c5_next_tradable_open", "sess, instant", f"""
SELECT {TS.format('i.at')} AS at, {TS.format('min(s.open_at)')} AS tradable_at
FROM instant i LEFT JOIN sess s ON s.open_at > i.at AND s.day >= CAST(i.at AS DATE) AND s.day <= CAST(i.at AS DATE) + 30 GROUP BY i.at""")
def c5(spark, sf):
    spine = cal.day_spine(fx.sessions(spark, sf))
    out = cal.next_tradable_open(instants(spark, sf, spine), spine)
    return out.select(stamp_text("at").alias("at"), stamp_text("tradable_at").alias("tradable_at"))


@query("c6_bar_completion", "bars, sess", f"""
SELECT instrument_id, CAST(b.day AS VARCHAR) AS day, {TS.format('s.close_at')} AS daily_known_at,
       {TS.format("s.open_at + INTERVAL 30 MINUTE")} AS half_hour_known_at FROM bars b JOIN sess s USING (day)""")
def c6(spark, sf):
    out = fx.bars(spark, sf).select("instrument_id", "day").join(fx.sessions(spark, sf), "day")
    return out.select("instrument_id", day_text("day").alias("day"),
                      stamp_text(cal.completed_at("open_at", "close_at")).alias("daily_known_at"),
                      stamp_text(cal.completed_at("open_at", minutes=30)).alias("half_hour_known_at"))


@query("c7_sessions_between", "sess", """
SELECT o_orderkey, CASE WHEN e <= d THEN 0 ELSE (SELECT count(*) FROM sess s WHERE s.day > d AND s.day <= e) END AS behind
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(o_orderdate AS DATE) + CAST(o_custkey % 40 AS INTEGER) AS e FROM orders)
WHERE d >= (SELECT min(day) FROM sess) AND e <= (SELECT max(day) FROM sess)""")
def c7(spark, sf):
    spine = cal.day_spine(fx.sessions(spark, sf))
    pairs = load(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"), F.date_add(
        F.to_date("o_orderdate"), (F.col("o_custkey") % 40).cast("int")).alias("e"))
    return cal.sessions_behind(_inside(pairs, spine), spine, "d", "e").select("o_orderkey", "behind")


def _inside(pairs, spine):
    known = spine.select("day")
    return pairs.join(known, F.col("d") == known["day"], "left_semi").join(known, F.col("e") == known["day"], "left_semi")


@query("c8_open_state", "sess, instant", f"""
SELECT {TS.format('i.at')} AS at, coalesce(i.at >= s.open_at AND i.at < s.close_at, false) AS is_open,
       coalesce(i.at >= s.close_at, false) AS has_closed, CAST(CAST(i.at AS DATE) AS VARCHAR) AS local_day
FROM instant i LEFT JOIN sess s ON s.day = CAST(i.at AS DATE)""")
def c8(spark, sf):
    sess = fx.sessions(spark, sf)
    out = cal.open_state(instants(spark, sf, cal.day_spine(sess)), sess)
    return out.select(stamp_text("at").alias("at"), "is_open", "has_closed", day_text("local_day").alias("local_day"))


@query("c9_traded_sessions", "sess, asked", """
SELECT CAST(s.day AS VARCHAR) AS day, s.ordinal FROM sess s WHERE s.day IN (SELECT day FROM asked)""")
def c9(spark, sf):
    out = cal.traded_sessions(fx.sessions(spark, sf), fx.asked_days(spark, sf))
    return out.select(day_text("day").alias("day"), "ordinal")


@query("c10_bar_boundary", "sess, instant", f"""
SELECT {TS.format('i.at')} AS at,
       {TS.format("s.open_at + to_minutes(CAST(ceil(date_diff('microsecond', s.open_at, i.at) / 60e6 / 30) * 30 AS BIGINT))")} AS boundary
FROM instant i JOIN sess s ON s.day = CAST(i.at AS DATE)""")
def c10(spark, sf):
    sess = fx.sessions(spark, sf)
    at = instants(spark, sf, cal.day_spine(sess))
    joined = at.withColumn("day", F.to_date("at")).join(sess, "day")
    return joined.select(stamp_text("at").alias("at"), stamp_text(cal.bar_boundary("at", "open_at", 30)).alias("boundary"))
