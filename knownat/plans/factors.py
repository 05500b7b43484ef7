"""Queries F1-F15, K8 and P38."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from knownat.functions.numeric import day_text, key_day, rounded, stamp_text
from knownat.functions.scale import newest
from knownat.operators import calendar as cal
from knownat.operators import factors as fac
from knownat.operators import pit
from knownat.plans import fixtures as fx
from knownat.plans.indicators import W20, W60, W250
from knownat.plans.pit import snapshots
from knownat.plans.registry import cte, query
from knownat.session import cut_lineage
from knownat.sources.tables import load

B = "least(1, greatest(0, ({0} - ({1})) / ({2} - ({1})))) * 100"
cte("tech_in", f"""
SELECT b.*, rsi.rsi, (close - ma20) / ma20 * 100 AS ma20_distance, (ma20 - ma60) / ma60 * 100 AS trend_spread,
  CASE WHEN n20 = 20 THEN CASE WHEN s = 0 THEN 0.5 ELSE (close - (ma20 - 2 * s)) / (4 * s) END END AS band_position, macd.histogram AS macd_histogram
FROM (SELECT *, CASE WHEN n20 = 20 THEN m END AS ma20, CASE WHEN n60 = 60 THEN m60 END AS ma60,
        CASE WHEN n20 = 20 THEN CASE WHEN vs = 0 THEN 0 ELSE (volume - vm) / vs END END AS volume_z FROM (
   SELECT instrument_id, day, close, volume, count(*) OVER {W250} AS bars, avg(close) OVER {W20} AS m, stddev_pop(close) OVER {W20} AS s,
     count(*) OVER {W20} AS n20, avg(close) OVER {W60} AS m60, count(*) OVER {W60} AS n60, avg(volume) OVER {W20} AS vm, stddev_pop(volume) OVER {W20} AS vs FROM bars)) b
JOIN rsi USING (instrument_id, day) JOIN macd USING (instrument_id, day)""", "bars", "rsi", "macd")
cte("tech", f"""
SELECT *, CASE WHEN bars >= 60 THEN (greatest(0, 1 - abs(rsi - 55) / 45) * 100 + {B.format('ma20_distance', -10, 10)} + {B.format('trend_spread', -10, 10)}
   + {B.format('volume_z', -2, 3)} + greatest(0, least(100, band_position * 100)) + {B.format('(macd_histogram / close * 100)', -2, 2)}) / 6 END AS technical_score FROM tech_in""", "tech_in")


def technical(spark, sf):
    return fac.technical_factor(fac.technical_inputs(fx.bars(spark, sf)))


@query("f1_technical_factor", "tech", """
SELECT instrument_id, CAST(day AS VARCHAR) AS day, round(technical_score, 5) AS technical_score, CAST(CASE WHEN bars >= 60 THEN 6 END AS BIGINT) AS metrics,
  CASE WHEN bars < 60 THEN bars || ' daily bars; the 60-day mean needs 60' END AS reason FROM tech""")
def f1(spark, sf):
    return technical(spark, sf).select("instrument_id", day_text("day").alias("day"), rounded("technical_score", 5).alias("technical_score"),
                                       F.when(F.col("metrics").isNotNull(), F.size("metrics")).cast("long").alias("metrics"),
                                       F.col("technical_reason").alias("reason"))


@query("f2_technical_evidence", "tech_in", """
SELECT instrument_id, CAST(day AS VARCHAR) AS day, 'RSI' AS metric, CASE WHEN rsi >= 70 OR rsi <= 30 THEN 'OPPOSES' ELSE 'SUPPORTS' END AS status,
   CASE WHEN rsi >= 70 THEN 'overbought' WHEN rsi <= 30 THEN 'oversold' ELSE 'no extreme' END AS text FROM tech_in WHERE bars >= 60
UNION ALL SELECT instrument_id, CAST(day AS VARCHAR), 'MA20 distance', CASE WHEN ma20_distance > 1 THEN 'SUPPORTS' WHEN ma20_distance < -1 THEN 'OPPOSES' ELSE 'NEUTRAL' END,
   CASE WHEN ma20_distance > 1 THEN 'above its 20-day mean' WHEN ma20_distance < -1 THEN 'below its 20-day mean' ELSE 'near its 20-day mean' END FROM tech_in WHERE bars >= 60
UNION ALL SELECT instrument_id, CAST(day AS VARCHAR), 'MA20/MA60 spread', CASE WHEN trend_spread > 0 THEN 'SUPPORTS' ELSE 'OPPOSES' END,
   CASE WHEN trend_spread > 0 THEN 'rising trend' ELSE 'falling trend' END FROM tech_in WHERE bars >= 60
UNION ALL SELECT instrument_id, CAST(day AS VARCHAR), 'Volume z-score', CASE WHEN volume_z >= 1 THEN 'SUPPORTS' WHEN volume_z <= -1 THEN 'OPPOSES' ELSE 'NEUTRAL' END,
   CASE WHEN volume_z >= 1 THEN 'more volume than usual' WHEN volume_z <= -1 THEN 'less volume than usual' ELSE 'usual volume' END FROM tech_in WHERE bars >= 60
UNION ALL SELECT instrument_id, CAST(day AS VARCHAR), 'MACD histogram', CASE WHEN macd_histogram > 0 THEN 'SUPPORTS' ELSE 'OPPOSES' END,
   CASE WHEN macd_histogram > 0 THEN 'positive' ELSE 'negative' END FROM tech_in WHERE bars >= 60""")
def f2(spark, sf):
    out = fac.technical_reasons(fac.technical_inputs(fx.bars(spark, sf)))
    return out.select("instrument_id", day_text("day").alias("day"), "metric", "status", "text")


RFC = '"RevenueFromContractWithCustomerExcludingAssessedTax"'
RATIO_SQL = f"""*, coalesce({RFC}, "Revenues") AS revenue, coalesce("prior_RevenueFromContractWithCustomerExcludingAssessedTax", "prior_Revenues") AS prior_revenue,
  CASE WHEN "StockholdersEquity" > 0 THEN "NetIncomeLoss" / "StockholdersEquity" END AS roe, CASE WHEN "Assets" > 0 THEN "Liabilities" / "Assets" END AS debt_ratio,
  CASE WHEN coalesce({RFC}, "Revenues") > 0 THEN "OperatingIncomeLoss" / coalesce({RFC}, "Revenues") END AS op_margin,
  CASE WHEN coalesce("prior_RevenueFromContractWithCustomerExcludingAssessedTax", "prior_Revenues") > 0 THEN
   (coalesce({RFC}, "Revenues") - coalesce("prior_RevenueFromContractWithCustomerExcludingAssessedTax", "prior_Revenues")) / coalesce("prior_RevenueFromContractWithCustomerExcludingAssessedTax", "prior_Revenues") END AS growth"""
cte("ratio", f"SELECT {RATIO_SQL}, CASE WHEN instrument_id % 2 = 0 THEN 'US' ELSE 'KR' END AS market, 20.0 + instrument_id AS price FROM snap", "snap")


def ratio_rows(spark, sf):
    return fac.ratios(snapshots(spark, sf)).withColumns({
        "market": F.when(F.col("instrument_id") % 2 == 0, "US").otherwise("KR"), "price": F.col("instrument_id") + F.lit(20.0)})


@query("f3_ratios", "ratio", "SELECT instrument_id, round(roe, 6) AS roe, round(debt_ratio, 6) AS debt_ratio, round(op_margin, 6) AS op_margin, round(growth, 6) AS growth FROM ratio")
def f3(spark, sf):
    return ratio_rows(spark, sf).select("instrument_id", *[rounded(r).alias(r) for r in fac.RATIOS])


def rank_sql(r: str, by: str = "market") -> str:
    return (f"CASE WHEN {r} IS NOT NULL THEN ((rank() OVER (PARTITION BY {by} ORDER BY {r} NULLS LAST) - 1) + 0.5 * count(*) OVER (PARTITION BY {by}, {r})) "
            f"/ count({r}) OVER (PARTITION BY {by}) * 100 END AS {r}_rank, count({r}) OVER (PARTITION BY {by}) AS {r}_peers")


cte("ranked", f"SELECT *, {', '.join(rank_sql(r) for r in ('roe', 'debt_ratio', 'op_margin', 'growth'))} FROM ratio", "ratio")


@query("f4_peer_positions", "ranked", """
SELECT market, instrument_id, round(roe_rank, 6) AS roe_rank, CASE WHEN roe IS NULL THEN 0 ELSE roe_peers END AS roe_peers, round(debt_ratio_rank, 6) AS debt_ratio_rank,
 round(op_margin_rank, 6) AS op_margin_rank, round(growth_rank, 6) AS growth_rank FROM ranked WHERE roe IS NOT NULL OR debt_ratio IS NOT NULL OR op_margin IS NOT NULL OR growth IS NOT NULL""")
def f4(spark, sf):
    out = fac.peer_positions(ratio_rows(spark, sf), ["market"])
    return out.select("market", "instrument_id", rounded("roe_rank").alias("roe_rank"), F.col("roe_peers").cast("long").alias("roe_peers"),
                      *[rounded(f"{r}_rank").alias(f"{r}_rank") for r in fac.RATIOS[1:]])


def placed(r, low, high, invert=False):
    fixed = f"least(1, greatest(0, ({r} - ({low})) / ({high} - ({low}))))"
    fixed = f"(1 - {fixed}) * 100" if invert else f"{fixed} * 100"
    ranked = f"100 - {r}_rank" if invert else f"{r}_rank"
    return f"CASE WHEN {r} IS NOT NULL THEN CASE WHEN {r}_peers >= 5 THEN {ranked} ELSE {fixed} END END"


FUND = f"""SELECT *, CASE WHEN "EarningsPerShareBasic" > 0 THEN price / "EarningsPerShareBasic" END AS per,
  CASE WHEN price IS NOT NULL AND "EarningsPerShareBasic" IS NOT NULL THEN CASE WHEN "EarningsPerShareBasic" <= 0 THEN 0.0
    ELSE greatest(0, 1 - abs(price / "EarningsPerShareBasic" - 15) / 25) * 100 END END AS per_score,
  CASE WHEN "NetIncomeLoss" IS NOT NULL AND "StockholdersEquity" < 0 THEN 0.0 ELSE {placed('roe', 0, 0.3)} END AS roe_score,
  {placed('debt_ratio', 0.2, 0.8, True)} AS debt_score, {placed('op_margin', 0, 0.3)} AS margin_score, {placed('growth', -0.2, 0.4)} AS growth_score FROM """
FUND2 = """SELECT *, CASE WHEN cnt = 0 THEN missing WHEN cnt < 3 THEN 'only ' || cnt || ' of 3 ratios' WHEN roe_score IS NULL AND margin_score IS NULL THEN 'no profitability ratio' END AS fundamental_reason,
   CASE WHEN cnt >= 3 AND (roe_score IS NOT NULL OR margin_score IS NOT NULL) THEN (coalesce(per_score, 0) + coalesce(roe_score, 0) + coalesce(debt_score, 0) + coalesce(margin_score, 0) + coalesce(growth_score, 0)) / cnt END AS fundamental_score
 FROM (SELECT *, (per_score IS NOT NULL)::INT + (roe_score IS NOT NULL)::INT + (debt_score IS NOT NULL)::INT + (margin_score IS NOT NULL)::INT + (growth_score IS NOT NULL)::INT AS cnt,
   CASE WHEN len(absent) > 0 THEN 'no value: ' || absent[1] || CASE WHEN len(absent) > 1 THEN ' and ' || (len(absent) - 1) || ' more' ELSE '' END
        WHEN price IS NULL THEN 'no price for a value ratio' ELSE 'no financial inputs' END AS missing
 FROM (SELECT *, list_filter([""" + ", ".join(f"CASE WHEN \"{c}\" IS NULL THEN '{c}' END" for c in fx.CONCEPTS) + """], lambda x: x IS NOT NULL) AS absent FROM {0}))"""
cte("fund0", FUND + "ranked", "ranked")
cte("fund", FUND2.format("fund0"), "fund0")


def fundamental(spark, sf):
    rows = ratio_rows(spark, sf)
    return fac.fundamental_factor(rows.join(fac.peer_positions(rows, ["market"]), ["market", "instrument_id"], "left"))


@query("f5_position_scale", "fund", """
SELECT instrument_id, round(roe_score, 6) AS roe_score, round(debt_score, 6) AS debt_score, round(margin_score, 6) AS margin_score, round(growth_score, 6) AS growth_score,
  CASE WHEN roe IS NULL THEN NULL WHEN roe_peers >= 5 THEN 'ranked' ELSE 'fixed' END AS roe_scale, CASE WHEN debt_ratio IS NULL THEN NULL WHEN debt_ratio_peers >= 5 THEN 'ranked' ELSE 'fixed' END AS debt_scale, CASE WHEN op_margin IS NULL THEN NULL WHEN op_margin_peers >= 5 THEN 'ranked' ELSE 'fixed' END AS margin_scale, CASE WHEN growth IS NULL THEN NULL WHEN growth_peers >= 5 THEN 'ranked' ELSE 'fixed' END AS growth_scale FROM fund""")
def f5(spark, sf):
    return fundamental(spark, sf).select("instrument_id", *[rounded(c).alias(c) for c in ("roe_score", "debt_score", "margin_score", "growth_score")], "roe_scale", "debt_scale", "margin_scale", "growth_scale")


@query("f6_fundamental_factor", "fund", """
SELECT instrument_id, round(per, 6) AS per, round(per_score, 6) AS per_score, CAST(cnt AS BIGINT) AS metrics, round(fundamental_score, 6) AS fundamental_score FROM fund""")
def f6(spark, sf):
    return fundamental(spark, sf).select("instrument_id", rounded("per").alias("per"), rounded("per_score").alias("per_score"),
                                         F.col("fundamental_count").cast("long").alias("metrics"), rounded("fundamental_score").alias("fundamental_score"))


@query("f7_unavailable_reason", "fund", "SELECT instrument_id, fundamental_reason AS reason FROM fund")
def f7(spark, sf):
    return fundamental(spark, sf).select("instrument_id", F.col("fundamental_reason").alias("reason"))


@query("f2_fundamental_evidence", "fund", """
SELECT * FROM (SELECT instrument_id, 'P/E' AS metric, CASE WHEN per_score IS NULL THEN NULL WHEN "EarningsPerShareBasic" <= 0 OR per > 27.5 THEN 'OPPOSES' WHEN per < 2.5 THEN 'NEUTRAL' ELSE 'SUPPORTS' END AS status FROM fund
UNION ALL SELECT instrument_id, 'ROE', CASE WHEN roe_score IS NULL THEN NULL WHEN "StockholdersEquity" < 0 THEN 'OPPOSES' WHEN roe >= 0.15 THEN 'SUPPORTS' WHEN roe <= 0 THEN 'OPPOSES' ELSE 'NEUTRAL' END FROM fund
UNION ALL SELECT instrument_id, 'Debt ratio', CASE WHEN debt_ratio IS NULL THEN NULL WHEN debt_ratio >= 0.7 THEN 'OPPOSES' ELSE 'SUPPORTS' END FROM fund
UNION ALL SELECT instrument_id, 'Operating margin', CASE WHEN op_margin IS NULL THEN NULL WHEN op_margin <= 0 THEN 'OPPOSES' WHEN op_margin >= 0.2 THEN 'SUPPORTS' ELSE 'NEUTRAL' END FROM fund
UNION ALL SELECT instrument_id, 'Revenue growth', CASE WHEN growth IS NULL THEN NULL WHEN growth >= 0.1 THEN 'SUPPORTS' WHEN growth < 0 THEN 'OPPOSES' ELSE 'NEUTRAL' END FROM fund) WHERE status IS NOT NULL""")
def f2b(spark, sf):
    return fac.fundamental_reasons(fundamental(spark, sf))


@query("f8_freshness", "sess", """
SELECT o_orderkey, CASE WHEN a IS NULL THEN 'MISSING' WHEN (CASE WHEN d <= CAST(a AS DATE) THEN 0 ELSE (SELECT count(*) FROM sess WHERE day > CAST(a AS DATE) AND day <= d) END) <= 1 THEN 'FRESH' ELSE 'STALE' END AS by_sessions,
  CASE WHEN a IS NULL THEN 'MISSING' WHEN now <= a + INTERVAL 48 HOUR THEN 'FRESH' ELSE 'STALE' END AS by_clock,
  CASE WHEN a IS NULL THEN 'MISSING' WHEN c IS NOT NULL AND now <= c + INTERVAL 7 DAY THEN 'FRESH' ELSE 'STALE' END AS by_check
FROM (SELECT o_orderkey, o_orderdate + INTERVAL 9 HOUR AS now, CAST(o_orderdate AS DATE) AS d, CASE WHEN o_custkey % 7 <> 0 THEN o_orderdate - to_days(CAST(o_custkey % 5 AS INTEGER)) END AS a,
   CASE WHEN o_custkey % 3 <> 0 THEN o_orderdate - to_days(CAST(o_custkey % 12 AS INTEGER)) END AS c FROM orders)
WHERE d <= (SELECT max(day) FROM sess) AND coalesce(CAST(a AS DATE), d) >= (SELECT min(day) FROM sess) AND d >= (SELECT min(day) FROM sess)""")
def f8(spark, sf):
    spine = cal.day_spine(fx.sessions(spark, sf))
    key, day = F.col("o_custkey"), F.col("o_orderdate")
    rows = load(spark, sf, "orders").select(
        "o_orderkey", F.timestamp_add("HOUR", F.lit(9), day).alias("now"), F.to_date(day).alias("d"),
        F.when(key % 7 != 0, F.timestamp_add("DAY", -(key % 5).cast("int"), day)).alias("source_asof"),
        F.when(key % 3 != 0, F.timestamp_add("DAY", -(key % 12).cast("int"), day)).alias("checked_at"))
    rows = rows.withColumn("a", F.coalesce(F.to_date("source_asof"), F.col("d")))
    known = spine.select("day")
    rows = rows.join(known, F.col("d") == F.col("day"), "left_semi").join(known, F.col("a") == F.col("day"), "left_semi")
    rows = cal.sessions_behind(rows, spine, "a", "d")
    return rows.select("o_orderkey", fac.freshness("sessions").alias("by_sessions"), fac.freshness("wall_clock", limit=48).alias("by_clock"),
                       fac.freshness("source_check", limit=7).alias("by_check"))


@query("f9_weights", "tech", """
SELECT instrument_id, CAST(day AS VARCHAR) AS day, tw, fw, round(CASE WHEN tw + fw > 0 THEN tw / (tw + fw) ELSE 0 END, 6) AS tw_scaled, round(CASE WHEN tw + fw > 0 THEN fw / (tw + fw) ELSE 0 END, 6) AS fw_scaled
FROM (SELECT *, CASE WHEN bars >= 60 THEN 0.6 ELSE 0.0 END AS tw, CASE WHEN instrument_id % 2 = 0 AND volume > 100 THEN 0.4 ELSE 0.0 END AS fw FROM tech)""")
def f9(spark, sf):
    rows = technical(spark, sf)
    tw = fac.effective_weight(0.6, F.col("technical_available"), F.lit(True))
    fw = fac.effective_weight(0.4, F.col("instrument_id") % 2 == 0, F.col("volume") > 100)
    rows = rows.withColumns({"tw": tw, "fw": fw})
    scaled = fac.renormalized({"t": F.col("tw"), "f": F.col("fw")})
    return rows.select("instrument_id", day_text("day").alias("day"), "tw", "fw", rounded(scaled["t"]).alias("tw_scaled"), rounded(scaled["f"]).alias("fw_scaled"))


# ---------------------------------------------------------------- snapshots at every change instant, peers per session
cte("annual", "SELECT * FROM fact WHERE period_start IS NULL OR period_end - period_start BETWEEN 336 AND 382", "fact")
cte("inst", "SELECT DISTINCT instrument_id, available_at FROM annual", "annual")
cte("inst_anchor", """SELECT i.instrument_id, i.available_at, coalesce(
    max(CASE WHEN concept = 'NetIncomeLoss' THEN period_end END), max(CASE WHEN concept = 'RevenueFromContractWithCustomerExcludingAssessedTax' THEN period_end END),
    max(CASE WHEN concept = 'Revenues' THEN period_end END), max(CASE WHEN concept = 'EarningsPerShareBasic' THEN period_end END)) AS anchor_end
  FROM inst i JOIN annual a ON a.instrument_id = i.instrument_id AND a.available_at <= i.available_at WHERE a.period_start IS NOT NULL GROUP BY 1, 2""", "inst")
_AT = ", ".join(f"arg_max(CASE WHEN a.period_end = i.anchor_end AND a.concept = '{c}' THEN a.value END, CASE WHEN a.period_end = i.anchor_end AND a.concept = '{c}' THEN row(a.filed_at, a.id) END) AS \"{c}\"" for c in fx.CONCEPTS)
_PR = ", ".join(f"arg_max(CASE WHEN a.concept = '{c}' AND a.period_start IS NOT NULL AND i.anchor_end - a.period_end BETWEEN 1 AND 430 THEN a.value END, "
                f"CASE WHEN a.concept = '{c}' AND a.period_start IS NOT NULL AND i.anchor_end - a.period_end BETWEEN 1 AND 430 THEN row(a.filed_at, a.id) END) AS \"prior_{c}\"" for c in fx.CONCEPTS[:2])
cte("snaps", f"""SELECT i.instrument_id, i.available_at, i.anchor_end, {_AT}, {_PR}
  FROM inst_anchor i JOIN annual a ON a.instrument_id = i.instrument_id AND a.available_at <= i.available_at WHERE i.anchor_end IS NOT NULL GROUP BY 1, 2, 3""", "inst_anchor")


@query("k8_snapshots_over_time", "snaps", "SELECT * REPLACE (CAST(anchor_end AS VARCHAR) AS anchor_end, strftime(available_at, '%Y-%m-%d') AS available_at, "
       + ", ".join(f'round("{c}", 6) AS "{c}"' for c in [*fx.CONCEPTS, *[f"prior_{c}" for c in fx.CONCEPTS[:2]]]) + ") FROM snaps")
def k8(spark, sf):
    out = fac.snapshots_over_time(fx.facts(spark, sf))
    return out.select("instrument_id", day_text("available_at").alias("available_at"), day_text("anchor_end").alias("anchor_end"),
                      *[rounded(c).alias(c) for c in out.columns if c not in ("instrument_id", "available_at", "anchor_end")])


def signals(spark, sf):
    """Every (instrument, session) with both factors as known at that session's close."""
    sess = fx.sessions(spark, sf).select("day", "open_at", "close_at", "next_day")
    snaps = fac.ratios(fac.snapshots_over_time(fx.facts(spark, sf)))
    # one row per listed instrument and session: the population each session is ranked in
    points = cal.session_grid(snaps.select("instrument_id").distinct(), fx.sessions(spark, sf)).select("instrument_id", "day", "close_at")
    then = fac.as_of_snapshots(points, snaps, "close_at").where("anchor_end IS NOT NULL").withColumn("market", F.when(F.col("instrument_id") % 2 == 0, "US").otherwise("KR"))
    # read by the ranks and by the signals: written once
    then = cut_lineage(then)
    ranks = fac.peer_positions(then, ["market", "day"])
    priced = technical(spark, sf).withColumn("price", F.col("close"))
    rows = priced.join(then.drop("close_at"), ["instrument_id", "day"], "left").join(ranks.drop("market"), ["instrument_id", "day"], "left")
    rows = fac.combine(fac.fundamental_factor(rows)).join(sess, "day")
    following = sess.select(F.col("day").alias("next_day"), F.col("open_at").alias("earliest_execution_at"))
    rows = rows.join(following, "next_day", "left")
    rows = rows.withColumns({"data_asof": F.col("close_at"), "decision_at": F.col("close_at")})
    return fac.checked_clocks(rows)


cte("pop", f"""SELECT *, {', '.join(rank_sql(r, 'market, day') for r in ('roe', 'debt_ratio', 'op_margin', 'growth'))} FROM (
  SELECT {RATIO_SQL}, CASE WHEN instrument_id % 2 = 0 THEN 'US' ELSE 'KR' END AS market FROM (
    SELECT p.instrument_id, p.day, n.* EXCLUDE (instrument_id) FROM (SELECT f.instrument_id, s.day, s.close_at FROM (SELECT DISTINCT instrument_id FROM fact) f CROSS JOIN sess s) p
    ASOF JOIN snaps n ON n.instrument_id = p.instrument_id AND p.close_at >= n.available_at))""", "snaps", "sess")
cte("sig0", FUND + "(SELECT t.*, t.close AS price, p.* EXCLUDE (instrument_id, day) FROM tech t LEFT JOIN pop p USING (instrument_id, day))", "tech", "pop")
cte("sig", f"""SELECT *, CASE WHEN tw = 0 THEN 0.0 ELSE coalesce(technical_score, 0) * tw + coalesce(fundamental_score, 0) * fw END AS total_score, tw + fw AS weight_total,
   CASE WHEN tw = 0 THEN 'ABSTAINED' WHEN coalesce(technical_score, 0) * tw + coalesce(fundamental_score, 0) * fw >= (tw + fw) * 70 THEN 'BUY_INTEREST'
        WHEN coalesce(technical_score, 0) * tw + coalesce(fundamental_score, 0) * fw <= (tw + fw) * 35 THEN 'CAUTION' ELSE 'WATCH' END AS action
  FROM (SELECT *, CASE WHEN bars >= 60 THEN 0.6 ELSE 0.0 END AS tw, CASE WHEN fundamental_reason IS NULL THEN 0.4 ELSE 0.0 END AS fw FROM ({FUND2.format('sig0')}))""", "sig0")
SIG = """SELECT g.instrument_id, CAST(g.day AS VARCHAR) AS day, round(technical_score, 4) AS technical_score, round(fundamental_score, 4) AS fundamental_score,
  round(total_score, 4) AS total_score, round(weight_total, 4) AS weight_total, action, strftime(n.open_at, '%Y-%m-%d %H:%M:%S') AS earliest_execution_at
FROM sig g JOIN sess s USING (day) LEFT JOIN sess n ON n.day = s.next_day"""


@query("f10_signals", "sig", SIG)
def f10(spark, sf):
    return signals(spark, sf).select(
        "instrument_id", day_text("day").alias("day"), *[rounded(c, 4).alias(c) for c in ("technical_score", "fundamental_score", "total_score", "weight_total")],
        "action", stamp_text("earliest_execution_at").alias("earliest_execution_at"))


@query("f11_signal_decomposition", "sig", """
SELECT instrument_id, CAST(day AS VARCHAR) AS day, action, 'TECHNICAL' AS engine, CASE WHEN tw > 0 THEN 'AVAILABLE' ELSE 'UNAVAILABLE' END AS availability, round(coalesce(technical_score, 0) * tw, 4) AS contribution, CAST(CASE WHEN tw > 0 THEN 6 END AS BIGINT) AS metrics FROM sig
UNION ALL SELECT instrument_id, CAST(day AS VARCHAR), action, 'FUNDAMENTAL', CASE WHEN fw > 0 THEN 'AVAILABLE' ELSE 'UNAVAILABLE' END, round(coalesce(fundamental_score, 0) * fw, 4), CAST(cnt AS BIGINT) FROM sig""")
def f11(spark, sf):
    nested = fac.signal_rows(signals(spark, sf))
    return nested.select("instrument_id", "day", "action", F.explode("factors").alias("f")).select(
        "instrument_id", day_text("day").alias("day"), "action", "f.engine", "f.availability", rounded("f.contribution", 4).alias("contribution"),
        F.when(F.col("f.metrics").isNotNull(), F.size("f.metrics")).cast("long").alias("metrics"))


@query("f12_judged_score", "sig", "SELECT instrument_id, CAST(day AS VARCHAR) AS day, round(CASE WHEN action <> 'ABSTAINED' THEN total_score / weight_total END, 4) AS judged_score FROM sig")
def f12(spark, sf):
    return signals(spark, sf).select("instrument_id", day_text("day").alias("day"), rounded("judged_score", 4).alias("judged_score"))


@query("f13_latest_signals", "sig", """
SELECT instrument_id, k, CAST(day AS VARCHAR) AS day, action FROM (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY day DESC) AS k FROM sig) WHERE k <= 5""")
def f13(spark, sf):
    w = W.partitionBy("instrument_id").orderBy(F.col("day").desc())
    rows = signals(spark, sf).select("instrument_id", "day", "action").withColumn("k", F.row_number().over(w)).where("k <= 5")
    return rows.select("instrument_id", F.col("k").cast("long").alias("k"), day_text("day").alias("day"), "action")


@query("p38_newest_signal_map", "sig", """
SELECT instrument_id, CAST(day AS VARCHAR) AS day, action, round(coalesce(technical_score, 0), 4) AS technical, round(coalesce(fundamental_score, 0), 4) AS fundamental
FROM (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY day DESC) AS k FROM sig WHERE day <= DATE '1998-06-30') WHERE k = 1""")
def p38(spark, sf):
    rows = signals(spark, sf).where(F.col("day") <= F.lit("1998-06-30").cast("date"))
    nested = newest(fac.signal_rows(rows), ["instrument_id"], ["day"])
    scores = F.map_from_entries(F.transform("factors", lambda f: F.struct(f["engine"], f["score"])))
    return nested.withColumn("s", scores).select("instrument_id", day_text("day").alias("day"), "action", rounded(F.col("s")["TECHNICAL"], 4).alias("technical"),
                                                 rounded(F.col("s")["FUNDAMENTAL"], 4).alias("fundamental"))


cte("brief", """SELECT session_no, instrument_id, row_number() OVER (PARTITION BY session_no ORDER BY instrument_id) AS rank, p_retailprice / 20 AS technical_score,
   CASE WHEN instrument_id % 4 <> 0 THEN judged_score END AS fundamental_score, judged_score AS total_score, last_action, overlay_points FROM cand""", "cand")


def brief(spark, sf):
    return fx.candidates(spark, sf).select(
        "session_no", "instrument_id", F.col("instrument_id").alias("rank"), (F.col("p_retailprice") / 20).alias("technical_score"),
        F.when(F.col("instrument_id") % 4 != 0, F.col("judged_score")).alias("fundamental_score"), F.col("judged_score").alias("total_score"), "last_action", "overlay_points")


@query("f14_category_top3", "brief", """
SELECT session_no, category, place, instrument_id FROM (SELECT *, row_number() OVER (PARTITION BY session_no, category ORDER BY score DESC, instrument_id) AS place FROM (
  SELECT session_no, instrument_id, 'technical' AS category, technical_score AS score FROM brief WHERE total_score IS NOT NULL
  UNION ALL SELECT session_no, instrument_id, 'fundamental', fundamental_score FROM brief WHERE total_score IS NOT NULL AND fundamental_score IS NOT NULL
  UNION ALL SELECT session_no, instrument_id, 'total', total_score FROM brief WHERE total_score IS NOT NULL)) WHERE place <= 3""")
def f14(spark, sf):
    rows = brief(spark, sf).where("total_score IS NOT NULL")
    out = fac.top_per_category(rows, ["session_no"], {"technical": "technical_score", "fundamental": "fundamental_score", "total": "total_score"})
    return out.select("session_no", "category", F.col("place").cast("long").alias("place"), "instrument_id")


@query("f15_good_news_order", "brief", """
SELECT session_no, instrument_id, place FROM (SELECT *, row_number() OVER (PARTITION BY session_no ORDER BY fundamental_score DESC NULLS LAST, instrument_id) AS place FROM brief WHERE overlay_points >= 1) WHERE place <= 20""")
def f15(spark, sf):
    w = W.partitionBy("session_no").orderBy(F.col("fundamental_score").desc_nulls_last(), "rank")
    good = brief(spark, sf).where("overlay_points >= 1").withColumn("place", F.row_number().over(w)).where("place <= 20")
    return good.select("session_no", "instrument_id", F.col("place").cast("long").alias("place"))
