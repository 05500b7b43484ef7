"""Queries E1-E24."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from knownat.functions.numeric import day_text, key_day, rounded
from knownat.operators import calendar as cal
from knownat.operators import news as nw
from knownat.operators import stats
from knownat.operators import studies as st
from knownat.plans import fixtures as fx
from knownat.plans.news import PHRASES, TITLES, _list, _pick
from knownat.plans.registry import ORACLES, cte, query
from knownat.plans.rules import judge_out, judge_sql, members
from knownat.session import cut_lineage
from knownat.sources.tables import load

FIRST, LAST = "1993-01-01", "2000-06-30"
cte("otitle", "SELECT o_orderkey AS receipt, o_custkey % 10 AS corp_code, CAST(o_orderdate AS DATE) AS filed_on, [" + ", ".join(f"'{t}'" for t in TITLES) + "][o_orderkey % 16 + 1] AS report_nm FROM orders")
cte("otitled", f"""SELECT *, {_list(1, True)}[k] AS event_type, CAST({_list(2)}[k] AS DOUBLE) AS sentiment, {_list(3)}[k] * CASE WHEN sub THEN 0.5 ELSE 1.0 END AS intensity FROM (SELECT *, {_pick} AS k,
   contains(flat, '자회사의주요경영사항') OR contains(flat, '종속회사의주요경영사항') AS sub FROM (SELECT *, contains(regexp_extract(report_nm, '^\\s*(\\[[^\\]]*\\])', 1), '정정') OR contains(flat, '결과보고서') AS no_event FROM (
    SELECT *, regexp_replace(regexp_replace(report_nm, '^\\s*\\[[^\\]]*\\]', ''), '[\\s·ㆍ‧・()]+', '', 'g') AS flat FROM otitle)))""", "otitle")
cte("fcand", f"""SELECT *, CASE WHEN corp_code >= 7 THEN 'not listed' WHEN event_type IS NULL THEN 'no event' WHEN entry_day IS NULL OR entry_day < DATE '{FIRST}' OR entry_day > DATE '{LAST}' THEN 'outside the window' END AS dropped
  FROM (SELECT t.*, CASE WHEN t.filed_on >= (SELECT min(day) FROM sess) THEN n.day END AS entry_day FROM otitled t ASOF LEFT JOIN sess n ON t.filed_on < n.day)""", "otitled", "sess")


def filing_candidates(spark, sf):
    rows = load(spark, sf, "orders").select(
        F.col("o_orderkey").alias("receipt"), (F.col("o_custkey") % 10).alias("corp_code"), F.to_date("o_orderdate").alias("filed_on"),
        F.element_at(F.array(*[F.lit(t) for t in TITLES]), (F.col("o_orderkey") % 16 + 1).cast("int")).alias("report_nm"))
    master = fx.bars(spark, sf).select("instrument_id").distinct().where("instrument_id < 7").select("instrument_id", F.col("instrument_id").alias("corp_code"))
    return st.filing_candidates(nw.classify_titles(rows), master, cal.day_spine(fx.sessions(spark, sf)), first=FIRST, last=LAST)


@query("e1_filing_candidates", "fcand", "SELECT coalesce(dropped, 'kept') AS why, count(*) AS n, count(DISTINCT entry_day) AS days FROM fcand GROUP BY 1")
def e1(spark, sf):
    return filing_candidates(spark, sf).groupBy(F.coalesce("dropped", F.lit("kept")).alias("why")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("entry_day").alias("days"))


cte("moves", "SELECT *, open / prev_close - 1 AS gap, close / open - 1 AS open_close FROM (SELECT *, lag(close) OVER w AS prev_close, lag(day) OVER w AS prev_bar FROM bars WINDOW w AS (PARTITION BY instrument_id ORDER BY day))", "bars")
cte("esample", """SELECT b.*, m.gap, m.open_close, i.gap AS index_gap, i.open_close AS index_open_close, m.open_close - i.open_close AS excess, m.gap - i.gap AS excess_gap,
  CASE WHEN m.open_close IS NULL THEN 'no bar' WHEN m.prev_bar IS NULL OR m.prev_bar <> s.prev_day THEN 'no previous bar' WHEN i.gap IS NULL THEN 'no index' WHEN abs(m.gap) > 0.301 THEN 'beyond the limit' END AS dropped
 FROM (SELECT instrument_id, day, event_type, sentiment, intensity FROM (SELECT corp_code AS instrument_id, entry_day AS day, event_type, sentiment, intensity, row_number() OVER (PARTITION BY corp_code, entry_day ORDER BY intensity DESC, abs(coalesce(sentiment, 0)) DESC, event_type DESC, receipt DESC) AS k
   FROM fcand WHERE dropped IS NULL) WHERE k = 1) b LEFT JOIN moves m USING (instrument_id, day) LEFT JOIN sess s USING (day) LEFT JOIN (SELECT * FROM moves WHERE instrument_id = 7) i ON i.day = b.day""", "fcand", "moves", "sess")


def event_sample(spark, sf):
    moves = st.day_moves(fx.bars(spark, sf))
    return st.event_sample(filing_candidates(spark, sf), moves, moves.where("instrument_id = 7"), fx.sessions(spark, sf))


@query("e2_event_sample", "esample", "SELECT instrument_id, CAST(day AS VARCHAR) AS day, event_type, round(intensity, 6) AS intensity, round(excess, 8) AS excess, round(excess_gap, 8) AS excess_gap, dropped FROM esample")
def e2(spark, sf):
    return event_sample(spark, sf).select(*key_day(), "event_type", rounded("intensity").alias("intensity"), rounded("excess", 8).alias("excess"), rounded("excess_gap", 8).alias("excess_gap"), "dropped")


SG = "CASE WHEN sentiment > 0 THEN 1 WHEN sentiment < 0 THEN -1 ELSE 0 END"
cte("dq", f"""SELECT day, q.question, q.value FROM (SELECT day, unnest([{{'question': 'D1', 'value': avg(excess)}}, {{'question': 'D2', 'value': avg({SG} * excess) FILTER ({SG} <> 0)}}, {{'question': 'D3', 'value': avg({SG} * excess_gap) FILTER ({SG} <> 0)}},
  {{'question': 'D4', 'value': avg(abs(excess)) FILTER (intensity >= 0.5) - avg(abs(excess)) FILTER (intensity < 0.5)}}]) AS q FROM esample WHERE dropped IS NULL GROUP BY day) WHERE q.value IS NOT NULL""", "esample")


@query("e3_filing_verdicts", "dq, esample", judge_sql("dq", "(SELECT day FROM esample WHERE dropped IS NULL)", 15, 20, 2.0, short=True))
def e3(spark, sf):
    events = event_sample(spark, sf).where("dropped IS NULL")
    return judge_out(stats.judge(st.filing_questions(events), stats.split_days(events, st.FILING_HOLDOUT, keep_all_when_short=True)))


@query("e4_by_type", "esample", """
SELECT event_type, CAST(any_value(n) AS BIGINT) AS events, round(any_value(up), 6) AS up_share, count(*) AS days, round(avg(v), 6) AS mean, round(CASE WHEN count(*) >= 2 AND stddev_samp(v) > 0 THEN avg(v) / (stddev_samp(v) / sqrt(count(*))) END, 5) AS t
FROM (SELECT event_type, day, avg(excess) AS v FROM esample WHERE dropped IS NULL GROUP BY 1, 2) JOIN (SELECT event_type, count(*) AS n, avg(CASE WHEN excess > 0 THEN 1.0 ELSE 0.0 END) AS up FROM esample WHERE dropped IS NULL GROUP BY 1) USING (event_type) GROUP BY 1""")
def e4(spark, sf):
    out = st.by_type(event_sample(spark, sf).where("dropped IS NULL"))
    return out.select("event_type", "events", rounded("up_share").alias("up_share"), "days", rounded("mean").alias("mean"), rounded("t", 5).alias("t"))


cte("fh", """SELECT instrument_id, day, c / e - 1 AS ret, h / e - 1 AS mfe, l / e - 1 AS mae FROM (SELECT instrument_id, day, max(open) FILTER (minute = 0) AS e, arg_max(close, minute) AS c, max(high) FILTER (minute >= 1) AS h, min(low) FILTER (minute >= 1) AS l
  FROM mbars WHERE minute < 60 GROUP BY 1, 2) WHERE e > 0 AND h IS NOT NULL""", "mbars")


@query("e5_first_hour_measures", "fh", "SELECT instrument_id, CAST(day AS VARCHAR) AS day, round(ret, 8) AS ret, round(mfe, 8) AS mfe, round(mae, 8) AS mae FROM fh")
def e5(spark, sf):
    return st.first_hour_measures(fx.minute_bars(spark, sf)).select(*key_day(), *[rounded(c, 8).alias(c) for c in ("ret", "mfe", "mae")])


cte("fq", """SELECT day, q.question, q.value FROM (SELECT day, unnest([{'question': 'F1', 'value': avg(ret)}, {'question': 'F2', 'value': avg(ret) FILTER (s > 0) - avg(ret) FILTER (s < 0)}, {'question': 'F3', 'value': avg(mfe - mae) FILTER (it >= 0.5) - avg(mfe - mae) FILTER (it < 0.5)},
  {'question': 'F4', 'value': avg(mfe + mae)}]) AS q FROM (SELECT f.*, m.h % 3 - 1 AS s, m.h / 100.0 AS it FROM fh f JOIN member m USING (instrument_id, day)) GROUP BY day) WHERE q.value IS NOT NULL""", "fh", "member")


@query("e6_first_hour_verdicts", "fq, mbars", judge_sql("fq", "mbars", 15, 10, 2.0, short=True))
def e6(spark, sf):
    tags = members(spark, sf).select("instrument_id", "day", (F.col("h") % 3 - 1).cast("double").alias("sentiment"), (F.col("h") / 100.0).alias("intensity"))
    bars = fx.minute_bars(spark, sf)
    events = st.first_hour_measures(bars).join(tags, ["instrument_id", "day"])
    return judge_out(stats.judge(st.first_hour_questions(events), stats.split_days(bars, st.FILING_HOLDOUT, keep_all_when_short=True), min_days=10))


@query("e7_quality_gate", "bars", """
SELECT round(avg(CASE WHEN o IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS coverage, round(avg(CASE WHEN o IS NOT NULL THEN CASE WHEN abs(o / open - 1) <= 0.001 THEN 1.0 ELSE 0.0 END END), 6) AS open_ok,
  round(avg(CASE WHEN o IS NOT NULL THEN CASE WHEN abs(c / close - 1) <= 0.003 THEN 1.0 ELSE 0.0 END END), 6) AS close_ok, count(*) AS name_days FROM (
 SELECT *, CASE WHEN dayofyear(day) % 29 <> 0 THEN open * (1 + dayofyear(day) % 5 * 0.00035) END AS o, CASE WHEN dayofyear(day) % 29 <> 0 THEN close * (1 + dayofyear(day) % 7 * 0.00055) END AS c FROM bars)""")
def e7(spark, sf):
    bars = fx.bars(spark, sf)
    doy = F.dayofyear("day")
    other = bars.where(doy % 29 != 0).select("instrument_id", "day", (F.col("open") * (1 + doy % 5 * F.lit(0.00035))).alias("open"), (F.col("close") * (1 + doy % 7 * F.lit(0.00055))).alias("close"))
    return st.quality_gate(bars, other).select(*[rounded(c).alias(c) for c in ("coverage", "open_ok", "close_ok")], "name_days")


@query("e8_liquid_universe", "bars", """
SELECT instrument_id, count(*) AS days, round(avg(close * volume), 4) AS traded_value FROM bars WHERE day < DATE '1996-01-01' GROUP BY 1 HAVING count(*) >= 200 AND avg(close * volume) >= 1000""")
def e8(spark, sf):
    out = st.liquid(fx.bars(spark, sf).where(F.col("day") < F.lit("1996-01-01").cast("date")), min_value=1000)
    return out.select("instrument_id", "days", rounded("traded_value", 4).alias("traded_value"))


# ---------------------------------------------------------------- overnight: instruments 3-6 act as foreign series, 6 as their market
TRAIN_END = "1996-01-01"
cte("us", "SELECT 'I' || instrument_id AS code, CAST(day AS TIMESTAMP) - INTERVAL 3 HOUR AS t, close AS price FROM bars WHERE instrument_id BETWEEN 3 AND 6", "bars")
cte("aligned", """SELECT code, day, CASE WHEN t1 <> t0 THEN p1 / p0 - 1 END AS r FROM (
  SELECT o.code, o.day, o.t AS t1, o.price AS p1, p.t AS t0, p.price AS p0 FROM (SELECT a.code, a.day, u.t, u.price FROM (SELECT c.code, s.day, s.open_at FROM prevs s, (SELECT DISTINCT code FROM us) c) a ASOF LEFT JOIN us u ON u.code = a.code AND a.open_at > u.t) o
  JOIN (SELECT a.code, a.day, u.t, u.price FROM (SELECT c.code, s.day, s.prev_close FROM prevs s, (SELECT DISTINCT code FROM us) c) a ASOF LEFT JOIN us u ON u.code = a.code AND a.prev_close > u.t) p ON o.code = p.code AND o.day = p.day)""", "us", "prevs")
cte("prevs", "SELECT * FROM (SELECT day, open_at, lag(close_at) OVER (ORDER BY day) AS prev_close FROM sess) WHERE prev_close IS NOT NULL", "sess")


def aligned(spark, sf):
    series = fx.bars(spark, sf).where("instrument_id BETWEEN 3 AND 6").select(
        F.concat(F.lit("I"), F.col("instrument_id").cast("string")).alias("code"), (F.col("day").cast("timestamp") - F.expr("INTERVAL 3 HOUR")).alias("t"), F.col("close").alias("price"))
    return st.align(fx.sessions(spark, sf), series)


@query("e9_align", "aligned", "SELECT code, CAST(day AS VARCHAR) AS day, round(r, 8) AS r FROM aligned")
def e9(spark, sf):
    return aligned(spark, sf).select("code", day_text("day").alias("day"), rounded("r", 8).alias("r"))


cte("resid", f"""SELECT a.code, a.day, beta, a.r - beta * m.r AS e FROM aligned a LEFT JOIN (SELECT day, r FROM aligned WHERE code = 'I6') m USING (day)
  JOIN (SELECT a.code, regr_slope(a.r, m.r) AS beta FROM aligned a JOIN (SELECT day, r FROM aligned WHERE code = 'I6') m USING (day) WHERE a.day < DATE '{TRAIN_END}' AND a.r IS NOT NULL AND m.r IS NOT NULL GROUP BY 1) b ON b.code = a.code WHERE a.code <> 'I6'""", "aligned")


def resid(spark, sf):
    return st.residuals(aligned(spark, sf), "I6", F.col("day") < F.lit(TRAIN_END).cast("date"))


@query("e10_residuals", "resid", "SELECT code, CAST(day AS VARCHAR) AS day, round(beta, 6) AS beta, round(e, 6) AS e FROM resid")
def e10(spark, sf):
    return resid(spark, sf).select("code", day_text("day").alias("day"), rounded("beta").alias("beta"), rounded("e").alias("e"))


cte("sigma", """SELECT *, coalesce(e >= 2 * sigma AND sigma > 0, false) AS big, coalesce(abs(e) < 2 * sigma AND sigma > 0, false) AS calm FROM (SELECT r.code, r.day, r.e, last_value(s.sd IGNORE NULLS) OVER (PARTITION BY r.code ORDER BY r.day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sigma
  FROM resid r LEFT JOIN (SELECT code, day, CASE WHEN count(*) OVER w = 60 THEN stddev_samp(e) OVER w END AS sd FROM resid WHERE e IS NOT NULL WINDOW w AS (PARTITION BY code ORDER BY day ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)) s USING (code, day))""", "resid")


def sigma(spark, sf):
    return st.trailing_sigma(resid(spark, sf))


@query("e11_trailing_sigma", "sigma", "SELECT code, CAST(day AS VARCHAR) AS day, round(sigma, 6) AS sigma, big, calm FROM sigma")
def e11(spark, sf):
    return sigma(spark, sf).select("code", day_text("day").alias("day"), rounded("sigma").alias("sigma"), "big", "calm")


cte("rel_gap", "SELECT m.instrument_id, m.day, m.gap, m.open_close AS first_hour, ew_gap, ew_first_hour, m.gap - ew_gap AS gap_rel FROM moves m JOIN (SELECT day, avg(gap) AS ew_gap, avg(open_close) AS ew_first_hour FROM moves WHERE abs(gap) <= 0.301 AND gap < 0.295 GROUP BY 1) e USING (day) WHERE abs(m.gap) <= 0.301 AND m.gap < 0.295", "moves")


def rel_gap(spark, sf):
    return st.relative_gaps(st.day_moves(fx.bars(spark, sf)).withColumn("first_hour", F.col("open_close")))


@query("e13_relative_gap", "rel_gap", "SELECT instrument_id, CAST(day AS VARCHAR) AS day, round(gap_rel, 8) AS gap_rel, round(ew_first_hour, 8) AS ew_first_hour FROM rel_gap")
def e13(spark, sf):
    return rel_gap(spark, sf).select(*key_day(), rounded("gap_rel", 8).alias("gap_rel"), rounded("ew_first_hour", 8).alias("ew_first_hour"))


def select_sql(where):
    return f"""SELECT *, row_number() OVER (PARTITION BY code ORDER BY rho DESC, instrument_id) AS place FROM (SELECT *, rho * sqrt(n - 2) / sqrt(1 - rho * rho) AS t FROM (
  SELECT code, instrument_id, corr(e, gap_rel) AS rho, count(*) AS n FROM resid JOIN rel_gap USING (day) WHERE e IS NOT NULL AND {where} GROUP BY 1, 2) WHERE n >= 3) WHERE t >= -1"""


cte("lists", f"SELECT * FROM ({select_sql(f'''day < DATE '{TRAIN_END}' ''')}) WHERE place <= 4", "resid", "rel_gap")


def lists(spark, sf):
    before = F.col("day") < F.lit(TRAIN_END).cast("date")
    return st.select_names(resid(spark, sf).where(before), rel_gap(spark, sf), top=4, t_min=-1.0)


@query("e12_selected_names", "lists", "SELECT code, instrument_id, place, n, round(rho, 6) AS rho, round(t, 5) AS t FROM lists")
def e12(spark, sf):
    return lists(spark, sf).select("code", "instrument_id", F.col("place").cast("long").alias("place"), "n", rounded("rho").alias("rho"), rounded("t", 5).alias("t"))


@query("e14_list_quality", "resid, rel_gap", f"""
WITH td AS (SELECT day, row_number() OVER (ORDER BY day) <= count(*) OVER () // 2 AS front FROM (SELECT DISTINCT day FROM resid WHERE day < DATE '{TRAIN_END}')),
 ch AS (SELECT code, instrument_id FROM ({select_sql('day IN (SELECT day FROM td WHERE front)')}) WHERE place <= 4),
 bk AS (SELECT code, day, any_value(e) AS e, avg(gap_rel) AS g FROM resid JOIN ch USING (code) JOIN rel_gap USING (instrument_id, day) WHERE e IS NOT NULL AND day IN (SELECT day FROM td WHERE NOT front) GROUP BY 1, 2),
 q AS (SELECT code, corr(e, g) AS rho, count(*) AS n FROM bk GROUP BY 1)
SELECT c.code, coalesce(s.k, 0) AS front_list, round(CASE WHEN s.k >= 3 AND n >= 3 THEN rho END, 6) AS back_rho, round(CASE WHEN s.k >= 3 AND n >= 3 THEN rho * sqrt(n - 2) / sqrt(1 - rho * rho) END, 5) AS back_t FROM (SELECT DISTINCT code FROM resid) c LEFT JOIN (SELECT code, count(*) AS k FROM ch GROUP BY 1) s USING (code) LEFT JOIN q USING (code)""")
def e14(spark, sf):
    r = cut_lineage(resid(spark, sf))
    days = r.where(F.col("day") < F.lit(TRAIN_END).cast("date")).select("day").distinct()
    out = st.quality(r, cut_lineage(rel_gap(spark, sf)), days, top=4, t_min=-1.0, min_list=3)
    return out.select("code", "front_list", rounded("back_rho").alias("back_rho"), rounded("back_t", 5).alias("back_t"))


cte("based", """SELECT g.*, CASE WHEN count(ok) OVER w >= 20 THEN avg(ok) OVER w END AS baseline FROM (SELECT g.*, s.ordinal, CASE WHEN c.calm THEN g.first_hour END AS ok FROM rel_gap g JOIN sess s USING (day) LEFT JOIN (SELECT day, calm FROM sigma WHERE code = 'I3') c USING (day)) g
  WINDOW w AS (PARTITION BY instrument_id ORDER BY ordinal RANGE BETWEEN 60 PRECEDING AND 1 PRECEDING)""", "rel_gap", "sigma", "sess")


def based(spark, sf):
    calm = sigma(spark, sf).where("code = 'I3'").select("day", "calm")
    rows = rel_gap(spark, sf).join(calm, "day", "left").withColumn("calm", F.coalesce("calm", F.lit(False)))
    return st.own_baseline(rows, fx.sessions(spark, sf))


@query("e15_own_baseline", "based", "SELECT instrument_id, CAST(day AS VARCHAR) AS day, round(baseline, 8) AS baseline FROM based")
def e15(spark, sf):
    return based(spark, sf).select(*key_day(), rounded("baseline", 8).alias("baseline"))


cte("obs", f"""SELECT s.code, s.day, avg(b.gap - b.ew_gap) AS O1, avg(b.first_hour - b.ew_first_hour) AS O2, avg(b.first_hour - 0.003) AS O3, avg(b.first_hour - b.baseline) AS O4
  FROM sigma s JOIN lists l USING (code) JOIN based b ON b.instrument_id = l.instrument_id AND b.day = s.day WHERE s.big AND s.day >= DATE '{TRAIN_END}' GROUP BY 1, 2""", "sigma", "lists", "based")
cte("ew", """SELECT dropped, question, day, avg(v) AS value FROM (SELECT code, day, q.question, q.v, unnest(['none', 'I3', 'I4', 'I5']) AS dropped FROM (SELECT code, day, unnest([{'question': 'O1', 'v': O1}, {'question': 'O2', 'v': O2}, {'question': 'O3', 'v': O3}, {'question': 'O4', 'v': O4}]) AS q FROM obs) WHERE q.v IS NOT NULL)
  WHERE dropped <> code GROUP BY 1, 2, 3""", "obs")


def observed(spark, sf):
    """Residuals and relative gaps (a row per code or name and session) feed several branches: written once."""
    r, g = cut_lineage(resid(spark, sf)), cut_lineage(rel_gap(spark, sf))
    s = st.trailing_sigma(r)
    signals = s.where(F.col("big") & (F.col("day") >= F.lit(TRAIN_END).cast("date")))
    calm = s.where("code = 'I3'").select("day", "calm")
    rows = g.join(calm, "day", "left").withColumn("calm", F.coalesce("calm", F.lit(False)))
    names = st.select_names(r.where(F.col("day") < F.lit(TRAIN_END).cast("date")), g, top=4, t_min=-1.0)
    obs = st.observations(signals, names, st.own_baseline(rows, fx.sessions(spark, sf)))
    return st.equal_weight(obs, ["O1", "O2", "O3", "O4"], ["I3", "I4", "I5"])


@query("e16_observations", "ew", "SELECT dropped, question, CAST(day AS VARCHAR) AS day, round(value, 8) AS value FROM ew")
def e16(spark, sf):
    return observed(spark, sf).select("dropped", "question", day_text("day").alias("day"), rounded("value", 8).alias("value"))


@query("e16_verdicts", "ew, sess", judge_sql("(SELECT * FROM ew WHERE dropped = 'none')", f"(SELECT day FROM sess WHERE day >= DATE '{TRAIN_END}')", 60, 20, 2.0))
def e16b(spark, sf):
    days = fx.sessions(spark, sf).where(F.col("day") >= F.lit(TRAIN_END).cast("date"))
    values = observed(spark, sf).where("dropped = 'none'").select("question", "day", "value")
    return judge_out(stats.judge(values, stats.split_days(days, st.OVERNIGHT_HOLDOUT)))


@query("e16_list_overlaps", "lists", "SELECT a.code AS a, b.code AS b, count(*) AS shared FROM lists a JOIN lists b USING (instrument_id) WHERE a.code < b.code GROUP BY 1, 2")
def e16c(spark, sf):
    return st.list_overlaps(lists(spark, sf))


cte("pre", "SELECT instrument_id, day, sum(close * volume) FILTER (minute <= 4) AS value, sum(volume) FILTER (minute <= 4) AS v, arg_min(open, minute) FILTER (minute <= 4) AS first_open, arg_max(close, minute) AS pre_close FROM mbars WHERE volume > 0 AND minute <= 49 GROUP BY 1, 2", "mbars")


def pre(spark, sf):
    return st.premarket(fx.minute_bars(spark, sf), min_value=1e6)


@query("e17_premarket_entry", "pre", "SELECT instrument_id, CAST(day AS VARCHAR) AS day, round(CASE WHEN value >= 1e6 THEN value / v END, 6) AS entry, round(first_open, 6) AS first_open, round(pre_close, 6) AS pre_close FROM pre")
def e17(spark, sf):
    return pre(spark, sf).select(*key_day(), *[rounded(c).alias(c) for c in ("entry", "first_open", "pre_close")])


cte("nd", """SELECT instrument_id, day, entry / pc - 1 AS g8, open9 / pc - 1 AS g9, open9 / entry - 1 AS a, close10 / entry - 1 AS b, close10 / open9 - 1 AS krx FROM (
  SELECT p.instrument_id, p.day, CASE WHEN p.value >= 1e6 THEN p.value / p.v END AS entry, x.pc, x.open9, x.close10 FROM pre p JOIN (SELECT instrument_id, day, lag(close) OVER w AS pc, open9, close10 FROM (
    SELECT instrument_id, day, arg_max(close, minute) AS close, arg_min(open, CASE WHEN minute >= 5 THEN minute END) AS open9, arg_max(close, CASE WHEN minute < 60 THEN minute END) AS close10 FROM mbars GROUP BY 1, 2) WINDOW w AS (PARTITION BY instrument_id ORDER BY day)) x USING (instrument_id, day))
 WHERE least(entry, pc, open9, close10) > 0 AND entry IS NOT NULL AND pc IS NOT NULL AND open9 IS NOT NULL AND close10 IS NOT NULL AND abs(entry / pc - 1) < 0.295 AND abs(open9 / pc - 1) <= 0.301""", "pre", "mbars")
ND = ["g8", "g9", "a", "b", "krx"]


def name_days(spark, sf):
    w, m = W.partitionBy("instrument_id").orderBy("day"), F.col("minute")
    days = fx.minute_bars(spark, sf).groupBy("instrument_id", "day").agg(
        F.max_by("close", "minute").alias("close"), F.min_by("open", F.when(m >= 5, m)).alias("open9"), F.max_by("close", F.when(m < 60, m)).alias("close10"))
    rows = pre(spark, sf).join(days.withColumn("prev_close", F.lag("close").over(w)), ["instrument_id", "day"])
    return st.name_days(rows)


@query("e18_name_days", "nd", f"SELECT instrument_id, CAST(day AS VARCHAR) AS day, {', '.join(f'round({c}, 8) AS {c}' for c in ND)} FROM nd")
def e18(spark, sf):
    return name_days(spark, sf).select(*key_day(), *[rounded(c, 8).alias(c) for c in ND])


@query("e19_control_sample", "", """
SELECT CAST(day AS VARCHAR) AS day, ticker, draw FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY sha256(ticker || '|' || strftime(day, '%Y-%m-%d')), ticker) AS draw FROM (
  SELECT DISTINCT CAST(ts AS DATE) AS day, 'T' || user_id AS ticker FROM events WHERE event_type <> 'error' AND NOT (user_id % 10 = 0))) WHERE draw <= 30""")
def e19(spark, sf):
    rows = load(spark, sf, "events").where("event_type <> 'error'").select(F.to_date("ts").alias("day"), F.concat(F.lit("T"), F.col("user_id").cast("string")).alias("ticker"), "user_id").distinct()
    out = st.control_sample(rows.select("day", "ticker"), rows.where("user_id % 10 = 0").select("day", "ticker"))
    return out.select(day_text("day").alias("day"), "ticker", F.col("draw").cast("long").alias("draw"))


cte("nobs", """SELECT s.code, s.day, CASE WHEN any_value(c.n) >= 4 THEN avg(v.a) - any_value(c.ca) END AS N1, avg(v.a) - 0.003 AS N2, avg(v.b) - 0.003 AS N3, CASE WHEN any_value(c.n) >= 4 THEN avg(v.b) - any_value(c.cb) END AS N4
  FROM (SELECT DISTINCT day, code FROM nd, (VALUES ('X0'), ('X1')) t(code) WHERE dayofyear(day) % 3 <> 0) s JOIN nd v ON v.day = s.day AND v.instrument_id < 6 AND 'X' || (v.instrument_id % 2) = s.code
  LEFT JOIN (SELECT day, count(*) AS n, avg(a) AS ca, avg(b) AS cb FROM nd WHERE instrument_id >= 6 GROUP BY 1) c ON c.day = s.day GROUP BY 1, 2 HAVING count(*) >= 2""", "nd")
cte("nq", "SELECT question, day, avg(v) AS value FROM (SELECT day, q.question, q.v FROM (SELECT day, unnest([{'question': 'N1', 'v': N1}, {'question': 'N2', 'v': N2}, {'question': 'N3', 'v': N3}, {'question': 'N4', 'v': N4}]) AS q FROM nobs) WHERE q.v IS NOT NULL) GROUP BY 1, 2", "nobs")


@query("e20_premarket_verdicts", "nq, mbars", judge_sql("nq", "mbars", 6, 10, 2.0))
def e20(spark, sf):
    values = name_days(spark, sf)
    signals = values.where(F.dayofyear("day") % 3 != 0).select("day").distinct().withColumn("code", F.explode(F.array(F.lit("X0"), F.lit("X1"))))
    names = values.select("instrument_id").distinct()
    members_ = names.where("instrument_id < 6").select(F.concat(F.lit("X"), (F.col("instrument_id") % 2).cast("string")).alias("code"), "instrument_id")
    control = values.where("instrument_id >= 6").select("instrument_id", "day")
    obs = st.premarket_observations(signals, members_, values, control, min_control=4)
    daily = st.equal_weight(obs, ["N1", "N2", "N3", "N4"]).select("question", "day", "value")
    return judge_out(stats.judge(daily, stats.split_days(fx.minute_bars(spark, sf).select("day"), 6), min_days=10))


@query("e21_keyword_posts", "", """
SELECT 'document' AS kind, doc_id AS id, regexp_matches(regexp_replace(text, '(?i)(?:https?://|www\\.)\\S+', ' ', 'g'), '(?i)inoran') AS hit FROM documents
UNION ALL SELECT 'page', page_id, regexp_matches(regexp_replace(html, '(?i)(?:https?://|www\\.)\\S+', ' ', 'g'), '(?i)inoran') FROM pages""")
def e21(spark, sf):
    docs = load(spark, sf, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), st.mentions_keyword("text", "inoran").alias("hit"))
    pages = load(spark, sf, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), st.mentions_keyword("html", "inoran").alias("hit"))
    return docs.unionByName(pages)


cte("postwin", "SELECT day, CAST(day AS TIMESTAMP) - INTERVAL 17 HOUR AS start, CAST(day AS TIMESTAMP) AS finish FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events)")


def post_counts(spark, sf):
    rows = load(spark, sf, "events")
    days = rows.select(F.to_date("ts").alias("day")).distinct()
    start = F.col("day").cast("timestamp")
    windows = days.select("day", (start - F.expr("INTERVAL 17 HOUR")).alias("start"), start.alias("end"))
    posts = rows.where("event_type = 'view'").select(F.col("ts").alias("at"))
    return st.counts_in_windows(posts, windows)


@query("e22_posts_in_windows", "postwin", "SELECT CAST(w.day AS VARCHAR) AS day, count(e.event_id) AS posts FROM postwin w LEFT JOIN events e ON e.event_type = 'view' AND e.ts >= w.start AND e.ts < w.finish GROUP BY 1")
def e22(spark, sf):
    return post_counts(spark, sf).select(day_text("day").alias("day"), "posts")


@query("e23_day_values", "moves", """
SELECT CAST(day AS VARCHAR) AS day, round(avg(gap), 8) AS g, round(avg(open_close), 8) AS f, count(*) AS names FROM moves WHERE prev_close > 0 AND abs(gap) <= 0.301 AND gap < 0.295 GROUP BY day HAVING count(*) >= 6""")
def e23(spark, sf):
    return day_values(spark, sf).select(day_text("day").alias("day"), rounded("g", 8).alias("g"), rounded("f", 8).alias("f"), "names")


def day_values(spark, sf):
    rows = st.day_moves(fx.bars(spark, sf)).select("instrument_id", "day", "prev_close", F.col("open").alias("open9"), F.col("close").alias("close10"))
    return st.day_values(rows.where("prev_close IS NOT NULL"), min_names=6)


@query("e24_post_verdicts")
def e24(spark, sf):
    """Orders of priority 1 act as the signal posts; twelve regressions, each a set of Spark sums."""
    urgent = load(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.when(F.col("o_orderpriority") == "1-URGENT", 1)).alias("posts"))
    days = day_values(spark, sf).join(urgent, "day", "left").select(
        "day", "g", "f", F.when(F.col("posts") >= 3, 1).otherwise(0).alias("signal"), (F.dayofmonth("day") % 5 == 0).cast("int").alias("long"), (F.weekday("day") == 0).cast("int").alias("monday"))
    return st.post_window_verdicts(days)


def carried_sql(verdicts, sets):
    """The rules over a verdict query's SQL, looser states included so that all branches occur."""
    parts = []
    for name, questions in sets.items():
        found = ", ".join(f"CASE WHEN NOT EXISTS (SELECT 1 FROM v WHERE question = '{q}' AND {{state}}) THEN '{q}' END" for q in questions)
        parts.append(f"SELECT '{name}' AS rule, list_filter([{found}], lambda x: x IS NOT NULL) AS missing")
    body = " UNION ALL ".join(parts)
    return "WITH v AS (" + verdicts + ") " + " UNION ALL ".join(
        f"SELECT '{label}' AS reading, rule, len(missing) = 0 AS carried_on, array_to_string(missing, ',') AS missing FROM ({body.format(state=state)})" for label, state in (("established", "state = 'established'"), ("judged", "state IS NOT NULL")))


def carried(verdicts, sets):
    out = None
    for label, rows in (("established", verdicts), ("judged", verdicts.where("state IS NOT NULL").withColumn("state", F.lit("established")))):
        part = st.carried_on(rows, sets).select(F.lit(label).alias("reading"), "rule", "carried_on", F.array_join("missing", ",").alias("missing"))
        out = part if out is None else out.unionByName(part)
    return out


OVERNIGHT_SETS = {"overnight": st.CARRIED_ON["overnight"]}
ENTRY_SETS = {k: st.CARRIED_ON[k] for k in ("absolute entry", "entry over control")}


@query("e16_build_rule", "", carried_sql(ORACLES["e16_verdicts"], OVERNIGHT_SETS))
def e16d(spark, sf):
    """Whether the overnight study's next version is built: both of its last questions established (and, as a second reading, judged at all)."""
    return carried(cut_lineage(e16b(spark, sf)), OVERNIGHT_SETS)


@query("e20_candidate_rule", "", carried_sql(ORACLES["e20_premarket_verdicts"], ENTRY_SETS))
def e20b(spark, sf):
    """Whether the pre-market entry becomes a candidate: absolute results or results over the control, each as a pair."""
    return carried(cut_lineage(e20(spark, sf)), ENTRY_SETS)
