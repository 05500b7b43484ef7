"""Queries W1-W5 and K1-K11 (K8 lives with the factors)."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W, functions as F

from knownat.functions.numeric import day_text, key_day, rounded, stamp_text
from knownat.operators import backtest as bt
from knownat.operators import calendar as cal
from knownat.operators import factors as fac
from knownat.operators import pit
from knownat.plans import fixtures as fx
from knownat.plans.calendar import instants
from knownat.plans.factors import technical
from knownat.plans.indicators import W20, W60
from knownat.plans.registry import cte, digest_sql, query
from knownat.session import cut_lineage, shared_folder
from knownat.sources.store import StoredTable

FMT = "'%Y-%m-%d %H:%M:%S'"
NOW = "1999-12-31 23:00:00"
cte("fsig", """SELECT b.instrument_id * 100000 + s.ordinal AS signal_id, b.instrument_id, s.close_at AS decision_at, s.next_day AS entry_day, 'M' || (b.instrument_id % 2) AS market,
  ['BUY_INTEREST', 'WATCH', 'CAUTION', 'ABSTAINED'][(b.instrument_id * 31 + s.ordinal) % 4 + 1] AS action, 'v' || (s.ordinal % 3) AS version FROM bars b JOIN sess s USING (day) WHERE s.next_day IS NOT NULL""", "bars", "sess")


def fsignals(spark, sf):
    rows = fx.bars(spark, sf).select("instrument_id", "day").join(fx.sessions(spark, sf), "day").where("next_day IS NOT NULL")
    i, o = F.col("instrument_id"), F.col("ordinal")
    return rows.select((i * 100000 + o).alias("signal_id"), "instrument_id", F.col("close_at").alias("decision_at"), F.col("next_day").alias("entry_day"),
                       F.concat(F.lit("M"), (i % 2).cast("string")).alias("market"),
                       F.element_at(F.array(*[F.lit(a) for a in ("BUY_INTEREST", "WATCH", "CAUTION", "ABSTAINED")]), ((i * 31 + o) % 4 + 1).cast("int")).alias("action"),
                       F.concat(F.lit("v"), (o % 3).cast("string")).alias("version"))


cte("outcome", f"""SELECT f.*, h.horizon, e.open AS entry_price, x.day AS exit_day, c.close AS exit_price, (c.close / e.open - 1) * 100 AS return_pct FROM fsig f JOIN bars e ON e.instrument_id = f.instrument_id AND e.day = f.entry_day
  JOIN sess s ON s.day = f.entry_day CROSS JOIN (VALUES (1), (5), (20)) h(horizon) JOIN sess x ON x.ordinal = s.ordinal + h.horizon - 1 AND x.close_at <= TIMESTAMP '{NOW}' JOIN bars c ON c.instrument_id = f.instrument_id AND c.day = x.day""", "fsig", "bars", "sess")


def measured(spark, sf):
    return bt.outcomes(fsignals(spark, sf), fx.bars(spark, sf), fx.sessions(spark, sf), now=F.lit(NOW).cast("timestamp"))


@query("w1_outcomes", "outcome", "SELECT signal_id, CAST(horizon AS BIGINT) AS horizon, CAST(exit_day AS VARCHAR) AS exit_day, round(return_pct, 6) AS return_pct FROM outcome")
def w1(spark, sf):
    return measured(spark, sf).select("signal_id", F.col("horizon").cast("long").alias("horizon"), day_text("exit_day").alias("exit_day"), rounded("return_pct").alias("return_pct"))


@query("w2_open_signals", "outcome, fsig", f"""
SELECT f.signal_id, coalesce(n, 0) AS measured FROM fsig f LEFT JOIN (SELECT signal_id, count(*) AS n FROM outcome GROUP BY 1) USING (signal_id)
WHERE coalesce(n, 0) < 3 AND decision_at >= TIMESTAMP '{NOW}' - INTERVAL 60 DAY AND decision_at <= TIMESTAMP '{NOW}'""")
def w2(spark, sf):
    return bt.open_signals(fsignals(spark, sf), measured(spark, sf), F.lit(NOW).cast("timestamp")).select("signal_id", "measured")


@query("w2_inserted_outcomes", "outcome", "SELECT signal_id, CAST(horizon AS BIGINT) AS horizon, CAST(exit_day AS VARCHAR) AS exit_day, round(return_pct, 6) AS return_pct FROM outcome")
def w2b(spark, sf):
    """Outcomes stored as they become measurable: sending known ones again adds nothing."""
    rows = measured(spark, sf).select("signal_id", F.col("horizon").cast("long").alias("horizon"), "exit_day", "return_pct")
    store = StoredTable(spark, new_folder(spark, "outcomes"), ["signal_id", "horizon"])
    store.insert_new(rows.where("horizon = 1"))
    store.insert_new(rows)
    if store.insert_new(rows) is not None:
        raise AssertionError("known outcomes were stored twice")
    return store.read().select("signal_id", "horizon", day_text("exit_day").alias("exit_day"), rounded("return_pct").alias("return_pct"))


def new_folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("w5_candidate_bands", "outcome, fsig", """
WITH r AS (SELECT signal_id, row_number() OVER (PARTITION BY entry_day ORDER BY (instrument_id * 31 + signal_id) % 4, instrument_id) AS rank FROM fsig),
 m AS (SELECT o.*, (r.rank - 1) // 3 * 3 + 1 AS band, return_pct - avg(return_pct) OVER (PARTITION BY horizon, entry_day) AS over_list FROM outcome o JOIN r USING (signal_id))
SELECT CAST(horizon AS BIGINT) AS horizon, CAST(band AS BIGINT) AS band, count(*) AS n, count(DISTINCT entry_day) AS days, round(avg(return_pct), 6) AS mean, round(avg(CASE WHEN return_pct > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate,
  round(avg(over_list), 6) AS mean_excess FROM m GROUP BY 1, 2""")
def w5b(spark, sf):
    """Candidates of a day's list by rank band."""
    place = F.row_number().over(W.partitionBy("entry_day").orderBy((F.col("instrument_id") * 31 + F.col("signal_id")) % 4, "instrument_id"))
    ranks = fsignals(spark, sf).select("signal_id", place.alias("rank"))
    rows = measured(spark, sf).join(ranks, "signal_id").withColumn("day", F.col("entry_day"))
    out = bt.candidate_bands(rows, band=3)
    return out.select(F.col("horizon").cast("long").alias("horizon"), "band", "n", "days", *[rounded(c).alias(c) for c in ("mean", "hit_rate", "mean_excess")])


@query("w3_first_signals", "fsig", """
SELECT min(signal_id) AS signal_id FROM (SELECT *, decision_at + to_hours(CAST(signal_id % 30 AS INTEGER)) AS ingested_at, CAST(entry_day AS TIMESTAMP) AS entry_at FROM fsig UNION ALL SELECT * REPLACE (signal_id + 50000 AS signal_id), decision_at, CAST(entry_day AS TIMESTAMP) FROM fsig)
WHERE version = 'v1' AND ingested_at <= entry_at GROUP BY instrument_id, decision_at""")
def w3(spark, sf):
    rows = fsignals(spark, sf).withColumns({"strategy_version": F.col("version"), "earliest_execution_at": F.col("entry_day").cast("timestamp")})
    first = rows.withColumn("ingested_at", F.timestamp_add("HOUR", (F.col("signal_id") % 30).cast("int"), F.col("decision_at")))
    again = rows.withColumns({"signal_id": F.col("signal_id") + 50000, "ingested_at": F.col("decision_at")})
    return bt.first_signals(first.unionByName(again), "v1").select("signal_id")


cte("frec", """SELECT o.*, CASE WHEN signal_id % 3 <> 0 THEN (signal_id % 41 - 20) / 10.0 END AS points, CASE WHEN signal_id % 5 <> 0 THEN ['RISK_ON', 'NEUTRAL', 'RISK_OFF'][signal_id % 3 + 1] END AS regime, CASE WHEN signal_id % 4 = 0 THEN 'MEASURED' END AS attention,
  return_pct - avg(return_pct) OVER (PARTITION BY horizon, market, entry_day) AS excess FROM outcome o""", "outcome")


def frecords(spark, sf):
    sig = fsignals(spark, sf)
    s = F.col("signal_id")
    twice = sig.select("signal_id", F.explode(F.array(F.lit(2), F.lit(3))).alias("v"))
    overlays = twice.where(s % 3 != 0).select("signal_id", F.col("v").alias("overlay_version"), ((s % 41 - 20) / 10.0 + (3 - F.col("v"))).alias("points"))
    regimes = twice.where(s % 5 != 0).select("signal_id", (F.col("v") - 2).alias("regime_version"), F.element_at(F.array(*[F.lit(x) for x in ("RISK_ON", "NEUTRAL", "RISK_OFF")]), (s % 3 + 1).cast("int")).alias("label"))
    attention = sig.where(s % 4 == 0).select("signal_id", F.lit(1).alias("attention_version"), F.lit("MEASURED").alias("status"))
    return bt.records(measured(spark, sf), overlays, regimes, attention, overlay_version=3, regime_version=1, attention_version=1)


@query("w4_signal_records", "frec", "SELECT signal_id, CAST(horizon AS BIGINT) AS horizon, round(points, 6) AS points, regime, attention, round(excess, 6) AS excess FROM frec")
def w4(spark, sf):
    return frecords(spark, sf).select("signal_id", F.col("horizon").cast("long").alias("horizon"), rounded("points").alias("points"), "regime", "attention", rounded("excess").alias("excess"))


@query("w5_forward_report", "frec", """
SELECT CAST(horizon AS BIGINT) AS horizon, l.grouping AS "grouping", l.label AS label, count(*) AS n, count(DISTINCT entry_day) AS days, round(avg(return_pct), 6) AS mean, round(median(return_pct), 6) AS median, round(avg(CASE WHEN return_pct > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, round(avg(excess), 6) AS mean_excess
FROM (SELECT *, unnest([{'grouping': 'action', 'label': action}, {'grouping': 'overlay', 'label': CASE WHEN points IS NULL THEN 'no overlay' WHEN points >= 1 THEN 'good news' WHEN points <= -1 THEN 'bad news' ELSE 'neutral' END},
  {'grouping': 'regime', 'label': coalesce(regime, 'no regime')}, {'grouping': 'attention', 'label': coalesce(attention, 'not recorded')}]) AS l FROM frec) GROUP BY 1, 2, 3""")
def w5(spark, sf):
    out = bt.forward_report(cut_lineage(frecords(spark, sf)))
    return out.select(F.col("horizon").cast("long").alias("horizon"), "grouping", "label", "n", "days", *[rounded(c).alias(c) for c in ("mean", "median", "hit_rate", "mean_excess")])


# ---------------------------------------------------------------- strategies and execution
@query("k1_strategy_signals", "tech", f"""
SELECT instrument_id, CAST(day AS VARCHAR) AS day, 'ma' AS strategy, CASE WHEN count(*) OVER {W60} < 60 THEN 'ABSTAIN' WHEN avg(close) OVER {W20} > avg(close) OVER {W60} THEN 'ENTER' ELSE 'EXIT' END AS signal FROM bars
UNION ALL SELECT instrument_id, CAST(day AS VARCHAR), 'hold', 'ENTER' FROM bars
UNION ALL SELECT instrument_id, CAST(day AS VARCHAR), 'scored', CASE WHEN bars < 60 THEN 'ABSTAIN' WHEN technical_score >= 70 THEN 'ENTER' WHEN technical_score <= 35 THEN 'EXIT' ELSE 'HOLD' END FROM tech""")
def k1(spark, sf):
    bars = fx.bars(spark, sf)
    scored = technical(spark, sf).withColumn("action", F.when(~F.col("technical_available"), "ABSTAINED").otherwise(fac.action_for(F.col("technical_score") * 0.6, F.lit(0.6))))
    parts = {"ma": bt.moving_average_cross(bars), "hold": bt.buy_and_hold(bars), "scored": bt.scored_rule(scored)}
    out = None
    for name, df in parts.items():
        part = df.select(*key_day(), F.lit(name).alias("strategy"), "signal")
        out = part if out is None else out.unionByName(part)
    return out


@query("k2_earliest_execution", "sess, instant", f"""
WITH x AS (SELECT i.at, s.open_at, s.close_at, (SELECT min(o.open_at) FROM sess o WHERE o.open_at > i.at AND o.day >= CAST(i.at AS DATE) AND o.day <= CAST(i.at AS DATE) + 30) AS nxt FROM instant i LEFT JOIN sess s ON s.day = CAST(i.at AS DATE)),
 y AS (SELECT *, CASE WHEN x.at >= open_at AND x.at < close_at THEN open_at + to_minutes(CAST(ceil(date_diff('microsecond', open_at, x.at) / 60e6 / 30) * 30 AS BIGINT)) END AS boundary FROM x)
SELECT strftime(y.at, {FMT}) AS at, strftime(nxt, {FMT}) AS next_open, strftime(CASE WHEN boundary < close_at THEN boundary ELSE nxt END, {FMT}) AS next_bar FROM y""")
def k2(spark, sf):
    sess = fx.sessions(spark, sf)
    spine = cal.day_spine(sess)
    rows = cal.next_tradable_open(instants(spark, sf, spine), spine, name="next_open")
    rows = cal.open_state(rows, sess).withColumn("day", F.to_date("at")).join(sess.select("day", "open_at", "close_at"), "day", "left")
    boundary = cal.bar_boundary("at", "open_at", 30)
    bar = F.when(F.col("is_open") & (boundary < F.col("close_at")), boundary).otherwise(F.col("next_open"))
    return rows.select(stamp_text("at").alias("at"), stamp_text("next_open").alias("next_open"), stamp_text(bar).alias("next_bar"))


WINDOWS = dict(train=500, evaluate=200, holdout=120)


def windows(spark, sf, **kw):
    return bt.walk_forward_windows(fx.sessions(spark, sf), **{**WINDOWS, **kw})


def strategies(spark, sf):
    bars = fx.bars(spark, sf)
    parts = [("ma-20-60", bt.build(bars, "moving_average_cross", {"short": 20, "long": 60})), ("ma-5-20", bt.build(bars, "moving_average_cross", {"short": 5, "long": 20})), ("hold", bt.build(bars, "buy_and_hold", {}))]
    out = None
    for name, df in parts:
        part = df.select("instrument_id", F.lit(name).alias("strategy"), "day", "open", "close", "signal")
        out = part if out is None else out.unionByName(part)
    return out


KEYS = ["instrument_id", "strategy"]


def fills(spark, sf):
    return bt.filled(bt.decisions(strategies(spark, sf), fx.sessions(spark, sf), windows(spark, sf), KEYS), KEYS)


@query("k4_performance", "bars", """
WITH r AS (SELECT *, close / lag(close) OVER w - 1 AS r, close / max(close) OVER (PARTITION BY instrument_id ORDER BY day ROWS UNBOUNDED PRECEDING) - 1 AS d FROM bars WINDOW w AS (PARTITION BY instrument_id ORDER BY day))
SELECT instrument_id, count(r) AS observations, round(arg_max(close, day) / arg_min(close, day) - 1, 8) AS total_return, round(pow(arg_max(close, day) / arg_min(close, day), 365.25 / (max(day) - min(day))) - 1, 8) AS cagr, round(min(d), 8) AS max_drawdown, round(avg(r) / stddev_samp(r) * sqrt(252.0), 6) AS sharpe FROM r GROUP BY 1""")
def k4(spark, sf):
    out = bt.performance(fx.bars(spark, sf).select("instrument_id", "day", F.col("close").alias("equity")), ["instrument_id"])
    return out.select("instrument_id", "observations", *[rounded(c, 8).alias(c) for c in ("total_return", "cagr", "max_drawdown")], rounded("sharpe").alias("sharpe"))


@query("k4_trade_stats", "bars", """
SELECT instrument_id, count(*) AS trades, round(avg(CASE WHEN p > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate, round(sum(p) FILTER (p > 0) / -sum(p) FILTER (p < 0), 6) AS profit_factor FROM (SELECT instrument_id, close - open AS p FROM bars) GROUP BY 1""")
def k4b(spark, sf):
    out = bt.trade_stats(fx.bars(spark, sf).select("instrument_id", (F.col("close") - F.col("open")).alias("pnl")), ["instrument_id"])
    return out.select("instrument_id", "trades", rounded("win_rate").alias("win_rate"), rounded("profit_factor").alias("profit_factor"))


def window_sql(anchored):
    lo = "1" if anchored else "i * 200 + 1"
    return f"""WITH n AS (SELECT max(ordinal) AS n FROM sess), w AS (SELECT i, n FROM n, range(20) t(i) WHERE i * 200 + 700 <= n - 120), s AS (SELECT i AS window_index, 'TRAIN' AS sample, {lo} AS f, i * 200 + 500 AS l FROM w UNION ALL SELECT i, 'EVALUATE', i * 200 + 501, i * 200 + 700 FROM w
  UNION ALL SELECT -1, 'HOLDOUT', n - 119, n FROM n) SELECT CAST(window_index AS BIGINT) AS window_index, sample, CAST(a.day AS VARCHAR) AS start_day, CAST(b.day AS VARCHAR) AS end_day, l - f + 1 AS sessions FROM s JOIN sess a ON a.ordinal = f JOIN sess b ON b.ordinal = l"""


def window_out(df):
    return df.select("window_index", "sample", day_text("start_day").alias("start_day"), day_text("end_day").alias("end_day"), "sessions")


@query("k5_rolling_windows", "sess", window_sql(False))
def k5(spark, sf):
    return window_out(windows(spark, sf))


@query("k5_anchored_windows", "sess", window_sql(True))
def k5b(spark, sf):
    return window_out(windows(spark, sf, anchored=True))


W5 = W20.replace("19", "4")
cte("fills", f"""WITH sig AS (SELECT instrument_id, 'ma-20-60' AS strategy, day, open, close, CASE WHEN count(*) OVER {W60} < 60 THEN 'ABSTAIN' WHEN avg(close) OVER {W20} > avg(close) OVER {W60} THEN 'ENTER' ELSE 'EXIT' END AS signal FROM bars
  UNION ALL SELECT instrument_id, 'ma-5-20', day, open, close, CASE WHEN count(*) OVER {W20} < 20 THEN 'ABSTAIN' WHEN avg(close) OVER {W5} > avg(close) OVER {W20} THEN 'ENTER' ELSE 'EXIT' END FROM bars UNION ALL SELECT instrument_id, 'hold', day, open, close, 'ENTER' FROM bars),
 win AS (SELECT window_index, sample, CAST(start_day AS DATE) AS a, CAST(end_day AS DATE) AS z FROM ({window_sql(False)})),
 grid AS (SELECT k.*, s.day, s.next_day FROM (SELECT DISTINCT instrument_id, strategy FROM sig) k CROSS JOIN sess s),
 m AS (SELECT g.*, b.close IS NOT NULL AS own_bar, b.signal, lead(b.open) OVER (PARTITION BY g.instrument_id, g.strategy ORDER BY g.day) AS next_open FROM grid g LEFT JOIN sig b USING (instrument_id, strategy, day)),
 u AS (SELECT m.*, win.window_index, win.sample, own_bar AND signal IN ('ENTER', 'EXIT') AND coalesce(next_day <= z AND next_open > 0, false) AS usable FROM m JOIN win ON m.day BETWEEN a AND z),
 p AS (SELECT *, coalesce(last_value(CASE WHEN usable THEN signal END IGNORE NULLS) OVER (PARTITION BY instrument_id, strategy, window_index, sample ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'EXIT') AS was FROM u),
 f AS (SELECT *, CASE signal WHEN 'ENTER' THEN 'BUY' ELSE 'SELL' END AS fill, next_open * CASE signal WHEN 'ENTER' THEN 1.0005 ELSE 0.9995 END AS price FROM p WHERE usable AND signal <> was)
 SELECT *, CASE WHEN fill = 'SELL' THEN price * 0.9995 / (lag(price) OVER (PARTITION BY instrument_id, strategy, window_index, sample ORDER BY day) * 1.0005) - 1 END AS trade_return FROM f""", "bars", "sess")


@query("k3_fills", "fills", """
SELECT instrument_id, strategy, CAST(window_index AS BIGINT) AS window_index, sample, CAST(day AS VARCHAR) AS day, fill, round(price, 4) AS price, round(trade_return, 6) AS trade_return FROM fills""")
def k3(spark, sf):
    return fills(spark, sf).where("fill IS NOT NULL").select("instrument_id", "strategy", "window_index", "sample", day_text("day").alias("day"), "fill", rounded("price", 4).alias("price"), rounded("trade_return").alias("trade_return"))


RES = ["total_return", "max_drawdown", "sharpe", "win_rate", "profit_factor"]


@query("k6_walk_forward")
def k6(spark, sf):
    """Every strategy in and out of sample per window, and the one fitted on each training window."""
    results = bt.window_results(fills(spark, sf), KEYS)
    fixed = results.select(F.lit("fixed").alias("mode"), *KEYS, "window_index", "sample", "sessions", "trades", *[rounded(c).alias(c) for c in RES])
    fitted = bt.choose_fitted(results, ["instrument_id"]).select(F.lit("fitted").alias("mode"), *KEYS, "window_index", "sample", "sessions", "trades", *[rounded(c).alias(c) for c in RES])
    return fixed.unionByName(fitted)


START, END = "1995-01-02", "1997-06-30"


@query("k7_data_gates", "bars, fact, sess", f"""
WITH ids AS (SELECT instrument_id, min(day) AS fb, max(day) AS lb FROM bars GROUP BY 1), want AS (SELECT count(*) AS n FROM sess WHERE day BETWEEN DATE '{START}' AND DATE '{END}'),
 have AS (SELECT instrument_id, count(*) AS n FROM bars WHERE day BETWEEN DATE '{START}' AND DATE '{END}' GROUP BY 1), ff AS (SELECT instrument_id, min(filed_at) AS a, max(filed_at) FILTER (filed_at <= DATE '{END}') AS z FROM fact WHERE period_start IS NOT NULL GROUP BY 1),
 g AS (SELECT instrument_id, count(*) AS n FROM (SELECT *, lead(period_end) OVER (PARTITION BY instrument_id ORDER BY period_end) AS nx FROM (SELECT DISTINCT instrument_id, period_end FROM fact WHERE period_start IS NOT NULL)) WHERE nx - period_end > 430 AND period_end < DATE '{END}' AND nx > DATE '{START}' GROUP BY 1),
 v AS (SELECT instrument_id, min(m) AS o FROM (SELECT instrument_id, max(semantic_version) AS m FROM fact GROUP BY instrument_id, concept, unit, period_start, period_end, filed_at) GROUP BY 1)
SELECT i.instrument_id, array_to_string(list_filter([CASE WHEN fb > DATE '{START}' OR lb < DATE '{END}' THEN 'prices do not span the period' END, CASE WHEN coalesce(h.n, 0) < want.n THEN 'sessions without a bar' END, CASE WHEN a IS NULL OR a > DATE '{START}' THEN 'filings start too late' END,
  CASE WHEN g.n > 0 THEN 'annual filings have a gap' END, CASE WHEN z IS NULL OR DATE '{END}' - z > 550 THEN 'newest filing is too old' END, CASE WHEN o IS NULL OR o < 1 THEN 'facts read by an old version' END], lambda x: x IS NOT NULL), '; ') AS refusals
FROM ids i, want LEFT JOIN have h ON h.instrument_id = i.instrument_id LEFT JOIN ff ON ff.instrument_id = i.instrument_id LEFT JOIN g ON g.instrument_id = i.instrument_id LEFT JOIN v ON v.instrument_id = i.instrument_id""")
def k7(spark, sf):
    bars, facts = fx.bars(spark, sf), fx.facts(spark, sf)
    span = bars.groupBy("instrument_id").agg(F.min("day").alias("first_bar"), F.max("day").alias("last_bar"))
    out = bt.data_gates(span, bars, fx.sessions(spark, sf), facts, pit.annual_gaps(facts), pit.oldest_reading_version(facts), start=START, end=END, current_version=1)
    return out.select("instrument_id", F.array_join("refusals", "; ").alias("refusals"))


@query("k9_fingerprints", "", """
SELECT p_partkey AS id, substr(sha256('ma|' || p_brand || '|' || 'long=' || (p_size + 60) || ',short=' || p_size), 1, 16) AS fingerprint FROM part""")
def k9(spark, sf):
    from knownat.sources.tables import load
    size = F.col("p_size")
    params = F.create_map(F.lit("short"), size.cast("string"), F.lit("long"), (size + 60).cast("string"))
    return load(spark, sf, "part").select(F.col("p_partkey").alias("id"), bt.fingerprint(F.lit("ma"), F.col("p_brand"), params).alias("fingerprint"))


@query("k9_fit_trace", "", f"SELECT p_brand, substr(digest, 1, 16) AS fit_trace FROM ({digest_sql('part', 'p_brand', 'p_partkey', "p_partkey || ':' || p_type", ';')})")
def k9b(spark, sf):
    from knownat.sources.tables import load
    rows = load(spark, sf, "part").select("p_brand", F.col("p_partkey").alias("window_index"), F.col("p_type").alias("chosen_fingerprint"))
    return bt.trace_fingerprint(rows, ["p_brand"])


@query("k10_reproduce")
def k10(spark, sf):
    """Two independent runs of the same windows must agree; a stored copy with one changed measure must not."""
    first = bt.window_results(fills(spark, sf), KEYS)
    stored = first.withColumn("trades", F.when(F.col("strategy") == "ma-5-20", F.col("trades") + 1).otherwise(F.col("trades")))
    out = bt.reproduce(stored, bt.window_results(fills(spark, sf), KEYS), [*KEYS, "window_index", "sample"])
    return out.select(*KEYS, "window_index", "sample", F.array_join("differences", ",").alias("differences"))


cte("swin", """SELECT l_suppkey AS run_id, l_orderkey % 40 AS window_index, CASE l_linenumber % 5 WHEN 0 THEN 'HOLDOUT' WHEN 1 THEN 'TRAIN' ELSE 'EVALUATE' END AS sample, CAST(l_shipdate AS DATE) AS start_day, CAST(l_shipdate AS DATE) + CAST(l_quantity AS INTEGER) AS end_day FROM lineitem""")


def stored_windows(spark, sf):
    from knownat.sources.tables import load
    kind = F.col("l_linenumber") % 5
    return load(spark, sf, "lineitem").select(F.col("l_suppkey").alias("run_id"), (F.col("l_orderkey") % 40).alias("window_index"), F.when(kind == 0, "HOLDOUT").when(kind == 1, "TRAIN").otherwise("EVALUATE").alias("sample"),
                                              F.to_date("l_shipdate").alias("start_day"), F.date_add(F.to_date("l_shipdate"), F.col("l_quantity").cast("int")).alias("end_day"))


@query("k10_integrity", "swin", """
SELECT DISTINCT run_id, 'evaluation windows overlap' AS finding FROM (SELECT *, lag(end_day) OVER (PARTITION BY run_id ORDER BY start_day) AS p FROM swin WHERE sample = 'EVALUATE') WHERE start_day <= p
UNION SELECT e.run_id, 'training reaches into evaluation' FROM swin e JOIN swin t ON t.run_id = e.run_id AND t.window_index = e.window_index AND t.sample = 'TRAIN' WHERE e.sample = 'EVALUATE' AND t.end_day >= e.start_day
UNION SELECT run_id, 'more than one hold-out' FROM swin WHERE sample = 'HOLDOUT' GROUP BY 1 HAVING count(*) > 1
UNION SELECT h.run_id, 'hold-out is not after the evaluations' FROM swin h JOIN (SELECT run_id, max(end_day) AS le FROM swin WHERE sample = 'EVALUATE' GROUP BY 1) l USING (run_id) WHERE h.sample = 'HOLDOUT' AND h.start_day <= le""")
def k10b(spark, sf):
    return bt.integrity(stored_windows(spark, sf))


@query("k11_storable_windows", "", """
SELECT o_orderkey AS window_id, CASE WHEN o_orderstatus = 'F' AND h.run_id IS NOT NULL THEN 'hold-out already used' WHEN o_orderstatus = 'F' AND o_custkey % 7 = 3 THEN 'hold-out of another experiment' END AS refused
FROM orders LEFT JOIN (SELECT DISTINCT o_custkey AS run_id FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F') h ON h.run_id = o_custkey WHERE o_orderpriority <> '1-URGENT'""")
def k11(spark, sf):
    from knownat.sources.tables import load
    rows = load(spark, sf, "orders").select(F.col("o_orderkey").alias("window_id"), F.col("o_custkey").alias("run_id"), F.when(F.col("o_orderstatus") == "F", "HOLDOUT").otherwise("EVALUATE").alias("sample"), "o_orderpriority")
    rows = rows.withColumns({"strategy": F.when(F.col("run_id") % 7 == 3, "other").otherwise("ma"), "holdout_start": F.lit(None).cast("date")})
    runs = rows.select("run_id").distinct().withColumns({"strategy": F.lit("ma"), "holdout_start": F.lit(None).cast("date")})
    old, new = rows.where("o_orderpriority = '1-URGENT'"), rows.where("o_orderpriority <> '1-URGENT'")
    return bt.storable_windows(old, new, runs, ["strategy", "holdout_start"]).select("window_id", "refused")


@query("k11_stored_runs", "", """
SELECT o_custkey AS run_id, 'ma' AS strategy, count(*) FILTER (o_orderstatus <> 'F') + max(CASE WHEN o_orderstatus = 'F' AND o_custkey % 7 <> 3 THEN 1 ELSE 0 END) AS windows,
  CAST(max(CASE WHEN o_orderstatus = 'F' AND o_custkey % 7 <> 3 THEN 1 ELSE 0 END) AS BIGINT) AS holdouts FROM orders GROUP BY 1""")
def k11b(spark, sf):
    """Runs and windows stored in three sendings, the last a repetition, and listed: one hold-out a run, none of another experiment."""
    from knownat.sources.tables import load
    rows = load(spark, sf, "orders").select(
        F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("window_index"), F.when(F.col("o_orderstatus") == "F", "HOLDOUT").otherwise("EVALUATE").alias("sample"),
        F.when(F.col("o_custkey") % 7 == 3, "other").otherwise("ma").alias("strategy"), F.col("o_totalprice").alias("total_return"), F.col("o_orderpriority").alias("priority"))
    store = bt.RunStore(spark, new_folder(spark, "runs"), ["strategy"])
    runs = rows.select("run_id").distinct().withColumn("strategy", F.lit("ma"))
    for _ in range(2):
        store.save_runs(runs)
    for part in ("priority = '1-URGENT'", "priority <> '1-URGENT'", "priority <> '1-URGENT'"):
        store.save_windows(rows.where(part).drop("priority"))
    return store.list_runs().select("run_id", "strategy", "windows", "holdouts")
