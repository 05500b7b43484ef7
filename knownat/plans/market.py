"""Queries M1-M15 and L1-L11."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from knownat.functions.numeric import day_text, key_day, rounded, stamp_text
from knownat.operators import calendar as cal
from knownat.operators import market as mk
from knownat.operators import news as nw
from knownat.operators import selection as sel
from knownat.operators import studies
from knownat.plans import fixtures as fx
from knownat.plans.news import WIN, n18, spans, titles
from knownat.plans.registry import ORACLES, cte, digest_sql, query
from knownat.plans.rules import tick
from knownat.sources.tables import load

cte("vol", """SELECT *, CASE WHEN n > 20 THEN stddev_samp(r) OVER (PARTITION BY instrument_id ORDER BY day ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) * sqrt(252.0) END AS v FROM (
  SELECT instrument_id, day, close, ln(close / lag(close) OVER w) AS r, row_number() OVER w AS n, lag(close, 20) OVER w AS c20, avg(close) OVER (PARTITION BY instrument_id ORDER BY day ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS m FROM bars WINDOW w AS (PARTITION BY instrument_id ORDER BY day))""", "bars")
cte("regime", """SELECT *, CASE WHEN trend_gap IS NULL THEN 'UNKNOWN' WHEN trend_gap > 0 AND volatility_rank < 0.8 THEN 'RISK_ON' WHEN trend_gap <= 0 AND volatility_rank >= 0.8 THEN 'RISK_OFF' ELSE 'NEUTRAL' END AS label FROM (
  SELECT instrument_id, day, close, CASE WHEN n >= 271 THEN close / m - 1 END AS trend_gap, CASE WHEN n >= 271 THEN close / c20 - 1 END AS return_20d, CASE WHEN n >= 271 THEN v END AS volatility,
   CASE WHEN n >= 271 THEN len(list_filter(past, lambda x: x < v)) / 249.0 END AS volatility_rank FROM (SELECT *, list(v) OVER (PARTITION BY instrument_id ORDER BY day ROWS BETWEEN 249 PRECEDING AND 1 PRECEDING) AS past FROM vol))""", "vol")


@query("m1_regime", "regime", """SELECT instrument_id, CAST(day AS VARCHAR) AS day, round(trend_gap, 6) AS trend_gap, round(return_20d, 6) AS return_20d, round(volatility, 6) AS volatility, round(volatility_rank, 6) AS volatility_rank, label FROM regime""")
def m1(spark, sf):
    return mk.regime(fx.bars(spark, sf)).select(*key_day(), *[rounded(c).alias(c) for c in ("trend_gap", "return_20d", "volatility", "volatility_rank")], "label")


@query("m2_breadth", "bars", """
SELECT CAST(day AS VARCHAR) AS day, round(avg(CASE WHEN close > m THEN 1.0 ELSE 0.0 END), 6) AS breadth, count(*) AS names FROM (SELECT day, close, avg(close) OVER w AS m, count(*) OVER w AS n FROM bars
 WINDOW w AS (PARTITION BY instrument_id ORDER BY day ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)) WHERE n = 50 GROUP BY 1""")
def m2(spark, sf):
    return mk.breadth(fx.bars(spark, sf)).select(day_text("day").alias("day"), rounded("breadth").alias("breadth"), "names")


cte("sigs", "SELECT o_orderkey AS signal_id, o_orderdate + to_minutes(o_custkey * 37 % 1440) AS decision_at, o_custkey % 8 AS k FROM orders")


@query("m3_signal_regime", "regime, sigs, sess", """
SELECT s.signal_id, CAST(x.day AS VARCHAR) AS day, coalesce(r.label, 'UNKNOWN') AS label FROM (SELECT *, (SELECT max(day) FROM sess WHERE close_at <= decision_at) AS day FROM sigs) x JOIN sigs s USING (signal_id) LEFT JOIN regime r ON r.instrument_id = s.k AND r.day = x.day""")
def m3(spark, sf):
    signals = load(spark, sf, "orders").select(
        F.col("o_orderkey").alias("signal_id"), F.timestamp_add("MINUTE", (F.col("o_custkey") * 37 % 1440).cast("int"), F.col("o_orderdate")).alias("decision_at"), (F.col("o_custkey") % 8).alias("index_code"))
    regimes = mk.regime(fx.bars(spark, sf)).withColumnRenamed("instrument_id", "index_code")
    sess = fx.sessions(spark, sf)
    return mk.signal_regimes(signals, regimes, sess, cal.day_spine(sess)).select("signal_id", day_text("day").alias("day"), "label")


cte("won", "SELECT instrument_id, day, round(open * 100) AS open, round(high * 100) AS high, round(low * 100) AS low, round(close * 100) AS close, volume FROM bars", "bars")


def won(spark, sf):
    """Bars in whole units, rounded half away from zero in both engines."""
    return fx.bars(spark, sf).select("instrument_id", "day", *[F.round(F.col(c) * 100).alias(c) for c in ("open", "high", "low", "close")], "volume")


def limit_sql(base):
    raw = f"CAST(floor({base} * 13 / 10) AS BIGINT)"
    return f"CASE WHEN {base} > 0 AND CAST({base} AS BIGINT) % {tick(base)} = 0 THEN {raw} // {tick(raw)} * {tick(raw)} END"


cte("limits", f"""SELECT *, CASE WHEN least(open, high, low, close) >= lim THEN 'LOCKED' WHEN close >= lim THEN 'CLOSED' WHEN high >= lim THEN 'TOUCHED' END AS state FROM (SELECT *, {limit_sql('base')} AS lim FROM (
  SELECT *, lag(close) OVER w AS base, lag(day) OVER w AS base_day FROM won WINDOW w AS (PARTITION BY instrument_id ORDER BY day)))""", "won")


@query("m4_price_limit", "limits", "SELECT instrument_id, CAST(day AS VARCHAR) AS day, CAST(lim AS BIGINT) AS upper_limit, state FROM limits")
def m4(spark, sf):
    w = W.partitionBy("instrument_id").orderBy("day")
    return won(spark, sf).withColumn("base", F.lag("close").over(w)).select(*key_day(), mk.upper_limit("base").alias("upper_limit"), mk.limit_state().alias("state"))


@query("m5_previous_limits", "limits, sess", """
SELECT l.instrument_id, CAST(s.next_day AS VARCHAR) AS for_day, l.close, round((l.close / l.base - 1) * 100, 6) AS change_pct, l.state FROM limits l JOIN sess s USING (day) WHERE s.next_day IS NOT NULL AND l.base > 0 AND l.day - l.base_day <= 60""")
def m5(spark, sf):
    out = mk.previous_limits(won(spark, sf), fx.sessions(spark, sf))
    return out.select("instrument_id", day_text("for_day").alias("for_day"), "close", rounded("change_pct").alias("change_pct"), "state")


@query("m6_weight_tables", "sess, asked", """
WITH t AS (SELECT day FROM sess WHERE extract('month' FROM day) % 3 = 0 AND ordinal % 7 = 0), d AS (SELECT day FROM asked WHERE day IN (SELECT day FROM sess)),
 x AS (SELECT d.day, (SELECT max(day) FROM t WHERE t.day < d.day) AS b, (SELECT min(day) FROM t WHERE t.day >= d.day) AS a FROM d),
 y AS (SELECT x.*, (SELECT ordinal FROM sess WHERE day = x.day) - (SELECT ordinal FROM sess WHERE day = b) AS age FROM x)
SELECT CAST(day AS VARCHAR) AS day, CAST(CASE WHEN age <= 10 THEN b ELSE a END AS VARCHAR) AS table_day, NOT coalesce(age <= 10, false) AND a IS NOT NULL AS after_the_fact FROM y""")
def m6(spark, sf):
    sess = fx.sessions(spark, sf)
    days = fx.asked_days(spark, sf).join(sess.select("day"), "day", "left_semi")
    out = mk.weight_tables(days, sess.where((F.month("day") % 3 == 0) & (F.col("ordinal") % 7 == 0)), cal.day_spine(sess))
    return out.select(day_text("day").alias("day"), day_text("table_day").alias("table_day"), "after_the_fact")


@query("m6_heavyweights", "", "SELECT p_partkey AS instrument_id, p_size / 5.0 AS weight_pct, p_size / 5.0 >= 5 AS heavyweight FROM part")
def m6b(spark, sf):
    return mk.heavyweights(load(spark, sf, "part").select(F.col("p_partkey").alias("instrument_id"), (F.col("p_size") / 5.0).alias("weight_pct")))


@query("m7_expected_gap", "", """
SELECT id, round(change_pct, 6) AS change_pct, coalesce(e > 0 AND v > 0 AND abs(change_pct - rep) <= 0.15, false) AS judgeable, coalesce(abs(change_pct - rep) > 0.15, false) AS mismatched, coalesce(e > 0 AND v > 0 AND abs(change_pct - rep) <= 0.15 AND change_pct >= 3, false) AS gap_up
FROM (SELECT *, CASE WHEN e IS NOT NULL AND e <> 0 AND b > 0 THEN (e / b - 1) * 100 END AS change_pct FROM (
  SELECT p_partkey AS id, CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice END AS e, 900.0 + p_size AS b, CASE WHEN p_partkey % 5 <> 0 THEN round((p_retailprice / (900.0 + p_size) - 1) * 100 + CASE WHEN p_partkey % 3 = 0 THEN 0.5 ELSE 0.0 END, 2) END AS rep, p_partkey % 4 AS v FROM part))""")
def m7(spark, sf):
    key, price, base = F.col("p_partkey"), F.col("p_retailprice"), F.lit(900.0) + F.col("p_size")
    quotes = load(spark, sf, "part").select(
        key.alias("id"), F.when(key % 7 != 0, price).alias("expected_price"), base.alias("base_price"),
        F.when(key % 5 != 0, F.round((price / base - 1) * 100 + F.when(key % 3 == 0, 0.5).otherwise(0.0), 2)).alias("reported_pct"), (key % 4).alias("volume"))
    return mk.expected_gap(quotes).select("id", rounded("change_pct").alias("change_pct"), "judgeable", "mismatched", "gap_up")


@query("m8_overnight_reference", "bars, sess", """
WITH u AS (SELECT CAST(day AS TIMESTAMP) - INTERVAL 3 HOUR AS t, close FROM bars WHERE instrument_id = 3), d AS (SELECT day, open_at, lag(close_at) OVER (ORDER BY day) AS prev_close FROM sess),
 a AS (SELECT day, (SELECT arg_max(close, t) FROM u WHERE t < open_at) AS p1, (SELECT max(t) FROM u WHERE t < open_at) AS t1, (SELECT arg_max(close, t) FROM u WHERE t < prev_close) AS p0, (SELECT max(t) FROM u WHERE t < prev_close) AS t0 FROM d WHERE prev_close IS NOT NULL),
 r AS (SELECT day, CASE WHEN t1 IS NOT NULL AND t0 IS NOT NULL AND t1 <> t0 THEN p1 / p0 - 1 END AS r FROM a)
SELECT CAST(day AS VARCHAR) AS day, CASE WHEN abs(r) <= 0.3 THEN round(r * 100, 6) END AS change_pct, coalesce(abs(r) > 0.3, false) AS split_suspect FROM r""")
def m8(spark, sf):
    series = fx.bars(spark, sf).where("instrument_id = 3").select((F.col("day").cast("timestamp") - F.expr("INTERVAL 3 HOUR")).alias("t"), F.col("close").alias("price"))
    out = studies.overnight_reference(fx.sessions(spark, sf), series.withColumn("code", F.lit("X")))
    return out.select(day_text("day").alias("day"), rounded("change_pct").alias("change_pct"), "split_suspect")


cte("grp", "SELECT instrument_id, pfx, count(*) OVER (PARTITION BY pfx) AS n FROM (SELECT p_partkey AS instrument_id, p_brand || p_name[1:3] || (p_partkey % 5) AS pfx FROM part)")


def part_names(spark, sf):
    return load(spark, sf, "part").select(F.col("p_partkey").alias("instrument_id"), F.col("p_name").alias("name"),
                                          F.concat("p_brand", F.substring("p_name", 1, 3), (F.col("p_partkey") % 5).cast("string")).alias("pfx"))


def name_pairs(spark, sf):
    return mk.name_groups(part_names(spark, sf), prefix=F.col("pfx"))


@query("m9_name_groups", "grp", "SELECT a.instrument_id, b.instrument_id AS related_id FROM grp a JOIN grp b USING (pfx) WHERE a.n BETWEEN 2 AND 6 AND a.instrument_id <> b.instrument_id")
def m9(spark, sf):
    return name_pairs(spark, sf)


@query("m10_resolve_names", "", """
WITH m AS (SELECT upper(replace(p_brand || p_type || p_size, ' ', '')) AS n, count(*) AS c, max(p_partkey) AS id FROM part GROUP BY 1)
SELECT c_custkey AS row_id, CASE WHEN m.c = 1 THEN m.id END AS instrument_id FROM customer LEFT JOIN m ON m.n = upper('Brand#' || (c_custkey % 25 + 1) || 'Small' || (c_custkey % 50 + 1))""")
def m10(spark, sf):
    master = load(spark, sf, "part").select(F.col("p_partkey").alias("instrument_id"), F.concat_ws(" ", "p_brand", "p_type", "p_size").alias("name"))
    k = F.col("c_custkey")
    asked = load(spark, sf, "customer").select(k.alias("row_id"), F.concat(F.lit("(주) Brand#"), (k % 25 + 1).cast("string"), F.lit(" Small "), (k % 50 + 1).cast("string")).alias("asked_name"))
    return mk.resolve_names(asked, master).select("row_id", "instrument_id")


cte("ai", """SELECT instrument_id, related_id, reason, in_batch FROM (SELECT p_partkey AS instrument_id, x AS related_id, 'r' || x AS reason, (p_partkey + x) % 2 = 0 AS in_batch, a, max(a) OVER (PARTITION BY p_partkey) AS la
  FROM (SELECT p_partkey, a, unnest([(p_partkey + 5 * a) % 2000, (p_partkey + 1) % 2000]) AS x FROM part, (VALUES (1), (2)) t(a) WHERE a = 1 OR p_partkey % 3 = 0)) WHERE a = la""")
cte("rel", """SELECT instrument_id, related_id, array_to_string(list_sort(list_distinct(list(src))), '+') AS sources, max(reason) AS reason FROM (
  SELECT a.instrument_id, b.instrument_id AS related_id, 'NAME' AS src, NULL AS reason, 1 AS free FROM grp a JOIN grp b USING (pfx) WHERE a.n BETWEEN 2 AND 6 AND a.instrument_id <> b.instrument_id
  UNION ALL SELECT instrument_id, related_id, 'AI', reason, CASE WHEN in_batch THEN 0 ELSE 1 END FROM ai WHERE instrument_id <> related_id) GROUP BY 1, 2 HAVING max(free) = 1""", "grp", "ai")


def relations(spark, sf):
    key = F.col("p_partkey")
    asks = load(spark, sf, "part").select(key, F.explode(F.when(key % 3 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("ask_id"))
    pairs = asks.select(key.alias("instrument_id"), "ask_id", F.explode(F.array((key + 5 * F.col("ask_id")) % 2000, (key + 1) % 2000)).alias("related_id"))
    rows = pairs.withColumns({"reason": F.concat(F.lit("r"), F.col("related_id").cast("string")), "in_batch": (F.col("instrument_id") + F.col("related_id")) % 2 == 0})
    return mk.merge_relations(name_pairs(spark, sf), mk.newest_answers(rows))


@query("m11_merged_relations", "rel", "SELECT * FROM rel")
def m11(spark, sf):
    return relations(spark, sf).withColumn("sources", F.array_join("sources", "+"))


CHANGE = "(({0} * 7919) % 3000) / 100.0 - 15"


@query("m12_companions", "rel", f"""
WITH mv AS (SELECT p_partkey AS instrument_id, {CHANGE.format('p_partkey')} AS change_pct FROM part WHERE p_partkey % 6 <> 5)
SELECT instrument_id, related_id, round(companion_change, 6) AS companion_change, place FROM (SELECT l.instrument_id, r.related_id, c.change_pct AS companion_change, row_number() OVER (PARTITION BY l.instrument_id ORDER BY c.change_pct NULLS LAST, length(r.sources) - length(replace(r.sources, '+', '')) DESC, r.related_id) AS place
 FROM mv l JOIN rel r USING (instrument_id) LEFT JOIN mv c ON c.instrument_id = r.related_id WHERE l.change_pct >= 7) WHERE place <= 6""")
def m12(spark, sf):
    movers = load(spark, sf, "part").where("p_partkey % 6 <> 5").select(F.col("p_partkey").alias("instrument_id"), (F.col("p_partkey") * 7919 % 3000 / 100.0 - 15).alias("change_pct"))
    out = mk.companions(movers, relations(spark, sf))
    return out.select("instrument_id", "related_id", rounded("companion_change").alias("companion_change"), F.col("place").cast("long").alias("place"))


@query("m13_ask_targets", "", """
SELECT DISTINCT instrument_id FROM (SELECT p_partkey AS instrument_id FROM part WHERE p_size > 45 UNION ALL SELECT p_partkey FROM part WHERE p_brand = 'Brand#7') WHERE instrument_id NOT IN (SELECT unnest([l_partkey, l_partkey + 1]) FROM lineitem WHERE l_shipdate > TIMESTAMP '2001-09-01')""")
def m13(spark, sf):
    part = load(spark, sf, "part").withColumnRenamed("p_partkey", "instrument_id")
    asked = load(spark, sf, "lineitem").where("l_shipdate > TIMESTAMP '2001-09-01'").select(F.explode(F.array("l_partkey", F.col("l_partkey") + 1)).alias("instrument_id"))
    return mk.ask_targets(part.where("p_size > 45"), part.where("p_brand = 'Brand#7'"), asked)


@query("m13_minute_targets", "", """
WITH a AS (SELECT l_suppkey AS l, l_partkey AS m, -l_extendedprice AS c FROM lineitem WHERE l_shipdate > TIMESTAMP '2001-06-01'),
 e AS (SELECT l AS id, c, l, m, 0 AS k FROM a UNION ALL SELECT m, c, l, m, 1 FROM a), f AS (SELECT id, min(row(c, l, m, k)) AS spot FROM e GROUP BY 1)
SELECT id AS instrument_id, row_number() OVER (ORDER BY spot) AS place FROM f ORDER BY spot LIMIT 30""")
def m13b(spark, sf):
    alerts = load(spark, sf, "lineitem").where("l_shipdate > TIMESTAMP '2001-06-01'").select(F.col("l_suppkey").alias("leader_id"), F.col("l_partkey").alias("companion_id"), F.col("l_extendedprice").alias("leader_change"))
    return mk.minute_targets(alerts).select("instrument_id", F.col("place").cast("long").alias("place"))


@query("m14_rolling_usage", "", """
WITH b AS (SELECT event_type AS quota_group, date_trunc('minute', ts) AS m, CAST(sum(1 + user_id % 3) AS BIGINT) AS calls FROM events GROUP BY 1, 2)
SELECT quota_group, strftime(m, '%Y-%m-%d %H:%M:%S') AS minute_start, calls, CAST(spent AS BIGINT) AS spent, CAST(greatest(0, 250 - spent) AS BIGINT) AS headroom FROM (
  SELECT *, sum(calls) OVER (PARTITION BY quota_group ORDER BY m RANGE BETWEEN INTERVAL 1439 MINUTE PRECEDING AND CURRENT ROW) AS spent FROM b)""")
def m14(spark, sf):
    buckets = load(spark, sf, "events").select(F.col("event_type").alias("quota_group"), F.date_trunc("minute", "ts").alias("minute_start"), (F.col("user_id") % 3 + 1).alias("calls"))
    out = mk.rolling_usage(buckets, minutes=1440, cap=500)
    return out.select("quota_group", stamp_text("minute_start").alias("minute_start"), "calls", "spent", "headroom")


@query("m15_mover_alerts", "rel", """
WITH mv AS (SELECT CAST(ts AS DATE) AS day, minute(ts) AS minute, lpad(CAST(e.user_id AS VARCHAR), 5, '0') || CASE WHEN event_id % 5 = 0 THEN '5' ELSE '0' END AS code, user_id % 2 AS market, max(value / 10 - 15) AS change_pct, max(event_id % 3) AS volume FROM events e GROUP BY 1, 2, 3, 4),
 w AS (SELECT * FROM mv WHERE minute BETWEEN 1 AND 10 AND code LIKE '_____0'), t AS (SELECT w.* FROM w JOIN (SELECT day, minute FROM w GROUP BY 1, 2 HAVING max(volume) > 0) USING (day, minute)),
 r AS (SELECT * FROM (SELECT *, CAST(code[1:5] AS BIGINT) AS instrument_id, row_number() OVER (PARTITION BY day, minute, market ORDER BY change_pct DESC, code) AS market_rank FROM t))
SELECT CAST(day AS VARCHAR) AS day, minute, instrument_id, related_id, market_rank, place FROM (SELECT l.day, l.minute, l.instrument_id, x.related_id, l.market_rank, row_number() OVER (PARTITION BY l.day, l.minute, l.instrument_id ORDER BY c.change_pct NULLS LAST, length(x.sources) - length(replace(x.sources, '+', '')) DESC, x.related_id) AS place
  FROM r l JOIN rel x USING (instrument_id) LEFT JOIN r c ON c.day = l.day AND c.minute = l.minute AND c.instrument_id = x.related_id WHERE l.change_pct >= 7) WHERE place <= 6""")
def m15(spark, sf):
    user = F.col("user_id")
    code = F.concat(F.lpad(user.cast("string"), 5, "0"), F.when(F.col("event_id") % 5 == 0, "5").otherwise("0"))
    ranking = load(spark, sf, "events").groupBy(F.to_date("ts").alias("day"), F.minute("ts").alias("minute"), code.alias("code"), (user % 2).alias("market")).agg(
        F.max(F.col("value") / 10 - 15).alias("change_pct"), F.max(F.col("event_id") % 3).alias("volume"))
    symbols = load(spark, sf, "events").select(user.alias("instrument_id")).distinct().withColumn("code", F.concat(F.lpad(F.col("instrument_id").cast("string"), 5, "0"), F.lit("0")))
    out = mk.mover_alerts(ranking, symbols, relations(spark, sf))
    return out.select(day_text("day").alias("day"), F.col("minute").cast("long").alias("minute"), "instrument_id", "related_id", F.col("market_rank").cast("long").alias("market_rank"), F.col("place").cast("long").alias("place"))


# ---------------------------------------------------------------- list selection
R = ["CASE WHEN discovery_score IS NOT NULL THEN 'DISCOVERY_SURGE' END", "CASE WHEN overlay_points >= 1 THEN 'POSITIVE_NEWS_OVERLAY' END", "CASE WHEN overlay_points <= -1 THEN 'NEGATIVE_NEWS_OVERLAY' END",
     "CASE WHEN has_disclosure_event THEN 'DISCLOSURE_EVENT' END", "CASE WHEN search_surge >= 2 THEN 'SEARCH_SURGE' END"]
TR = ["CASE WHEN tracked AND last_action = 'BUY_INTEREST' THEN 'TRACKED_HIGH_SCORE' END", "CASE WHEN tracked THEN 'TRACKED' END"]
cte("why", f"""SELECT *, array_to_string(list_filter([{', '.join(R + TR)}], lambda x: x IS NOT NULL), '+') AS r1, len(list_filter([{', '.join(R + TR[:1])}], lambda x: x IS NOT NULL)) AS n1,
  array_to_string(list_filter([{', '.join(R)}], lambda x: x IS NOT NULL), '+') AS r2, len(list_filter([{', '.join(R)}], lambda x: x IS NOT NULL)) AS n2,
  array_to_string(list_filter([CASE WHEN judged_score < 40 THEN 'LOW_SCORE' END, CASE WHEN prev_change >= 15 THEN 'PREV_SURGE' END], lambda x: x IS NOT NULL), '+') AS ex FROM cand""", "cand")
ORDER = "abs(coalesce(overlay_points, 0)) DESC, coalesce(search_surge, 0) DESC, coalesce(discovery_score, 0) DESC"
cte("v1", f"SELECT *, row_number() OVER (PARTITION BY session_no ORDER BY n1 DESC, {ORDER}, instrument_id) AS rank FROM why WHERE r1 <> ''", "why")
cte("v2", f"SELECT *, row_number() OVER (PARTITION BY session_no ORDER BY n2 DESC, {ORDER}, coalesce(disclosure_intensity, 0) DESC, instrument_id) AS rank FROM why WHERE r2 <> ''", "why")


def joined(c):
    return F.array_join(c, "+")


@query("l1_reasons", "why", "SELECT instrument_id, r1, r2 FROM why")
def l1(spark, sf):
    return fx.candidates(spark, sf).select("instrument_id", joined(sel.reasons(1)).alias("r1"), joined(sel.reasons(2)).alias("r2"))


@query("l2_selection_v1", "v1", "SELECT session_no, instrument_id, rank, r1 AS reasons FROM v1 WHERE rank <= 40")
def l2(spark, sf):
    out = sel.select_names(fx.candidates(spark, sf), ["session_no"])
    return out.select("session_no", "instrument_id", F.col("rank").cast("long").alias("rank"), joined("reasons").alias("reasons"))


@query("l2_left_out", "v2", "SELECT session_no, greatest(0, count(*) - 40) AS left_out FROM v2 GROUP BY 1")
def l2b(spark, sf):
    return sel.left_out(fx.candidates(spark, sf), ["session_no"], version=2)


@query("l3_selection_v2", "v2", "SELECT session_no, instrument_id, rank, r2 AS reasons, ex AS excluded FROM v2 WHERE rank <= 40")
def l3(spark, sf):
    out = sel.select_names(fx.candidates(spark, sf), ["session_no"], version=2, exclude=True)
    return out.select("session_no", "instrument_id", F.col("rank").cast("long").alias("rank"), joined("reasons").alias("reasons"), joined("excluded").alias("excluded"))


def pool(spark, sf, asof=WIN[2]):
    at = F.lit(asof).cast("timestamp")
    rows = fx.readings(spark, sf)
    mentions = rows.where("event_type <> 'error'").select("instrument_id", F.col("seen_at").alias("available_at"))
    found = nw.discover(mentions, spans(spark, sf), at).where("status = 'RANKED'").select("instrument_id", "score")
    filed = nw.strongest_intensity(nw.classify_titles(titles(spark, sf)))
    focus = rows.where((F.col("event_type") == "purchase") & (F.col("seen_at") > F.date_sub(at, 1)) & (F.col("seen_at") <= at)).select("instrument_id")
    tracked = rows.select("instrument_id").distinct().where("instrument_id % 5 = 0")
    return sel.freeze_pool(found, filed, focus, tracked)


POOL = """
WITH d AS (SELECT instrument_id, score FROM (SELECT instrument_id, (recent + 1.0) / (expected + 1.0) AS score, row_number() OVER (ORDER BY (recent + 1.0) / (expected + 1.0) DESC, recent DESC, instrument_id) AS rk FROM disc WHERE status = 'RANKED') WHERE rk <= 20),
 f AS (SELECT instrument_id, max(intensity) AS intensity FROM titled WHERE event_type IS NOT NULL GROUP BY 1), o AS (SELECT DISTINCT instrument_id FROM evt WHERE event_type = 'purchase' AND seen_at > TIMESTAMP '{0}' - INTERVAL 1 DAY AND seen_at <= TIMESTAMP '{0}')
SELECT i AS instrument_id, array_to_string(list_filter([CASE WHEN d.score IS NOT NULL THEN 'DISCOVERY' END, CASE WHEN f.intensity IS NOT NULL THEN 'DISCLOSURE' END, CASE WHEN o.instrument_id IS NOT NULL THEN 'FOCUS' END], lambda x: x IS NOT NULL), '+') AS sources,
  i IN (SELECT instrument_id FROM evt WHERE instrument_id % 5 = 0) AS tracked, round(d.score, 6) AS discovery_score, f.intensity IS NOT NULL AS has_disclosure_event, round(f.intensity, 6) AS disclosure_intensity
FROM (SELECT instrument_id AS i FROM d UNION SELECT instrument_id FROM f UNION SELECT instrument_id FROM o) LEFT JOIN d ON d.instrument_id = i LEFT JOIN f ON f.instrument_id = i LEFT JOIN o ON o.instrument_id = i"""


@query("l4_frozen_pool", "disc, titled, evt", POOL.format(WIN[2]))
def l4(spark, sf):
    out = pool(spark, sf)
    return out.select("instrument_id", joined("sources").alias("sources"), "tracked", rounded("discovery_score").alias("discovery_score"), "has_disclosure_event", rounded("disclosure_intensity").alias("disclosure_intensity"))


@query("l5_work_list", "v2", "SELECT session_no, instrument_id, rank, turn FROM (SELECT *, row_number() OVER (PARTITION BY session_no ORDER BY rank) AS turn FROM v2 WHERE prev_change IS NULL OR judged_score < 50) WHERE turn <= 150")
def l5(spark, sf):
    ranked = sel.select_names(fx.candidates(spark, sf), ["session_no"], version=2, limit=None)
    out = sel.work_list(ranked, ["session_no"], F.col("prev_change").isNull() | (F.col("judged_score") < 50))
    return out.select("session_no", "instrument_id", F.col("rank").cast("long").alias("rank"), F.col("turn").cast("long").alias("turn"))


@query("l6_peer_hash", "cand", f"SELECT session_no, n AS peer_count, digest AS peer_hash FROM ({digest_sql('(SELECT DISTINCT session_no, instrument_id FROM cand WHERE tracked)', 'session_no', 'instrument_id', 'instrument_id')})")
def l6(spark, sf):
    return sel.peer_hash(fx.candidates(spark, sf).where("tracked"), ["session_no"])


@query("l7_snapshot", "v1, v2", """
SELECT 1 AS selection_version, session_no, instrument_id, rank, r1 AS reasons, '' AS excluded FROM v1 WHERE rank <= 40 AND session_no > 2 UNION ALL SELECT 2, session_no, instrument_id, rank, r2, ex FROM v2 WHERE rank <= 40 AND session_no > 2""")
def l7(spark, sf):
    rows = fx.candidates(spark, sf)
    out = sel.snapshot(rows, rows.where("session_no <= 2").select("session_no").distinct())
    return out.select(F.col("selection_version").cast("long").alias("selection_version"), "session_no", "instrument_id", F.col("rank").cast("long").alias("rank"), joined("reasons").alias("reasons"), joined("excluded").alias("excluded"))


@query("l7_input_audit", "cand", """
SELECT session_no, count(*) AS pool, count(overlay_points) AS with_overlay_points, count(search_surge) AS with_search_surge, count(discovery_score) AS with_discovery_score, count(judged_score) AS with_judged_score, count(prev_change) AS with_prev_change FROM cand GROUP BY 1""")
def l7b(spark, sf):
    return sel.input_audit(fx.candidates(spark, sf), ["session_no"])


@query("l8_rerun_morning")
def l8(spark, sf):
    """The pool and its selection as of an earlier instant."""
    rows = pool(spark, sf, "2024-01-22 00:00:00").withColumns({
        "session_no": F.lit(0), "overlay_points": F.lit(None).cast("double"), "search_surge": F.lit(None).cast("double"), "judged_score": F.lit(None).cast("double"), "prev_change": F.lit(None).cast("double"), "last_action": F.lit("WATCH")})
    return sel.select_names(rows, ["session_no"], version=2).select("instrument_id", "rank", joined("reasons").alias("reasons"))


@query("l9_recent_members", "evt", "SELECT DISTINCT instrument_id FROM evt WHERE CAST(seen_at AS DATE) IN (SELECT DISTINCT CAST(seen_at AS DATE) FROM evt ORDER BY 1 DESC LIMIT 3)")
def l9(spark, sf):
    rows = fx.readings(spark, sf).select("instrument_id", F.to_date("seen_at").alias("day"))
    last = rows.select("day").distinct().orderBy(F.col("day").desc()).limit(3)
    return rows.join(last, "day", "left_semi").select("instrument_id").distinct()


@query("l10_promotions", "fact", """
WITH b AS (SELECT l_suppkey AS instrument_id, count(*) AS n FROM lineitem GROUP BY 1), f AS (SELECT instrument_id, count(*) AS n FROM fact GROUP BY 1)
SELECT c_custkey AS instrument_id, coalesce(b.n, 0) AS candle_bars, coalesce(f.n, 0) AS fundamental_facts, coalesce(b.n, 0) > 0 AS promoted, CASE WHEN coalesce(b.n, 0) = 0 THEN 'no daily bars' WHEN coalesce(f.n, 0) = 0 THEN 'promoted without financial facts' ELSE 'promoted' END AS reason
FROM customer LEFT JOIN b ON b.instrument_id = c_custkey LEFT JOIN f ON f.instrument_id = c_custkey""")
def l10(spark, sf):
    cands = load(spark, sf, "customer").select(F.col("c_custkey").alias("instrument_id"))
    return sel.promote(cands, load(spark, sf, "lineitem").select(F.col("l_suppkey").alias("instrument_id")), fx.facts(spark, sf))


@query("l11_list_view", "v2, cand", """
SELECT session_no, instrument_id, rank, 'LIST' AS origin FROM v2 WHERE rank <= 40 AND ex = '' AND session_no < 8 UNION ALL SELECT session_no, instrument_id, NULL, 'TRACKED' FROM cand WHERE tracked AND session_no >= 8""")
def l11(spark, sf):
    rows = fx.candidates(spark, sf)
    members = sel.snapshot(rows, rows.where("session_no >= 8").select("session_no").distinct())
    out = sel.list_view(members, rows.where("tracked").select("session_no", "instrument_id"))
    return out.select("session_no", "instrument_id", F.col("rank").cast("long").alias("rank"), "origin")


@query("l11_signal_rows", "", f"""
SELECT v.session_no, v.instrument_id, v.rank, v.origin, w.weight_pct AS market_weight_pct, coalesce(w.heavyweight, false) AS heavyweight, l.state AS prev_limit, l.change_pct AS prev_change_pct, a.reports, a.brokers, a.buy, a.upside_pct
FROM ({ORACLES["l11_list_view"]}) v LEFT JOIN ({ORACLES["m6_heavyweights"]}) w USING (instrument_id)
LEFT JOIN (SELECT instrument_id, arg_max(state, for_day) AS state, arg_max(change_pct, for_day) AS change_pct FROM (SELECT * REPLACE (coalesce(state, '-') AS state) FROM ({ORACLES["m5_previous_limits"]})) GROUP BY 1) l USING (instrument_id)
LEFT JOIN ({ORACLES["n18_analyst_summary"]}) a USING (instrument_id)""")
def l11b(spark, sf):
    """The list with market weight, the newest previous-session limit state and the analysts' summary of every shown name."""
    newest = m5(spark, sf).withColumn("state", F.coalesce("state", F.lit("-"))).groupBy("instrument_id").agg(
        F.max_by("state", "for_day").alias("state"), F.max_by("change_pct", "for_day").alias("change_pct"))
    out = sel.signal_rows(l11(spark, sf), m6b(spark, sf), newest, n18(spark, sf))
    return out.select("session_no", "instrument_id", "rank", "origin", "market_weight_pct", "heavyweight", "prev_limit", "prev_change_pct", "analyst.reports", "analyst.brokers", "analyst.buy", "analyst.upside_pct")
