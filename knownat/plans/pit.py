"""Queries P1-P38."""

from __future__ import annotations

from pyspark.sql import functions as F

from knownat.functions.numeric import day_text, key_day, rounded, stamp_text
from knownat.functions.scale import newest
from knownat.operators import pit
from knownat.plans import fixtures as fx
from knownat.plans.registry import cte, query
from knownat.sources.tables import load

ASOF, HELD = "1997-06-30 00:00:00", "1997-09-30 00:00:00"
TIES = ("line", "part", "supp", "close")
FMT = "'%Y-%m-%d %H:%M:%S'"

cte("rev_now", f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY instrument_id, bar_key
   ORDER BY ingested_at DESC, line DESC, part DESC, supp DESC, close DESC) AS rn FROM rev
   WHERE isfinite(close) AND ingested_at <= TIMESTAMP '{HELD}') WHERE rn = 1""", "rev")


@query("p1_history_limit", "rev_now", f"""
SELECT instrument_id, bar_key, strftime(available_at, {FMT}) AS available_at, close, volume FROM (
  SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY bar_key DESC) AS k FROM rev_now
  WHERE available_at <= TIMESTAMP '{ASOF}') WHERE k <= 5""")
def p1(spark, sf):
    bars = pit.current_bars(fx.revisions(spark, sf), ties=TIES, held_by=HELD, known_by=ASOF)
    return pit.last_bars(bars, 5).select("instrument_id", "bar_key", stamp_text("available_at").alias("available_at"), "close", "volume")


@query("p2_history_many", "rev_now", f"""
SELECT instrument_id, bar_key, close, volume FROM rev_now WHERE available_at <= TIMESTAMP '{ASOF}' AND bar_key >= 100""")
def p2(spark, sf):
    bars = pit.current_bars(fx.revisions(spark, sf), ties=TIES, held_by=HELD, known_by=ASOF, since=F.col("bar_key") >= 100)
    return bars.select("instrument_id", "bar_key", "close", "volume")


@query("p3_bars_both_clocks", "rev_now", f"""
SELECT instrument_id, count(*) AS bars, max(bar_key) AS last_bar, round(sum(close), 4) AS total FROM rev_now
WHERE available_at <= TIMESTAMP '{ASOF}' AND available_at >= TIMESTAMP '1995-01-01' GROUP BY 1""")
def p3(spark, sf):
    bars = pit.current_bars(fx.revisions(spark, sf), ties=TIES, held_by=HELD, known_by=ASOF)
    bars = bars.where(F.col("available_at") >= F.lit("1995-01-01").cast("timestamp"))
    return bars.groupBy("instrument_id").agg(F.count(F.lit(1)).alias("bars"), F.max("bar_key").alias("last_bar"),
                                             rounded(F.sum("close"), 4).alias("total"))


@query("p4_opening_price", "rev", f"""
SELECT instrument_id, bar_key, round(arg_max(open, row(ingested_at, line, part, supp, close)), 6) AS open FROM rev
WHERE ingested_at <= TIMESTAMP '{HELD}' AND bar_key IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1, 2""")
def p4(spark, sf):
    wanted = load(spark, sf, "orders").where("o_orderstatus = 'F'").select(
        F.col("o_custkey").alias("instrument_id"), F.col("o_orderkey").alias("bar_key"))
    out = pit.opening_prices(fx.revisions(spark, sf), wanted, ties=TIES, held_by=HELD)
    return out.select("instrument_id", "bar_key", rounded("open").alias("open"))


@query("p5_window_confinement", "rev_now", f"""
SELECT instrument_id, bar_key, close FROM (
  SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY bar_key DESC) AS k FROM rev_now
  WHERE available_at <= TIMESTAMP '{ASOF}' AND available_at >= TIMESTAMP '1996-01-01') WHERE k <= 3""")
def p5(spark, sf):
    from datetime import datetime
    view = pit.PitView(fx.revisions(spark, sf), datetime(1997, 6, 30), datetime(1997, 9, 30), ties=TIES)
    view = view.windowed(not_before=datetime(1994, 1, 1), not_after=datetime(1997, 12, 31)).windowed(not_before=datetime(1996, 1, 1))
    return view.read(3).select("instrument_id", "bar_key", "close")


@query("p6_revision_inventory", "rev", f"""
SELECT instrument_id, count(DISTINCT bar_key) AS bars, count(*) AS revisions, max(bar_key) AS latest_bar,
  strftime(min(available_at), {FMT}) AS covered_from, strftime(max(available_at), {FMT}) AS covered_to FROM rev GROUP BY 1""")
def p6(spark, sf):
    out = pit.bar_inventory(fx.revisions(spark, sf))
    return out.select("instrument_id", "bars", "revisions", "latest_bar", stamp_text("covered_from").alias("covered_from"),
                      stamp_text("covered_to").alias("covered_to"))


# ---------------------------------------------------------------- facts
CTX = "instrument_id, concept, unit, period_start, period_end"
cte("fact_now", f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {CTX} ORDER BY filed_at DESC, id DESC) AS rn
  FROM fact WHERE available_at <= TIMESTAMP '{ASOF}' AND ingested_at <= TIMESTAMP '{HELD}') WHERE rn = 1""", "fact")
FACT_OUT = "instrument_id, concept, CAST(period_start AS VARCHAR) AS period_start, CAST(period_end AS VARCHAR) AS period_end, round(value, 6) AS value, CAST(filed_at AS VARCHAR) AS filed_at, id"


def fact_out(df):
    return df.select("instrument_id", "concept", day_text("period_start").alias("period_start"), day_text("period_end").alias("period_end"),
                     rounded("value").alias("value"), day_text("filed_at").alias("filed_at"), "id")


@query("p7_value_as_of", "fact_now", f"SELECT {FACT_OUT} FROM fact_now")
def p7(spark, sf):
    return fact_out(pit.value_as_of(fx.facts(spark, sf), asof=ASOF, held_by=HELD))


@query("p7_first_filed_value", "fact", f"""
SELECT {FACT_OUT} FROM (SELECT *, row_number() OVER (PARTITION BY {CTX} ORDER BY filed_at, id DESC) AS rn
  FROM fact WHERE available_at <= TIMESTAMP '{ASOF}') WHERE rn = 1""")
def p7b(spark, sf):
    return fact_out(pit.value_as_of(fx.facts(spark, sf), asof=ASOF, first_filed=True))


@query("p8_latest_period", "fact_now", f"""
SELECT {FACT_OUT} FROM (SELECT *, row_number() OVER (PARTITION BY instrument_id, concept, unit ORDER BY period_end DESC) AS k
  FROM fact_now WHERE period_start IS NULL OR period_end - period_start BETWEEN 336 AND 382) WHERE k = 1""")
def p8(spark, sf):
    return fact_out(pit.latest_value_as_of(fx.facts(spark, sf), asof=ASOF, held_by=HELD))


@query("p9_previous_annual", "fact_now", """
SELECT instrument_id, concept, CAST(period_end AS VARCHAR) AS period_end, round(value, 6) AS value,
  CASE WHEN period_end - pe <= 430 THEN CAST(pe AS VARCHAR) END AS prior_end, CASE WHEN period_end - pe <= 430 THEN round(pv, 6) END AS prior_value
FROM (SELECT *, row_number() OVER w AS k, lead(period_end) OVER w AS pe, lead(value) OVER w AS pv FROM fact_now
  WHERE period_start IS NOT NULL AND period_end - period_start BETWEEN 336 AND 382
  WINDOW w AS (PARTITION BY instrument_id, concept, unit ORDER BY period_end DESC)) WHERE k = 1""")
def p9(spark, sf):
    out = pit.previous_annual(fx.facts(spark, sf), asof=ASOF, held_by=HELD)
    return out.select("instrument_id", "concept", day_text("period_end").alias("period_end"), rounded("value").alias("value"),
                      day_text("prior_end").alias("prior_end"), rounded("prior_value").alias("prior_value"))


@query("p10_annual_gaps", "fact", """
SELECT instrument_id, concept, CAST(period_end AS VARCHAR) AS period_end, CAST(n AS VARCHAR) AS next_end, coalesce(n - period_end > 430, false) AS is_gap
FROM (SELECT *, lead(period_end) OVER (PARTITION BY instrument_id, concept ORDER BY period_end) AS n FROM (
  SELECT DISTINCT instrument_id, concept, period_end FROM fact WHERE period_start IS NOT NULL AND period_end - period_start BETWEEN 336 AND 382))""")
def p10(spark, sf):
    out = pit.annual_gaps(fx.facts(spark, sf), keys=("instrument_id", "concept"))
    return out.select("instrument_id", "concept", day_text("period_end").alias("period_end"), day_text("next_end").alias("next_end"), "is_gap")


@query("p11_coverage_start", "fact", f"""
SELECT instrument_id, CAST(min(filed_at) AS VARCHAR) AS coverage_start FROM fact
WHERE ingested_at <= TIMESTAMP '{HELD}' AND concept IN ('NetIncomeLoss', 'Revenues') GROUP BY 1""")
def p11(spark, sf):
    out = pit.coverage_start(fx.facts(spark, sf).where(F.col("concept").isin("NetIncomeLoss", "Revenues")), held_by=HELD)
    return out.select("instrument_id", day_text("coverage_start").alias("coverage_start"))


@query("p12_oldest_version", "fact", f"""
SELECT instrument_id, CAST(min(v) AS BIGINT) AS oldest_version FROM (SELECT {CTX}, filed_at, max(semantic_version) AS v FROM fact
  WHERE ingested_at <= TIMESTAMP '{HELD}' GROUP BY {CTX}, filed_at) GROUP BY 1""")
def p12(spark, sf):
    out = pit.oldest_reading_version(fx.facts(spark, sf), held_by=HELD)
    return out.select("instrument_id", F.col("oldest_version").cast("long").alias("oldest_version"))


cte("covering", f"""SELECT instrument_id, period_of_report AS period_end, arg_min(form, row(filed_at, id)) AS covering_form,
  min(filed_at) AS covering_filed_at FROM (SELECT *, trim(split_part(regexp_replace(regexp_replace(form, '^\\s*\\[[^\\]]*\\]\\s*', ''), '\\s*\\([^)]*\\)\\s*$', ''), '/', 1)) AS family
    FROM filing WHERE available_at <= TIMESTAMP '{ASOF}')
  WHERE (source = 'SEC' AND family IN ('10-K', '10-Q', '20-F', '40-F')) OR (source = 'DART' AND family IN ('사업보고서', '반기보고서', '분기보고서'))
  GROUP BY 1, 2""", "filing")


@query("p13_absence_reason", "fact, fact_now, filing, covering", f"""
SELECT c.instrument_id, c.concept, CAST(c.period_end AS VARCHAR) AS period_end, round(f.value, 6) AS value,
  CASE WHEN f.value IS NOT NULL THEN 'FOUND' WHEN b.s IS NULL OR DATE '{ASOF[:10]}' < b.s THEN 'SOURCE_COVERAGE_UNAVAILABLE'
       WHEN r.s IS NULL OR DATE '{ASOF[:10]}' < r.s THEN 'NO_OBSERVATION_IN_SOURCE' WHEN v.covering_form IS NOT NULL THEN 'NO_OBSERVATION_IN_SOURCE'
       ELSE 'NOT_YET_FILED' END AS outcome, v.covering_form, CAST(v.covering_filed_at AS VARCHAR) AS covering_filed_at
FROM (SELECT DISTINCT {CTX} FROM fact) c
LEFT JOIN fact_now f ON c.instrument_id = f.instrument_id AND c.concept = f.concept AND c.unit = f.unit AND c.period_end = f.period_end AND c.period_start IS NOT DISTINCT FROM f.period_start
LEFT JOIN (SELECT instrument_id, min(filed_at) AS s FROM fact WHERE ingested_at <= TIMESTAMP '{HELD}' GROUP BY 1) b ON b.instrument_id = c.instrument_id
LEFT JOIN (SELECT instrument_id, min(filed_at) AS s FROM filing GROUP BY 1) r ON r.instrument_id = c.instrument_id
LEFT JOIN covering v ON v.instrument_id = c.instrument_id AND v.period_end = c.period_end""")
def p13(spark, sf):
    facts = fx.facts(spark, sf)
    requests = facts.select(*pit.CONTEXT).distinct()
    registers = fx.filings(spark, sf).withColumn("ingested_at", F.lit("1900-01-01").cast("timestamp"))
    out = pit.lookup(requests, facts, registers, asof=ASOF, held_by=HELD)
    return out.select("instrument_id", "concept", day_text("period_end").alias("period_end"), rounded("value").alias("value"), "outcome",
                      "covering_form", day_text("covering_filed_at").alias("covering_filed_at"))


@query("p14_covering_report", "covering", """
SELECT instrument_id, CAST(period_end AS VARCHAR) AS period_end, covering_form, CAST(covering_filed_at AS VARCHAR) AS covering_filed_at FROM covering""")
def p14(spark, sf):
    out = pit.covering_reports(fx.filings(spark, sf), asof=ASOF)
    return out.select("instrument_id", day_text("period_end").alias("period_end"), "covering_form", day_text("covering_filed_at").alias("covering_filed_at"))


@query("p15_register_start", "filing", "SELECT instrument_id, CAST(min(filed_at) AS VARCHAR) AS register_start FROM filing GROUP BY 1")
def p15(spark, sf):
    return pit.register_start(fx.filings(spark, sf)).select("instrument_id", day_text("register_start").alias("register_start"))


@query("p16_change_instants", "fact", f"""
SELECT DISTINCT source, strftime(available_at, {FMT}) AS available_at FROM fact WHERE ingested_at <= TIMESTAMP '{HELD}'""")
def p16(spark, sf):
    return pit.visible(fx.facts(spark, sf), held_by=HELD).select("source", stamp_text("available_at").alias("available_at")).distinct()


@query("p16_fact_inventory", "fact", """
SELECT instrument_id, concept, count(*) AS facts, CAST(max(filed_at) AS VARCHAR) AS latest_filing FROM fact GROUP BY 1, 2""")
def p16b(spark, sf):
    return fx.facts(spark, sf).groupBy("instrument_id", "concept").agg(
        F.count(F.lit(1)).alias("facts"), day_text(F.max("filed_at")).alias("latest_filing"))


SNAP_COLS = ", ".join(
    f"round(max(CASE WHEN f.period_end = a.anchor_end AND f.concept = '{c}' THEN f.value END), 6) AS \"{c}\"" for c in fx.CONCEPTS)
PRIOR = ", ".join(
    f"round(arg_max(CASE WHEN f.period_start IS NOT NULL AND a.anchor_end - f.period_end BETWEEN 1 AND 430 AND f.concept = '{c}' THEN f.value END, "
    f"CASE WHEN f.period_start IS NOT NULL AND a.anchor_end - f.period_end BETWEEN 1 AND 430 AND f.concept = '{c}' THEN f.period_end END), 6) AS \"prior_{c}\""
    for c in fx.CONCEPTS[:2])
cte("snap", f"""SELECT f.instrument_id, a.anchor_end, {SNAP_COLS}, {PRIOR} FROM fact_now f JOIN (
  SELECT instrument_id, arg_max(period_end, row(-p, period_end)) AS anchor_end FROM (SELECT *, list_position(
    ['NetIncomeLoss', 'RevenueFromContractWithCustomerExcludingAssessedTax', 'Revenues', 'EarningsPerShareBasic'], concept) AS p FROM fact_now)
  WHERE p > 0 AND period_start IS NOT NULL GROUP BY 1) a USING (instrument_id) GROUP BY 1, 2""", "fact_now")


def snapshots(spark, sf):
    return pit.snapshot(fx.facts(spark, sf), asof=ASOF, held_by=HELD)


@query("p17_anchored_snapshot", "snap", "SELECT * REPLACE (CAST(anchor_end AS VARCHAR) AS anchor_end) FROM snap")
def p17(spark, sf):
    out = snapshots(spark, sf)
    return out.select("instrument_id", day_text("anchor_end").alias("anchor_end"),
                      *[rounded(c).alias(c) for c in out.columns if c not in ("instrument_id", "anchor_end")])


# ---------------------------------------------------------------- instruments
@query("p18_resolve_symbol", "sym", """
SELECT o_orderkey, s.holder FROM orders JOIN sym s ON s.symbol = o_custkey % 200 AND s.valid_from <= CAST(o_orderdate AS DATE)
  AND (s.valid_to IS NULL OR s.valid_to >= CAST(o_orderdate AS DATE))""")
def p18(spark, sf):
    asked = load(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 200).alias("symbol"), F.to_date("o_orderdate").alias("day"))
    return pit.resolve_symbols(asked, pit.symbol_windows(fx.holders(spark, sf))).select("o_orderkey", "holder")


@query("p19_active_universe", "", """
SELECT o_custkey AS instrument_id, CAST(min(o_orderdate) AS DATE)::VARCHAR AS listed_at FROM orders GROUP BY 1
HAVING min(o_orderdate) <= TIMESTAMP '1996-01-01' AND (max(o_orderdate) > TIMESTAMP '1996-01-01' OR o_custkey % 3 = 0)""")
def p19(spark, sf):
    master = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("instrument_id")).agg(
        F.to_date(F.min("o_orderdate")).alias("listed_at"), F.to_date(F.max("o_orderdate")).alias("last"))
    master = master.withColumn("delisted_at", F.when(F.col("instrument_id") % 3 != 0, F.col("last")))
    return pit.active_on(master, "1996-01-01").select("instrument_id", day_text("listed_at").alias("listed_at"))


@query("p20_symbol_windows", "sym", "SELECT symbol, holder, CAST(valid_from AS VARCHAR) AS valid_from, CAST(valid_to AS VARCHAR) AS valid_to FROM sym")
def p20(spark, sf):
    out = pit.symbol_windows(fx.holders(spark, sf))
    return out.select("symbol", "holder", day_text("valid_from").alias("valid_from"), day_text("valid_to").alias("valid_to"))


cte("starts", """SELECT c.symbol, c.holder, greatest(max(c.earliest), max(c.observed_on), max(greatest(s.valid_from + 1, coalesce(s.valid_to + 1, s.valid_from + 1)))) AS start
  FROM (SELECT CAST(o_custkey % 200 AS BIGINT) AS symbol, max(o_custkey) + 1000000 AS holder, CAST(min(o_orderdate) AS DATE) AS earliest,
        CAST(max(o_orderdate) AS DATE) AS observed_on FROM orders GROUP BY 1) c JOIN sym s ON s.symbol = c.symbol AND s.holder <> c.holder GROUP BY 1, 2""", "sym")


@query("p20_symbol_claims", "sym, starts", """
SELECT s.symbol, s.holder, CAST(s.valid_from AS VARCHAR) AS valid_from,
  CAST(CASE WHEN s.valid_to IS NULL AND n.start IS NOT NULL AND s.holder <> n.holder THEN n.start - 1 ELSE s.valid_to END AS VARCHAR) AS valid_to
FROM sym s LEFT JOIN starts n USING (symbol)
UNION ALL SELECT symbol, holder, CAST(start AS VARCHAR), NULL FROM starts""")
def p20b(spark, sf):
    windows = pit.symbol_windows(fx.holders(spark, sf))
    claims = load(spark, sf, "orders").groupBy((F.col("o_custkey") % 200).alias("symbol")).agg(
        (F.max("o_custkey") + 1000000).alias("holder"), F.to_date(F.min("o_orderdate")).alias("earliest"),
        F.to_date(F.max("o_orderdate")).alias("observed_on"))
    out = pit.append_symbol(windows, claims)
    return out.select("symbol", "holder", day_text("valid_from").alias("valid_from"), day_text("valid_to").alias("valid_to"))


@query("p21_match_entities", "", """
WITH inc AS (SELECT c_custkey AS row_id, 'M' || c_nationkey % 2 AS market, c_name AS name, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 97 END AS anchor FROM customer),
 mas AS (SELECT s_suppkey AS instrument_id, 'M' || s_nationkey % 2 AS m_market, replace(s_name, 'Supplier', 'Customer') AS m_name,
   CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey END AS m_anchor FROM supplier),
 allm AS (SELECT row_id, instrument_id, 1 AS p FROM inc JOIN mas ON anchor = m_anchor
   UNION ALL SELECT row_id, instrument_id, 2 FROM inc JOIN mas ON market = m_market AND name = m_name WHERE anchor IS NOT NULL AND m_anchor IS NULL
   UNION ALL SELECT row_id, instrument_id, 3 FROM inc JOIN mas ON market = m_market AND name = m_name WHERE anchor IS NULL)
SELECT i.row_id, b.instrument_id, CASE b.p WHEN 1 THEN 'ANCHOR' WHEN 2 THEN 'NAME_ADOPTED' WHEN 3 THEN 'NAME' END AS matched_by
FROM inc i LEFT JOIN (SELECT row_id, arg_min(instrument_id, row(p, instrument_id)) AS instrument_id, min(p) AS p FROM allm GROUP BY 1) b USING (row_id)""")
def p21(spark, sf):
    inc = load(spark, sf, "customer").select(
        F.col("c_custkey").alias("row_id"), F.concat(F.lit("M"), (F.col("c_nationkey") % 2).cast("string")).alias("market"),
        F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey") % 97).alias("anchor"))
    mas = load(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("instrument_id"), F.concat(F.lit("M"), (F.col("s_nationkey") % 2).cast("string")).alias("m_market"),
        F.replace("s_name", F.lit("Supplier"), F.lit("Customer")).alias("m_name"), F.when(F.col("s_suppkey") % 4 != 0, F.col("s_suppkey")).alias("m_anchor"))
    return pit.match_entities(inc, mas)


@query("p22_tracked_as_it_stood", "", """
SELECT c_custkey AS instrument_id FROM customer WHERE c_custkey NOT IN (
  SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderdate > TIMESTAMP '1998-01-01')""")
def p22(spark, sf):
    promotions = load(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(
        F.col("o_custkey").alias("instrument_id"), F.col("o_orderdate").alias("promoted_at"))
    tracked = load(spark, sf, "customer").select(F.col("c_custkey").alias("instrument_id"))
    return pit.promoted_by(tracked, promotions, "1998-01-01 00:00:00")


# ---------------------------------------------------------------- verdicts
HIT_ASOF = "2024-01-05 12:00:00"
cte("hit_now", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hit_id ORDER BY decided_at DESC, id DESC) AS rn FROM hit) WHERE rn = 1""", "hit")
cte("hit_then", f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hit_id ORDER BY decided_at DESC, id DESC) AS rn
  FROM hit WHERE decided_at <= TIMESTAMP '{HIT_ASOF}') WHERE rn = 1""", "hit")


@query("p23_latest_verdict", "hit_then", f"SELECT hit_id, decision, decided_by, CAST(rule_version AS BIGINT) AS rule_version, strftime(decided_at, {FMT}) AS decided_at FROM hit_then")
def p23(spark, sf):
    out = pit.latest_verdicts(fx.verdicts(spark, sf), asof=HIT_ASOF)
    return out.select("hit_id", "decision", "decided_by", F.col("rule_version").cast("long").alias("rule_version"), stamp_text("decided_at").alias("decided_at"))


@query("p24_append_verdict", "hit", """
SELECT i.hit_id, i.decision, i.decided_by FROM (SELECT * FROM hit WHERE rule_version = 3) i LEFT JOIN
 (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hit_id ORDER BY decided_at DESC, id DESC) AS rn FROM hit WHERE rule_version = 1 OR decided_by = 'MODEL') WHERE rn = 1) p USING (hit_id)
WHERE p.hit_id IS NULL OR NOT ((p.decision = i.decision AND p.decided_by = i.decided_by) OR (p.decided_by = 'MODEL' AND i.decided_by = 'RULE'))""")
def p24(spark, sf):
    rows = fx.verdicts(spark, sf)
    out = pit.append_verdicts(rows.where("rule_version = 1 OR decided_by = 'MODEL'"), rows.where("rule_version = 3"), ["decision", "decided_by"])
    return out.select("hit_id", "decision", "decided_by")


@query("p25_mention_sync", "hit_now", """
SELECT news_item_id, instrument_id, 'ADD' AS change FROM hit_now h WHERE decision = 'CONFIRMED' AND NOT EXISTS (
  SELECT 1 FROM hit m WHERE m.rule_version = 1 AND m.decision <> 'REJECTED' AND m.news_item_id = h.news_item_id AND m.instrument_id = h.instrument_id)
UNION ALL SELECT m.news_item_id, m.instrument_id, 'REMOVE' FROM hit m WHERE m.rule_version = 1 AND m.decision <> 'REJECTED' AND NOT EXISTS (
  SELECT 1 FROM hit_now h WHERE h.decision = 'CONFIRMED' AND m.news_item_id = h.news_item_id AND m.instrument_id = h.instrument_id)""")
def p25(spark, sf):
    rows = fx.verdicts(spark, sf)
    mentions = rows.where("rule_version = 1 AND decision <> 'REJECTED'").select("news_item_id", "instrument_id")
    return pit.sync_mentions(rows, mentions)


cte("news", "SELECT doc_id AS news_item_id, TIMESTAMP '2024-01-01' + to_minutes(doc_id * 7) AS available_at, TIMESTAMP '2024-01-01' + to_minutes(doc_id * 8) AS ingested_at, n_chars FROM documents")


def news(spark, sf):
    start = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    return load(spark, sf, "documents").select(
        F.col("doc_id").alias("news_item_id"), F.timestamp_add("MINUTE", F.col("doc_id") * 7, start).alias("available_at"),
        F.timestamp_add("MINUTE", F.col("doc_id") * 8, start).alias("ingested_at"), "n_chars")


@query("p26_work_queues", "hit_now, hit, news", f"""
SELECT 'older_rule' AS queue, hit_id, strftime(available_at, {FMT}) AS available_at FROM
  (SELECT h.hit_id, n.available_at FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hit_id ORDER BY decided_at DESC, id DESC) AS rn FROM hit WHERE rule_version < 3) WHERE rn = 1) h
   JOIN news n USING (news_item_id) WHERE decided_by = 'RULE' AND rule_version < 3)
UNION ALL (SELECT 'pending', hit_id, strftime(available_at, {FMT}) FROM hit_now JOIN news USING (news_item_id)
  WHERE (decided_by = 'RULE' AND decision = 'PENDING') ORDER BY available_at DESC, hit_id LIMIT 50)
UNION ALL (SELECT 'unread', hit_id, strftime(available_at, {FMT}) FROM hit_now JOIN news USING (news_item_id)
  WHERE decision = 'CONFIRMED' AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = news_item_id AND l.toxic = 1) ORDER BY available_at DESC, hit_id LIMIT 50)""")
def p26(spark, sf):
    rows, items = fx.verdicts(spark, sf), news(spark, sf)
    now = pit.latest_verdicts(rows).join(items, "news_item_id")
    older = pit.latest_verdicts(rows.where("rule_version < 3")).where("decided_by = 'RULE' AND rule_version < 3").join(items, "news_item_id")
    pending = pit.top_open(now.where("decided_by = 'RULE' AND decision = 'PENDING'"), 50)
    read = load(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("news_item_id"))
    unread = pit.top_open(now.where("decision = 'CONFIRMED'").join(read, "news_item_id", "left_anti"), 50)

    def out(df, name):
        return df.select(F.lit(name).alias("queue"), "hit_id", stamp_text("available_at").alias("available_at"))
    return out(older, "older_rule").unionByName(out(pending, "pending")).unionByName(out(unread, "unread"))


@query("p27_audit_sample")
def p27(spark, sf):
    """Reproducible sample: order by a seeded hash instead of a random number."""
    now = pit.latest_verdicts(fx.verdicts(spark, sf)).where("decision = 'CONFIRMED' AND decided_by = 'RULE'")
    audited = load(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("hit_id"))
    return now.join(audited, "hit_id", "left_anti").select("hit_id", "instrument_id", F.xxhash64(F.lit(42), "hit_id").alias("h")) \
        .orderBy("h", "hit_id").limit(30).select("hit_id", "instrument_id")


@query("p28_confirmed_times", "hit_then, news", f"""
SELECT DISTINCT instrument_id, news_item_id, strftime(available_at, {FMT}) AS available_at FROM hit_then JOIN news USING (news_item_id)
WHERE decision = 'CONFIRMED' AND available_at > TIMESTAMP '2024-01-01 06:00:00' AND available_at <= TIMESTAMP '{HIT_ASOF}' AND ingested_at <= TIMESTAMP '{HIT_ASOF}'""")
def p28(spark, sf):
    now = pit.latest_verdicts(fx.verdicts(spark, sf), asof=HIT_ASOF).where("decision = 'CONFIRMED'").join(news(spark, sf), "news_item_id")
    asof, start = F.lit(HIT_ASOF).cast("timestamp"), F.lit("2024-01-01 06:00:00").cast("timestamp")
    return now.where((F.col("available_at") > start) & (F.col("available_at") <= asof) & (F.col("ingested_at") <= asof)).select(
        "instrument_id", "news_item_id", stamp_text("available_at").alias("available_at")).distinct()


@query("p28_verdict_counts", "hit_now, news", f"""
SELECT decision, count(*) AS n, strftime(max(available_at), {FMT}) AS newest, strftime(min(available_at), {FMT}) AS oldest FROM hit_now JOIN news USING (news_item_id) GROUP BY 1""")
def p28b(spark, sf):
    return pit.latest_verdicts(fx.verdicts(spark, sf)).join(news(spark, sf), "news_item_id").groupBy("decision").agg(
        F.count(F.lit(1)).alias("n"), stamp_text(F.max("available_at")).alias("newest"), stamp_text(F.min("available_at")).alias("oldest"))


cte("sweep", "SELECT event_id, instrument_id, seen_at AS covered_from, seen_at + INTERVAL 3 HOUR AS covered_to, seen_at + INTERVAL 3 HOUR AS recorded_at FROM evt", "evt")


def sweeps(spark, sf):
    until = F.col("seen_at") + F.expr("INTERVAL 3 HOUR")
    return fx.readings(spark, sf).select("event_id", "instrument_id", F.col("seen_at").alias("covered_from"), until.alias("covered_to"), until.alias("recorded_at"))


COV = ("2024-01-20 00:00:00", "2024-01-05 00:00:00", "2024-01-19 00:00:00")


@query("p29_clipped_coverage", "sweep", f"""
SELECT instrument_id, strftime(greatest(covered_from, TIMESTAMP '{COV[1]}'), {FMT}) AS lo, strftime(least(covered_to, TIMESTAMP '{COV[2]}'), {FMT}) AS hi FROM sweep
WHERE recorded_at <= TIMESTAMP '{COV[0]}' AND covered_to > TIMESTAMP '{COV[1]}' AND covered_from < TIMESTAMP '{COV[2]}'""")
def p29(spark, sf):
    out = pit.clipped_coverage(sweeps(spark, sf), asof=COV[0], start=COV[1], end=COV[2])
    return out.select("instrument_id", stamp_text("lo").alias("lo"), stamp_text("hi").alias("hi"))


@query("p30_readings_and_unread", "hit_then, news", f"""
SELECT h.instrument_id, count(*) AS confirmed, count(l.doc_id) AS readings, count(*) - count(l.doc_id) AS unread FROM hit_then h JOIN news n USING (news_item_id)
LEFT JOIN labels l ON l.doc_id = h.news_item_id AND l.toxic = 0 WHERE h.decision = 'CONFIRMED' AND n.ingested_at <= TIMESTAMP '{HIT_ASOF}' GROUP BY 1""")
def p30(spark, sf):
    asof = F.lit(HIT_ASOF).cast("timestamp")
    pairs = pit.latest_verdicts(fx.verdicts(spark, sf), asof=HIT_ASOF).where("decision = 'CONFIRMED'").join(
        news(spark, sf).where(F.col("ingested_at") <= asof), "news_item_id")
    read = load(spark, sf, "labels").where("toxic = 0").select(F.col("doc_id").alias("news_item_id"), F.lit(1).alias("r"))
    return pairs.join(read, "news_item_id", "left").groupBy("instrument_id").agg(
        F.count(F.lit(1)).alias("confirmed"), F.count("r").alias("readings"), (F.count(F.lit(1)) - F.count("r")).alias("unread"))


@query("p31_disclosures_as_of", "filing", f"""
SELECT instrument_id, id, form, CAST(filed_at AS VARCHAR) AS filed_at FROM filing WHERE available_at <= TIMESTAMP '{ASOF}' AND available_at > TIMESTAMP '{ASOF}' - INTERVAL 60 DAY
  AND filed_at >= DATE '1997-05-15' AND filed_at < DATE '1997-06-20'""")
def p31(spark, sf):
    asof = F.lit(ASOF).cast("timestamp")
    rows = fx.filings(spark, sf).where((F.col("available_at") <= asof) & (F.col("available_at") > asof - F.expr("INTERVAL 60 DAY")))
    rows = rows.where((F.col("filed_at") >= F.lit("1997-05-15").cast("date")) & (F.col("filed_at") < F.lit("1997-06-20").cast("date")))
    return rows.select("instrument_id", "id", "form", day_text("filed_at").alias("filed_at"))


@query("p32_last_index_closes", "bars", """
SELECT instrument_id, k, CAST(day AS VARCHAR) AS day, round(close, 6) AS close FROM (
  SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY day DESC) AS k FROM bars WHERE day <= DATE '1998-03-02') WHERE k <= 20""")
def p32(spark, sf):
    from pyspark.sql import Window as W
    w = W.partitionBy("instrument_id").orderBy(F.col("day").desc())
    rows = fx.bars(spark, sf).where(F.col("day") <= F.lit("1998-03-02").cast("date")).withColumn("k", F.row_number().over(w)).where("k <= 20")
    return rows.select("instrument_id", F.col("k").cast("long").alias("k"), day_text("day").alias("day"), rounded("close").alias("close"))


@query("p33_latest_fetch_status", "", """
SELECT instrument_id, CAST(day AS VARCHAR) AS day, arg_max(event_type, row(ts, event_id)) AS status FROM (
  SELECT user_id AS instrument_id, CAST(ts AS DATE) AS day, event_type, ts, event_id FROM events) GROUP BY 1, 2""")
def p33(spark, sf):
    rows = load(spark, sf, "events").select(F.col("user_id").alias("instrument_id"), F.to_date("ts").alias("day"), "event_type", "ts", "event_id")
    return newest(rows, ["instrument_id", "day"], ["ts", "event_id"]).select("instrument_id", day_text("day").alias("day"), F.col("event_type").alias("status"))


@query("p34_newest_table_before", "mbars", """
SELECT instrument_id, CAST(day AS VARCHAR) AS day, minute, close FROM mbars WHERE day = (SELECT max(day) FROM mbars WHERE day < DATE '2024-01-15')""")
def p34(spark, sf):
    bars = fx.minute_bars(spark, sf)
    ticks = load(spark, sf, "events").select(F.to_date("ts").alias("day"))
    last = ticks.where(F.col("day") < F.lit("2024-01-15").cast("date")).agg(F.max("day").alias("day"))
    return bars.join(last, "day", "left_semi").select("instrument_id", day_text("day").alias("day"), "minute", "close")


cte("orep", """SELECT o_custkey % 30 AS instrument_id, 'B' || o_custkey % 20 AS broker, o_orderpriority AS opinion, CAST(o_orderdate AS DATE) AS report_date,
  CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice END AS target, o_orderkey AS id FROM orders""")


def reports(spark, sf):
    return load(spark, sf, "orders").select(
        (F.col("o_custkey") % 30).alias("instrument_id"), F.concat(F.lit("B"), (F.col("o_custkey") % 20).cast("string")).alias("broker"),
        F.col("o_orderpriority").alias("opinion"), F.to_date("o_orderdate").alias("report_date"),
        F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice")).alias("target"), F.col("o_orderkey").alias("id"))


@query("p35_usable_fetch", "orep", """
SELECT instrument_id, max(id) AS fetch_id, count(*) AS fetches FROM orep WHERE report_date >= DATE '1997-04-01' AND report_date < DATE '1997-07-01' AND target IS NOT NULL GROUP BY 1""")
def p35(spark, sf):
    rows = reports(spark, sf).where("target IS NOT NULL AND report_date >= DATE '1997-04-01' AND report_date < DATE '1997-07-01'")
    return rows.groupBy("instrument_id").agg(F.max("id").alias("fetch_id"), F.count(F.lit(1)).alias("fetches"))


@query("p36_latest_trend_fetch", "evt", f"""
SELECT instrument_id, arg_max(event_id, row(seen_at, event_id)) AS trend_id, strftime(max(seen_at), {FMT}) AS fetched_at FROM evt WHERE seen_at <= TIMESTAMP '2024-01-20' GROUP BY 1""")
def p36(spark, sf):
    rows = fx.readings(spark, sf).where(F.col("seen_at") <= F.lit("2024-01-20").cast("timestamp"))
    return rows.groupBy("instrument_id").agg(F.max_by("event_id", F.struct("seen_at", "event_id")).alias("trend_id"), stamp_text(F.max("seen_at")).alias("fetched_at"))


@query("p37_collector_health", "evt", f"""
SELECT event_type AS collector, arg_max(event_id, row(seen_at, event_id)) AS last_run, strftime(max(seen_at), {FMT}) AS last_at,
  strftime(max(CASE WHEN value > 50 THEN seen_at END), {FMT}) AS last_success, count(*) AS runs FROM evt GROUP BY 1""")
def p37(spark, sf):
    return fx.readings(spark, sf).groupBy(F.col("event_type").alias("collector")).agg(
        F.max_by("event_id", F.struct("seen_at", "event_id")).alias("last_run"), stamp_text(F.max("seen_at")).alias("last_at"),
        stamp_text(F.max(F.when(F.col("value") > 50, F.col("seen_at")))).alias("last_success"), F.count(F.lit(1)).alias("runs"))
