"""Queries N1-N21."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from knownat.functions.numeric import day_text, key_day, rounded, stamp_text
from knownat.operators import calendar as cal
from knownat.operators import names as nm
from knownat.operators import news as nw
from knownat.operators import pit
from knownat.plans import fixtures as fx
from knownat.plans.pit import news as news_items, reports, sweeps
from knownat.plans.registry import cte, query
from knownat.sources.tables import load

FMT = "'%Y-%m-%d %H:%M:%S'"
#: instrument, name, aliases, symbol
REGISTRY = [
    *((i, n, [], None) for i, n in enumerate(("inoran", "thatin", "ononst", "orantion", "ther", "ention", "eren", "onan", "eau", "oran", "that", "tion"))),
    (12, "En", ["whon"], None), (13, "Nt", ["in by"], "555"), (14, "Nd", [], None),
]
NAMES = tuple(r[1] for r in REGISTRY)
RULE = 3  # the version verdicts are judged under


def registry(spark):
    return spark.createDataFrame(REGISTRY, "instrument_id long, name string, aliases array<string>, symbol string")


def articles(spark, sf):
    """Every document as an article: first line the title, the whole rest the summary."""
    at = F.instr("text", "\n")
    return load(spark, sf, "documents").select(
        F.col("doc_id").alias("news_item_id"), F.when(at > 0, F.substring_index("text", "\n", 1)).otherwise(F.lit("")).alias("title"),
        F.when(at > 0, F.expr("substring(text, instr(text, '\n') + 1)")).otherwise(F.col("text")).alias("summary")
    ).repartition("news_item_id")  # the table is one row group, and a text is searched within a task


def flat(term):
    return term.replace(" ", "").lower()


def spelled(term):
    return "\\s*".join(term.replace(" ", ""))


def term_sql(term, text="text"):
    """Whether a Latin spelling stands on its own in a text in which longer spellings around it are blanked out."""
    every = [t for _, n, aliases, _ in REGISTRY for t in (n, *aliases)]
    longer = [spelled(o) for o in every if flat(term) in flat(o) and flat(o) != flat(term)]
    blanked = f"regexp_replace({text}, '(?i){'|'.join(longer)}', 'X', 'g')" if longer else text
    return f"regexp_matches({blanked}, '{'' if len(flat(term)) <= 3 else '(?i)'}(^|[^A-Za-z0-9]){spelled(term)}([^A-Za-z0-9]|$)')"


OPENING = """^(\\s*(\\[[^\\]]*\\]|<[^>]*>|【[^】]*】|\\([^)]*\\))\\s*)*[ "''“‘]*"""


def verdict_sql(columns, rows):
    """Decision, method and reason of every registered name over ``rows`` (columns, title, text); absent ones too."""
    parts = []
    for i, name, aliases, symbol in REGISTRY:
        by_alias = " OR ".join(term_sql(t) for t in aliases) or "false"
        by_symbol = f"regexp_matches(text, '(^|[^0-9]){symbol}([^0-9]|$)')" if symbol else "false"
        lead = f"regexp_matches(title, '{OPENING}(?i:{spelled(name)})\\s*,')"
        parts.append(f"SELECT {columns}, {i} AS instrument_id, {len(name) <= 3} AS short, {term_sql(name)} AS named, {by_alias} AS by_alias, {by_symbol} AS by_symbol, {lead} AS lead FROM {rows}")
    return f"""SELECT {columns}, CAST(instrument_id AS BIGINT) AS instrument_id,
  CASE WHEN named AND short AND NOT by_symbol AND NOT lead THEN 'PENDING' WHEN named OR by_alias OR by_symbol THEN 'CONFIRMED' ELSE 'REJECTED' END AS decision,
  CASE WHEN named THEN 'NAME' WHEN by_alias THEN 'ALIAS' WHEN by_symbol THEN 'SYMBOL' END AS match_method,
  CASE WHEN named AND NOT short THEN 'name' WHEN named AND by_symbol THEN 'strong:symbol' WHEN named AND lead THEN 'strong:title_lead' WHEN named THEN 'context:none'
    WHEN by_alias THEN 'alias' WHEN by_symbol THEN 'strong:symbol' ELSE 'absent' END AS decision_reason FROM ({" UNION ALL ".join(parts)})"""


cte("article", "SELECT doc_id AS news_item_id, CASE WHEN contains(text, chr(10)) THEN split_part(text, chr(10), 1) ELSE '' END AS title, text FROM documents")
cte("judged", verdict_sql("news_item_id", "article"), "article")


@query("n1_name_matches", "judged", "SELECT news_item_id, instrument_id FROM judged WHERE match_method = 'NAME'")
def n1(spark, sf):
    return nw.judge_articles(articles(spark, sf), registry(spark)).where("match_method = 'NAME'").select("news_item_id", "instrument_id")


@query("n2_conflicting_names", "", """
SELECT p.p_partkey AS instrument_id, p.name, q.other FROM (SELECT p_partkey, split_part(p_name, ' ', 1) AS name FROM part) p JOIN (
  SELECT DISTINCT p_name AS other FROM part) q ON length(replace(q.other, ' ', '')) > length(p.name) AND contains(replace(q.other, ' ', ''), p.name)""")
def n2(spark, sf):
    rows = load(spark, sf, "part")
    # every part is registered by its first word; the whole names are aliases of an instrument of their own
    nothing = F.lit(None).cast("string").alias("symbol")
    short = rows.select(F.col("p_partkey").alias("instrument_id"), F.substring_index("p_name", " ", 1).alias("name"), F.array().cast("array<string>").alias("aliases"), nothing)
    full = rows.select("p_name").distinct().select(F.lit(-1).cast("long").alias("instrument_id"), F.lit(None).cast("string").alias("name"), F.array("p_name").alias("aliases"), nothing)
    out = nm.conflicts(short.unionByName(full))
    return out.where((F.col("instrument_id") >= 0) & F.col("other").contains(" "))


@query("n3_verdicts", "judged", "SELECT * FROM judged WHERE decision <> 'REJECTED'")
def n3(spark, sf):
    return nw.judge_articles(articles(spark, sf), registry(spark)).where("decision <> 'REJECTED'")


cte("hits", f"""SELECT h.hit_id, h.instrument_id, h.decision, CASE WHEN h.hit_id % 7 <> 0 THEN a.text END AS text, a.title FROM (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hit_id ORDER BY decided_at DESC, id DESC) AS rn FROM hit WHERE rule_version < {RULE}) WHERE rn = 1 AND decided_by = 'RULE') h JOIN article a ON a.news_item_id = h.news_item_id""", "hit", "article")
cte("rejudged", verdict_sql("hit_id", "(SELECT * FROM hits WHERE text IS NOT NULL)"), "hits")


@query("n4_rejudged", "rejudged", f"""
SELECT h.hit_id, h.instrument_id, CASE WHEN h.text IS NULL THEN 'UNREAD' WHEN h.instrument_id >= {len(REGISTRY)} THEN 'SKIPPED' ELSE 'JUDGED' END AS outcome, r.decision, r.match_method, r.decision_reason, h.decision AS old_decision,
  coalesce(r.decision <> h.decision, false) AS changed FROM hits h LEFT JOIN rejudged r ON r.hit_id = h.hit_id AND r.instrument_id = h.instrument_id""")
def n4(spark, sf):
    """Every verdict of an older rule, judged again on the snippet it read; a seventh of the hits kept none."""
    return nm.rejudged(stored_hits(spark, sf), registry(spark), RULE)


def stored_hits(spark, sf):
    newest = pit.latest_verdicts(fx.verdicts(spark, sf).where(F.col("rule_version") < RULE))
    read = articles(spark, sf).select("news_item_id", "title", F.when(F.col("news_item_id") % 7 != 0, F.col("summary")).alias("snippet"))
    return newest.join(read, "news_item_id")


@query("n4_appended_verdicts", "rejudged", """
SELECT h.hit_id, r.decision, r.decision_reason FROM hits h JOIN rejudged r ON r.hit_id = h.hit_id AND r.instrument_id = h.instrument_id WHERE r.decision <> h.decision""")
def n4b(spark, sf):
    """What judging again appends: the verdicts that changed, one a hit; models are never overruled."""
    out = nm.rejudged(stored_hits(spark, sf), registry(spark), RULE).where("outcome = 'JUDGED'")
    incoming = out.select("hit_id", "decision", "decision_reason", F.lit("RULE").alias("decided_by"))
    return pit.append_verdicts(fx.verdicts(spark, sf).where(F.col("rule_version") < RULE), incoming, ["decision", "decided_by"]).select("hit_id", "decision", "decision_reason")


cte("yields", "SELECT 'Q' || user_id % 60 AS query, CASE event_type WHEN 'click' THEN 'REJECTED' WHEN 'error' THEN 'PENDING' ELSE 'CONFIRMED' END AS decision, user_id, event_id FROM events WHERE NOT (event_type = 'click' AND user_id % 60 < 20)")
PER = "SELECT query, count(*) AS evaluated, count(*) FILTER (decision = 'CONFIRMED') AS matched, count(*) FILTER (decision = 'REJECTED') AS rejected, count(*) FILTER (decision = 'PENDING') AS pending FROM yields GROUP BY 1"
WILSON = "((rejected / evaluated + 3.8416 / (2 * evaluated) - 1.96 * sqrt(rejected / evaluated * (1 - rejected / evaluated) / evaluated + 3.8416 / (4 * evaluated * evaluated))) / (1 + 3.8416 / evaluated))"


@query("n5_reject_report", "yields", f"""
WITH p AS (SELECT *, {WILSON} AS f FROM ({PER}))
SELECT * FROM (SELECT 'highest reject rate' AS list, query, evaluated, matched, rejected, pending, round(f, 6) AS reject_floor FROM p WHERE rejected > 0 ORDER BY f DESC, rejected DESC, query LIMIT 20)
UNION ALL SELECT * FROM (SELECT 'most mentions with no reject', query, evaluated, matched, rejected, pending, round(f, 6) FROM p WHERE matched > 0 AND rejected = 0 ORDER BY matched DESC, query LIMIT 20)
UNION ALL SELECT * FROM (SELECT 'most pending', query, evaluated, matched, rejected, pending, round(f, 6) FROM p WHERE pending > 0 ORDER BY pending DESC, query LIMIT 20)""")
def n5(spark, sf):
    rows = load(spark, sf, "events").where("NOT (event_type = 'click' AND user_id % 60 < 20)").select(
        F.concat(F.lit("Q"), (F.col("user_id") % 60).cast("string")).alias("query"),
        F.when(F.col("event_type") == "click", "REJECTED").when(F.col("event_type") == "error", "PENDING").otherwise("CONFIRMED").alias("decision"))
    return nw.reject_report(rows, ["query"]).withColumn("reject_floor", rounded("reject_floor"))


# themes: the source of a document; its address repeats over similar ids, and a fifth has no web address
cte("themed", """SELECT source AS theme, CASE WHEN doc_id % 5 = 4 THEN 'app:' ELSE 'https://x/' END || CAST(doc_id % 400 AS VARCHAR) AS url, TIMESTAMP '2024-01-01' + to_minutes(doc_id % 700) AS published_at, doc_id AS news_item_id FROM documents""")
cte("theme_one", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY theme, url ORDER BY published_at DESC, news_item_id) AS rn FROM themed) WHERE rn = 1", "themed")


@query("n6_theme_days", "theme_one, judged", """
WITH said AS (SELECT o.theme, j.instrument_id, count(*) AS n FROM theme_one o JOIN judged j USING (news_item_id) WHERE j.decision = 'CONFIRMED' AND j.instrument_id NOT IN (4, 8) GROUP BY 1, 2),
 lists AS (SELECT theme, 'HEADLINE' AS kind, row_number() OVER (PARTITION BY theme ORDER BY published_at DESC, news_item_id) AS place, 5 AS most, url AS key, CAST(NULL AS BIGINT) AS count FROM theme_one WHERE url LIKE 'https:%'
  UNION ALL SELECT theme, 'MENTION', row_number() OVER (PARTITION BY theme ORDER BY n DESC, instrument_id), 8, CAST(instrument_id AS VARCHAR), n FROM said)
SELECT t.theme, t.articles, l.kind, l.place, l.key, l.count FROM (SELECT theme, count(*) AS articles FROM theme_one GROUP BY 1) t LEFT JOIN (SELECT * FROM lists WHERE place <= most) l USING (theme)""")
def n6b(spark, sf):
    """Per theme: articles without repeated addresses, the newest headlines and the names mentioned most."""
    d = F.col("doc_id")
    found = load(spark, sf, "documents").select(
        d.alias("news_item_id"), F.col("source").alias("theme"), F.concat(F.when(d % 5 == 4, "app:").otherwise("https://x/"), (d % 400).cast("string")).alias("url"),
        F.timestamp_add("MINUTE", d % 700, F.to_timestamp(F.lit("2024-01-01 00:00:00"))).alias("published_at"))
    return nw.theme_days(found.join(articles(spark, sf), "news_item_id"), registry(spark), generic=[4, 8]).select(
        "theme", "articles", "kind", F.col("place").cast("long").alias("place"), "key", "count")


@query("n6_theme_mentions", "judged", "SELECT instrument_id, count(*) AS articles FROM judged WHERE match_method = 'NAME' AND decision = 'CONFIRMED' AND instrument_id NOT IN (4, 8) GROUP BY 1 ORDER BY articles DESC, instrument_id LIMIT 8")
def n6(spark, sf):
    return nw.mention_counts(nw.judge_articles(articles(spark, sf), registry(spark)).where("match_method = 'NAME'"), generic=[4, 8])


@query("n7_rule_model_agreement", "hit_now", """
WITH a AS (SELECT CASE h.decided_by WHEN 'MODEL' THEN 'UNSURE' ELSE CASE WHEN l.toxic = 1 THEN 'REJECTED' ELSE 'CONFIRMED' END END AS v, CASE WHEN h.hit_id % 3 = 0 THEN 'abc' WHEN h.hit_id % 3 = 1 THEN '한국전력' ELSE 'a한 b' END AS name,
  CASE WHEN h.hit_id % 2 = 0 THEN 'weak:x' ELSE 'name' END AS reason FROM hit_now h JOIN labels l ON l.doc_id = h.hit_id WHERE h.decision = 'CONFIRMED'),
 k AS (SELECT v, unnest([{'kind': 'shape', 'key': CASE name WHEN 'abc' THEN 'latin 3' WHEN '한국전력' THEN 'hangul 4+' ELSE 'mixed' END}, {'kind': 'reason', 'key': split_part(reason, ':', 1)}]) AS k FROM a)
SELECT k.kind AS kind, k.key AS key, count(*) AS audited, count(*) FILTER (v = 'CONFIRMED') AS confirmed, count(*) FILTER (v = 'REJECTED') AS rejected, count(*) FILTER (v = 'UNSURE') AS unsure,
  round(count(*) FILTER (v = 'CONFIRMED') / nullif(count(*) FILTER (v IN ('CONFIRMED', 'REJECTED')), 0), 6) AS precision FROM k GROUP BY 1, 2""")
def n7(spark, sf):
    h = F.col("hit_id")
    toxic = load(spark, sf, "labels").select(F.col("doc_id").alias("hit_id"), "toxic")
    rows = pit.latest_verdicts(fx.verdicts(spark, sf)).where("decision = 'CONFIRMED'").join(toxic, "hit_id").select(
        F.when(F.col("decided_by") == "MODEL", "UNSURE").when(F.col("toxic") == 1, "REJECTED").otherwise("CONFIRMED").alias("model_verdict"),
        F.when(h % 3 == 0, "abc").when(h % 3 == 1, "한국전력").otherwise("a한 b").alias("name"), F.when(h % 2 == 0, "weak:x").otherwise("name").alias("rule_reason"))
    return nw.agreement(rows).withColumn("precision", rounded("precision"))


@query("n8_fair_selection", "evt", f"""
WITH t AS (SELECT event_id AS hit_id, instrument_id, seen_at, CASE WHEN seen_at >= TIMESTAMP '2024-01-27' THEN 0 ELSE 1 END AS tier FROM evt),
 d AS (SELECT *, row_number() OVER (PARTITION BY tier, instrument_id ORDER BY seen_at DESC, hit_id) AS depth, max(seen_at) OVER (PARTITION BY tier, instrument_id) AS newest FROM t)
SELECT hit_id, instrument_id, CAST(tier AS BIGINT) AS tier, depth FROM d ORDER BY tier, depth, newest DESC, instrument_id LIMIT 500""")
def n8(spark, sf):
    rows = fx.readings(spark, sf).select(F.col("event_id").alias("hit_id"), "instrument_id", F.col("seen_at").alias("available_at"))
    out = nw.fair_selection(rows, 500, F.lit("2024-01-30 00:00:00").cast("timestamp"))
    return out.select("hit_id", "instrument_id", F.col("tier").cast("long").alias("tier"), F.col("depth").cast("long").alias("depth"))


@query("n9_focus_set", "evt", """
SELECT DISTINCT instrument_id FROM (SELECT c_custkey AS instrument_id FROM customer WHERE c_custkey % 5 = 0 AND c_custkey NOT IN (SELECT instrument_id FROM evt WHERE event_type = 'signup' AND seen_at > TIMESTAMP '2024-01-15')
 UNION ALL SELECT instrument_id FROM evt WHERE event_type = 'purchase' AND seen_at > TIMESTAMP '2024-01-12' AND seen_at <= TIMESTAMP '2024-01-15')""")
def n9(spark, sf):
    asof = F.lit("2024-01-15 00:00:00").cast("timestamp")
    rows = fx.readings(spark, sf)
    promotions = rows.where("event_type = 'signup'").select("instrument_id", F.col("seen_at").alias("promoted_at"))
    tracked = pit.promoted_by(load(spark, sf, "customer").where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("instrument_id")), promotions, asof)
    recent = rows.where((F.col("event_type") == "purchase") & (F.col("seen_at") > F.date_sub(asof, 3)) & (F.col("seen_at") <= asof)).select("instrument_id")
    return tracked.unionByName(recent).distinct()


TITLES = ("[기재정정] 유상증자결정", "유상증자결정", "단일판매ㆍ공급계약체결", "단일판매ㆍ공급계약체결(자회사의 주요경영사항)", "주식소각결정", "유무상증자결정", "현금ㆍ현물배당결정",
          "자기주식취득결과보고서", "소송등의판결", "회사합병결정", "연결재무제표기준영업(잠정)실적(공정공시)", "대표이사변경", "분기보고서 (2024.03)", "[첨부추가] 횡령ㆍ배임혐의발생", "파산신청기각", "전환사채권발행결정(종속회사의주요경영사항)")
cte("title", "SELECT doc_id AS filing_id, doc_id % 40 AS instrument_id, [" + ", ".join(f"'{t}'" for t in TITLES) + "][doc_id % 16 + 1] || ' ' || lang AS report_nm FROM documents")


def titles(spark, sf):
    return load(spark, sf, "documents").select(
        F.col("doc_id").alias("filing_id"), (F.col("doc_id") % 40).alias("instrument_id"),
        F.concat_ws(" ", F.element_at(F.array(*[F.lit(t) for t in TITLES]), (F.col("doc_id") % 16 + 1).cast("int")), "lang").alias("report_nm"))


PHRASES = [(p, e, s, i) for phrases, e, s, i in nw.TITLE_RULES for p in phrases]
_pick = "CASE WHEN no_event THEN NULL " + " ".join(f"WHEN contains(flat, '{p}') THEN {k + 1}" for k, (p, *_r) in enumerate(PHRASES)) + " END"


def _list(at, text=False):
    return "[" + ", ".join("NULL" if r[at] is None else (f"'{r[at]}'" if text else str(r[at])) for r in PHRASES) + "]"


cte("titled", f"""SELECT filing_id, instrument_id, report_nm, {_list(0, True)}[k] AS phrase, {_list(1, True)}[k] AS event_type, CAST({_list(2)}[k] AS DOUBLE) AS sentiment, CASE WHEN k IS NOT NULL THEN sub END AS subsidiary,
   {_list(3)}[k] * CASE WHEN sub THEN 0.5 ELSE 1.0 END AS intensity FROM (SELECT *, {_pick} AS k, contains(flat, '자회사의주요경영사항') OR contains(flat, '종속회사의주요경영사항') AS sub FROM (
   SELECT *, contains(regexp_extract(report_nm, '^\\s*(\\[[^\\]]*\\])', 1), '정정') OR contains(flat, '결과보고서') OR contains(flat, '상황보고서') OR contains(flat, '거래정지해제') AS no_event FROM (
    SELECT *, regexp_replace(regexp_replace(report_nm, '^\\s*\\[[^\\]]*\\]', ''), '[\\s·ㆍ‧・()]+', '', 'g') AS flat FROM title)))""", "title")


@query("n10_title_events", "titled", "SELECT filing_id, phrase, event_type, sentiment, round(intensity, 6) AS intensity, subsidiary FROM titled")
def n10(spark, sf):
    return nw.classify_titles(titles(spark, sf)).select("filing_id", "phrase", "event_type", "sentiment", rounded("intensity").alias("intensity"), "subsidiary")


@query("n11_strongest_event", "titled", "SELECT instrument_id, round(max(intensity), 6) AS intensity FROM titled WHERE event_type IS NOT NULL GROUP BY 1")
def n11(spark, sf):
    return nw.strongest_intensity(nw.classify_titles(titles(spark, sf))).select("instrument_id", rounded("intensity").alias("intensity"))


KIND5 = ("PRICE_MOVE", "EARNINGS", "ORDER_CONTRACT", "PRODUCT", "OTHER")
ASOF = "2024-01-30 12:00:00"
cte("reading", f"""SELECT event_id AS item_id, instrument_id % 10 AS instrument_id, seen_at AS available_at, [{', '.join(f"'{k}'" for k in KIND5)}][event_id % 5 + 1] AS event_type, sentiment, intensity, confidence,
  event_id % 4 <> 0 AS directional, CASE WHEN event_id % 6 = 0 THEN 'DART' ELSE 'NEWS' END AS source FROM evt WHERE event_id % 11 <> 0""", "evt")


def overlay_readings(spark, sf):
    """Readings not marked immaterial (every eleventh is), as news or as classified filings."""
    key = F.col("event_id")
    return fx.readings(spark, sf).where("event_id % 11 <> 0").select(
        key.alias("item_id"), (F.col("instrument_id") % 10).alias("instrument_id"), F.col("seen_at").alias("available_at"),
        F.element_at(F.array(*[F.lit(k) for k in KIND5]), (key % 5 + 1).cast("int")).alias("event_type"), "sentiment", "intensity", "confidence",
        (key % 4 != 0).alias("directional"), F.when(key % 6 == 0, "DART").otherwise("NEWS").alias("source"))


cte("used", f"SELECT * FROM reading WHERE confidence >= 0.3 AND available_at <= TIMESTAMP '{ASOF}' AND available_at >= TIMESTAMP '{ASOF}' - INTERVAL 1440 HOUR", "reading")
cte("chain", """SELECT instrument_id, event_type, min(available_at) AS a FROM used GROUP BY 1, 2
  UNION ALL SELECT c.instrument_id, c.event_type, (SELECT min(u.available_at) FROM used u WHERE u.instrument_id = c.instrument_id AND u.event_type = c.event_type AND u.available_at > c.a + INTERVAL 24 HOUR) AS a
  FROM chain c WHERE EXISTS (SELECT 1 FROM used u WHERE u.instrument_id = c.instrument_id AND u.event_type = c.event_type AND u.available_at > c.a + INTERVAL 24 HOUR)""", "used")
HL = "CASE event_type WHEN 'PRICE_MOVE' THEN 24 WHEN 'EARNINGS' THEN 120 WHEN 'ORDER_CONTRACT' THEN 168 WHEN 'PRODUCT' THEN 72 ELSE 24 END"
cte("clus", f"""SELECT *, sentiment * intensity * confidence * decay AS contribution FROM (SELECT instrument_id, event_type, a AS first_at, articles, coalesce(sc / nullif(c, 0), 0) AS sentiment, intensity, coalesce(conf, 0) AS confidence,
   pow(0.5, epoch(TIMESTAMP '{ASOF}' - a) / 3600 / ({HL})) AS decay, lead_id FROM (
   SELECT instrument_id, event_type, a, count(*) AS articles, CAST(sum(CAST(sentiment * confidence AS DECIMAL(24,12))) FILTER (directional) AS DOUBLE) AS sc, CAST(sum(CAST(confidence AS DECIMAL(24,12))) FILTER (directional) AS DOUBLE) AS c, max(intensity) AS intensity, max(confidence) FILTER (directional) AS conf,
     coalesce(arg_max(item_id, row(intensity * confidence, -item_id)) FILTER (source = 'NEWS'), arg_max(item_id, row(intensity * confidence, -item_id))) AS lead_id
   FROM (SELECT u.*, (SELECT max(c.a) FROM chain c WHERE c.instrument_id = u.instrument_id AND c.event_type = u.event_type AND c.a <= u.available_at) AS a FROM used u) GROUP BY 1, 2, 3)
   WHERE epoch(TIMESTAMP '{ASOF}' - a) / 3600 <= ({HL}) * 6)""", "chain", "used")


def cluster_rows(spark, sf):
    return nw.clusters(overlay_readings(spark, sf), F.lit(ASOF).cast("timestamp"))


@query("n12_event_clusters", "clus", f"SELECT instrument_id, event_type, strftime(first_at, {FMT}) AS first_at, articles, round(sentiment, 6) AS sentiment, round(decay, 6) AS decay, lead_id FROM clus")
def n12(spark, sf):
    return cluster_rows(spark, sf).select("instrument_id", "event_type", stamp_text("first_at").alias("first_at"), "articles", rounded("sentiment").alias("sentiment"), rounded("decay").alias("decay"), "lead_id")


@query("n13_overlay_points", "clus", "SELECT instrument_id, round(sum(contribution), 6) AS raw, round(10 * tanh(sum(contribution)), 5) AS points, count(*) AS events, CAST(sum(articles) AS BIGINT) AS readings_used FROM clus GROUP BY 1")
def n13(spark, sf):
    return nw.overlay(cluster_rows(spark, sf)).select("instrument_id", rounded("raw").alias("raw"), rounded("points", 5).alias("points"), "events", "readings_used")


@query("n13_top_clusters", "clus", "SELECT instrument_id, place, event_type, lead_id FROM (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY abs(contribution) DESC, event_type, first_at) AS place FROM clus) WHERE place <= 10")
def n13b(spark, sf):
    return nw.top_clusters(cluster_rows(spark, sf)).select("instrument_id", F.col("place").cast("long").alias("place"), "event_type", "lead_id")


WIN = ("2024-01-15 00:00:00", "2024-01-28 00:00:00", "2024-01-29 00:00:00")
cte("span", f"SELECT instrument_id, covered_from AS lo, covered_to AS hi FROM sweep WHERE recorded_at <= TIMESTAMP '{WIN[2]}'", "sweep")


def spans(spark, sf):
    return sweeps(spark, sf).where(F.col("recorded_at") <= F.lit(WIN[2]).cast("timestamp")).select(
        "instrument_id", F.col("covered_from").alias("lo"), F.col("covered_to").alias("hi"))


def union_sql(start, end):
    return f"""SELECT instrument_id, sum(greatest(0, epoch(hi) - epoch(greatest(lo, coalesce(reach, lo))))) / 86400.0 AS days FROM (SELECT *, max(hi) OVER (PARTITION BY instrument_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (
   SELECT instrument_id, greatest(lo, TIMESTAMP '{start}') AS lo, least(hi, TIMESTAMP '{end}') AS hi FROM span WHERE hi > TIMESTAMP '{start}' AND lo < TIMESTAMP '{end}')) GROUP BY 1"""


@query("n14_covered_days", "span", f"""
SELECT instrument_id, 'baseline' AS "window", round(days, 6) AS days FROM ({union_sql(WIN[0], WIN[1])}) UNION ALL SELECT instrument_id, 'recent', round(days, 6) FROM ({union_sql(WIN[1], WIN[2])})""")
def n14(spark, sf):
    a, b, c = (F.lit(x).cast("timestamp") for x in WIN)
    return nw.covered_days(spans(spark, sf), {"baseline": (a, b), "recent": (b, c)}).select("instrument_id", "window", rounded("days").alias("days"))


@query("n14_merged_intervals", "span", f"""
SELECT instrument_id, strftime(min(lo), {FMT}) AS lo, strftime(max(hi), {FMT}) AS hi FROM (SELECT *, sum(fresh) OVER (PARTITION BY instrument_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM (
  SELECT *, CASE WHEN lo > max(hi) OVER (PARTITION BY instrument_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 WHEN row_number() OVER (PARTITION BY instrument_id ORDER BY lo, hi) = 1 THEN 1 ELSE 0 END AS fresh FROM span)) GROUP BY instrument_id, island""")
def n14b(spark, sf):
    return nw.merged_intervals(spans(spark, sf)).select("instrument_id", stamp_text("lo").alias("lo"), stamp_text("hi").alias("hi"))


@query("n15_inside_read", "span, evt", """
SELECT e.event_id, EXISTS (SELECT 1 FROM span s WHERE s.instrument_id = (e.instrument_id + 1) % 150 AND s.lo <= e.seen_at AND s.hi >= e.seen_at) AS inside FROM evt e""")
def n15(spark, sf):
    moments = fx.readings(spark, sf).select("event_id", ((F.col("instrument_id") + 1) % 150).alias("instrument_id"), "seen_at")
    return nw.inside_any(moments, spans(spark, sf), "seen_at").select("event_id", "inside")


cte("ment", "SELECT instrument_id, seen_at AS available_at FROM evt WHERE event_type <> 'error'", "evt")
cte("disc", f"""
SELECT *, CASE WHEN recent_days < 0.25 OR baseline_days < 1 THEN 'UNMEASURED' WHEN recent < 3 THEN 'THIN' ELSE 'RANKED' END AS status, baseline / nullif(baseline_days, 0) * recent_days AS expected FROM (
 SELECT m.instrument_id, count(*) FILTER (available_at > TIMESTAMP '{WIN[1]}') AS any_recent, count(*) FILTER (available_at > TIMESTAMP '{WIN[1]}' AND r) AS recent, count(*) FILTER (available_at <= TIMESTAMP '{WIN[1]}' AND b) AS baseline,
   coalesce(any_value(x.days), 0) AS recent_days, coalesce(any_value(y.days), 0) AS baseline_days FROM (
   SELECT *, EXISTS (SELECT 1 FROM span s WHERE s.instrument_id = m.instrument_id AND greatest(s.lo, TIMESTAMP '{WIN[1]}') <= available_at AND s.hi >= available_at AND s.hi > TIMESTAMP '{WIN[1]}' AND s.lo < TIMESTAMP '{WIN[2]}') AS r,
      EXISTS (SELECT 1 FROM span s WHERE s.instrument_id = m.instrument_id AND s.lo <= available_at AND least(s.hi, TIMESTAMP '{WIN[1]}') >= available_at AND s.lo < TIMESTAMP '{WIN[1]}' AND s.hi > TIMESTAMP '2024-01-14') AS b
   FROM ment m WHERE available_at > TIMESTAMP '2024-01-14' AND available_at <= TIMESTAMP '{WIN[2]}') m
 LEFT JOIN ({union_sql(WIN[1], WIN[2])}) x ON x.instrument_id = m.instrument_id LEFT JOIN ({union_sql('2024-01-14 00:00:00', WIN[1])}) y ON y.instrument_id = m.instrument_id GROUP BY 1) WHERE any_recent >= 3""", "ment", "span")


@query("n16_surge_discovery", "disc", """
SELECT instrument_id, status, recent, baseline, round(recent_days, 6) AS recent_days, round(baseline_days, 6) AS baseline_days, round(score, 6) AS score, CASE WHEN status = 'RANKED' THEN rank END AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY status ORDER BY score DESC, recent DESC, instrument_id) AS rank FROM (SELECT *, CASE WHEN status <> 'UNMEASURED' THEN (recent + 1.0) / (expected + 1.0) END AS score FROM disc)) WHERE status = 'UNMEASURED' OR (status = 'RANKED' AND rank <= 20)""")
def n16(spark, sf):
    mentions = fx.readings(spark, sf).where("event_type <> 'error'").select("instrument_id", F.col("seen_at").alias("available_at"))
    out = nw.discover(mentions, spans(spark, sf), F.lit(WIN[2]).cast("timestamp"))
    return out.select("instrument_id", "status", "recent", "baseline", rounded("recent_days").alias("recent_days"), rounded("baseline_days").alias("baseline_days"), rounded("score").alias("score"), F.col("rank").cast("long").alias("rank"))


# search trends: order counts per (instrument, day), fetched over the last 60 days up to an end date
YEST = "1998-06-30"
cte("trend", "SELECT o_custkey % 60 AS instrument_id, CAST(o_orderdate AS DATE) AS day, CAST(count(*) AS DOUBLE) AS ratio FROM orders GROUP BY 1, 2")
cte("tfetch", f"""SELECT DISTINCT o_custkey % 60 AS instrument_id, CASE WHEN o_custkey % 60 % 10 <> 9 THEN DATE '{YEST}' - CASE WHEN o_custkey % 60 % 6 = 5 THEN 10 ELSE 60 END END AS start_date,
  CASE WHEN o_custkey % 60 % 10 <> 9 THEN DATE '{YEST}' - CASE WHEN o_custkey % 60 % 7 = 6 THEN 5 ELSE 0 END END AS end_date FROM orders""")


@query("n17_search_attention", "trend, tfetch, sess", f"""
WITH f AS (SELECT *, least(end_date, DATE '{YEST}') AS last FROM tfetch), x AS (SELECT f.*, (SELECT max(day) FROM sess WHERE day <= last) AS newest, (SELECT count(*) FROM sess WHERE day BETWEEN start_date AND last) AS n,
   (SELECT max(day) FROM sess WHERE day <= DATE '{YEST}' AND day >= DATE '{YEST}' - 14) AS market FROM f),
 st AS (SELECT *, CASE WHEN end_date IS NULL THEN 'NO_FETCH' WHEN last < start_date THEN 'UNMEASURED' WHEN newest < market THEN 'STALE' WHEN n < 23 THEN 'UNMEASURED' ELSE 'MEASURED' END AS status FROM x),
 v AS (SELECT st.instrument_id, coalesce(t.ratio, 0) AS ratio, row_number() OVER (PARTITION BY st.instrument_id ORDER BY s.day DESC) AS k FROM st JOIN sess s ON s.day BETWEEN st.start_date AND st.last LEFT JOIN trend t ON t.instrument_id = st.instrument_id AND t.day = s.day WHERE st.status = 'MEASURED'),
 m AS (SELECT instrument_id, sum(ratio) FILTER (k <= 3) / 3 AS recent, sum(ratio) FILTER (k BETWEEN 4 AND 23) / 20 AS baseline FROM v GROUP BY 1)
SELECT instrument_id, status, round(recent, 6) AS recent, round(baseline, 6) AS baseline, round((recent + 1) / (baseline + 1), 6) AS surge FROM st LEFT JOIN m USING (instrument_id)""")
def n17(spark, sf):
    rows = load(spark, sf, "orders").select((F.col("o_custkey") % 60).alias("instrument_id"), F.to_date("o_orderdate").alias("day"))
    series = rows.groupBy("instrument_id", "day").agg(F.count(F.lit(1)).cast("double").alias("ratio"))
    i, y = F.col("instrument_id"), F.lit(YEST).cast("date")
    fetches = rows.select("instrument_id").distinct().select(
        "instrument_id", F.when(i % 10 != 9, F.date_sub(y, F.when(i % 6 == 5, 10).otherwise(60))).alias("start_date"),
        F.when(i % 10 != 9, F.date_sub(y, F.when(i % 7 == 6, 5).otherwise(0))).alias("end_date"), y.alias("yesterday"))
    sess = fx.sessions(spark, sf)
    out = nw.attention(series, fetches, sess, cal.day_spine(sess))
    return out.select("instrument_id", "status", rounded("recent").alias("recent"), rounded("baseline").alias("baseline"), rounded("surge").alias("surge"))


OPN = "CASE substr(opinion, 1, 1) WHEN '1' THEN 'Buy' WHEN '2' THEN '비중 확대' WHEN '3' THEN 'Neutral' WHEN '4' THEN 'Reduce' ELSE 'NR' END"


@query("n18_analyst_summary", "orep", f"""
WITH r AS (SELECT *, {OPN} AS op FROM orep WHERE report_date < DATE '1997-07-01'), w AS (SELECT * FROM r WHERE report_date >= DATE '1997-07-01' - 90),
 l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY instrument_id, broker ORDER BY report_date DESC, id DESC) AS k, count(*) OVER (PARTITION BY instrument_id, broker) AS c FROM w) WHERE k = 1),
 b AS (SELECT l.instrument_id, l.broker, arg_max(r.target, row(r.report_date, r.id)) AS before FROM l JOIN r ON r.instrument_id = l.instrument_id AND r.broker = l.broker AND r.target IS NOT NULL AND (r.report_date, r.id) < (l.report_date, l.id) GROUP BY 1, 2)
SELECT instrument_id, CAST(sum(c) AS BIGINT) AS reports, count(*) AS brokers, round(avg(target), 4) AS avg_target, count(target) AS target_brokers, count(*) FILTER (op IN ('Buy', '비중 확대')) AS buy, count(*) FILTER (op = 'Neutral') AS hold,
  count(*) FILTER (op = 'Reduce') AS sell, count(*) FILTER (op = 'NR') AS other, count(*) FILTER (target > before) AS raised, count(*) FILTER (target < before) AS lowered, arg_max(broker, row(report_date, id, broker)) AS latest_broker,
  round((avg(target) / (1000.0 * (1 + instrument_id)) - 1) * 100, 4) AS upside_pct
FROM l LEFT JOIN b USING (instrument_id, broker) GROUP BY instrument_id""")
def n18(spark, sf):
    rows = reports(spark, sf)
    k = F.substring("opinion", 1, 1)
    rows = rows.withColumn("opinion", F.when(k == "1", "Buy").when(k == "2", "비중 확대").when(k == "3", "Neutral").when(k == "4", "Reduce").otherwise("NR"))
    prev = rows.select("instrument_id").distinct().withColumn("prev_close", (F.col("instrument_id") + 1) * F.lit(1000.0))
    out = nw.analyst_summary(rows, "1997-07-01", prev)
    return out.select("instrument_id", "reports", "brokers", rounded("avg_target", 4).alias("avg_target"), "target_brokers", "buy", "hold", "sell", "other", "raised", "lowered", "latest_broker",
                      rounded("upside_pct", 4).alias("upside_pct"))


BAND = "CASE WHEN sentiment >= 0.6 THEN 'good' WHEN sentiment >= 0.2 THEN 'rather good' WHEN sentiment <= -0.6 THEN 'bad' WHEN sentiment <= -0.2 THEN 'rather bad' ELSE 'mixed' END"
KIND_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in nw.KINDS.items()) + " ELSE 'other' END"


@query("n19_plain_events", "titled, reading", f"""
SELECT filing_id AS id, 'DART' AS source, CASE WHEN subsidiary THEN 'subsidiary ' ELSE '' END || {KIND_CASE} AS plain_kind, CASE WHEN sentiment > 0 THEN CASE WHEN subsidiary THEN 'rather good' ELSE 'good' END
   WHEN sentiment < 0 THEN CASE WHEN subsidiary THEN 'rather bad' ELSE 'bad' END ELSE 'mixed' END AS verdict FROM titled WHERE event_type IS NOT NULL
UNION ALL SELECT item_id, 'NEWS', {KIND_CASE}, {BAND} FROM reading WHERE source = 'NEWS'""")
def n19(spark, sf):
    filed = nw.classify_titles(titles(spark, sf)).where("event_type IS NOT NULL").select(F.col("filing_id").alias("id"), F.lit("DART").alias("source"), "event_type", "sentiment", "subsidiary")
    read = overlay_readings(spark, sf).where("source = 'NEWS'").select(F.col("item_id").alias("id"), "source", "event_type", "sentiment", F.lit(False).alias("subsidiary"))
    return nw.explain_events(filed.unionByName(read)).select("id", "source", "plain_kind", "verdict")


@query("n20_brief_events", "titled, clus", """
WITH m AS (SELECT i AS instrument_id, i % 3 = 0 AS has FROM range(40) t(i)), s AS (SELECT instrument_id, lead_id, event_type, CASE WHEN lead_id % 2 = 0 THEN 'DART' ELSE 'NEWS' END AS lead_source FROM clus)
SELECT t.instrument_id, t.filing_id AS lead_id, 'DART' AS lead_source, t.event_type, CAST(0 AS BIGINT) AS section FROM titled t JOIN m USING (instrument_id) WHERE m.has AND t.event_type IS NOT NULL AND t.filing_id NOT IN (SELECT lead_id FROM s WHERE lead_source = 'DART')
UNION ALL SELECT s.instrument_id, s.lead_id, s.lead_source, s.event_type, 1 FROM s JOIN m USING (instrument_id)""")
def n20(spark, sf):
    filed = nw.classify_titles(titles(spark, sf)).where("event_type IS NOT NULL")
    flag = F.when(F.col("instrument_id") % 3 == 0, F.array(F.lit("DISCLOSURE_EVENT"))).otherwise(F.array().cast("array<string>"))
    members = titles(spark, sf).select("instrument_id").distinct().withColumn("reasons", flag)
    shown = cluster_rows(spark, sf).select("instrument_id", "lead_id", "event_type", F.when(F.col("lead_id") % 2 == 0, "DART").otherwise("NEWS").alias("lead_source"))
    return nw.brief_events(members, filed, shown).select("instrument_id", "lead_id", "lead_source", "event_type", F.col("section").cast("long").alias("section"))


@query("n21_theme_day", "", """
SELECT source AS theme, count(*) AS articles, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents WHERE doc_id % 30 = (SELECT max(doc_id % 30) FROM documents) GROUP BY 1""")
def n21(spark, sf):
    """Themes of the newest stored day, most articles first."""
    rows = load(spark, sf, "documents").select((F.col("doc_id") % 30).alias("day"), F.col("source").alias("theme"), "n_chars")
    newest = rows.agg(F.max("day").alias("day"))
    return rows.join(newest, "day", "left_semi").groupBy("theme").agg(F.count(F.lit(1)).alias("articles"), F.sum("n_chars").alias("chars")).orderBy(F.col("articles").desc(), "theme")
