"""News relevance, event overlays, surge discovery, search attention and analyst summaries."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from knownat.functions.numeric import sign
from knownat.operators import names as nm

# ------------------------------------------------------------------ names in articles


def judge_articles(articles: DataFrame, registry: DataFrame) -> DataFrame:
    """Verdicts of (news_item_id, title, summary) on registered names; see :func:`knownat.operators.names.judged`."""
    return nm.judged(articles, registry, ["news_item_id"])


def mention_counts(verdicts: DataFrame, *, by: Sequence[str] = (), generic: Sequence[int] = (), top: int = 8) -> DataFrame:
    """Confirmed, not weakly, once per article; generic names out; the most mentioned names (of each group of ``by``)."""
    sure = verdicts.where((F.col("decision") == "CONFIRMED") & ~F.col("decision_reason").startswith("weak"))
    if generic:
        sure = sure.where(~F.col("instrument_id").isin(*generic))
    counted = sure.dropDuplicates([*by, "news_item_id", "instrument_id"]).groupBy(*by, "instrument_id").agg(F.count(F.lit(1)).alias("articles"))
    order = [F.col("articles").desc(), "instrument_id"]
    if not by:
        return counted.orderBy(*order).limit(top)
    return counted.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("place") <= top)


def theme_articles(found: DataFrame) -> DataFrame:
    """One row per theme and address: the newest (theme, url, published_at, news_item_id, title, summary), ties by the smaller id."""
    newest = F.max_by(F.struct("news_item_id", "title", "summary", "published_at"), F.struct("published_at", -F.col("news_item_id"))).alias("_r")
    return found.where("url IS NOT NULL").groupBy("theme", "url").agg(newest).select("theme", "url", "_r.*")


def theme_days(found: DataFrame, registry: DataFrame, *, generic: Sequence[int] = (), headlines: int = 5, top: int = 8) -> DataFrame:
    """Per theme: articles without repeated addresses, the newest headlines with a web address, and the names they mention most.

    An article found under several themes is judged once.  Rows: theme, articles, kind (HEADLINE or MENTION), place, key (address or
    instrument), count (of articles, for names).  Both lists are cut by a ranked window, which limits before the shuffle.
    """
    rows = theme_articles(found)
    verdicts = judge_articles(rows.select("news_item_id", "title", "summary").dropDuplicates(["news_item_id"]), registry)
    said = rows.select("theme", "news_item_id").join(verdicts, "news_item_id")
    counted = mention_counts(said, by=["theme"], generic=generic, top=top)
    web = rows.where(F.lower("url").rlike("^https?://"))
    place = F.row_number().over(W.partitionBy("theme").orderBy(F.col("published_at").desc(), "news_item_id"))
    newest = web.withColumn("place", place).where(F.col("place") <= headlines)
    lists = newest.select("theme", F.lit("HEADLINE").alias("kind"), "place", F.col("url").alias("key"), F.lit(None).cast("long").alias("count")).unionByName(
        counted.select("theme", F.lit("MENTION").alias("kind"), "place", F.col("instrument_id").cast("string").alias("key"), F.col("articles").alias("count")))
    totals = rows.groupBy("theme").agg(F.count(F.lit(1)).alias("articles"))
    return totals.join(lists, "theme", "left")


def name_shape(name: Column | str) -> Column:
    flat = F.regexp_replace(F.col(name) if isinstance(name, str) else name, r"\s+", "")
    size = F.when(F.length(flat) < 4, F.length(flat).cast("string")).otherwise("4+")
    return (
        F.when(flat.rlike("^[A-Za-z0-9]+$"), F.concat(F.lit("latin "), size))
        .when(flat.rlike("^[가-힣]+$"), F.concat(F.lit("hangul "), size)).otherwise("mixed")
    )


def agreement(audits: DataFrame) -> DataFrame:
    """How often a model agreed with rule confirmations, by name shape and by reason prefix."""
    kinds = F.array(
        F.struct(F.lit("shape").alias("kind"), name_shape("name").alias("key")),
        F.struct(F.lit("reason").alias("kind"), F.substring_index("rule_reason", ":", 1).alias("key")),
    )
    count = lambda v: F.count(F.when(F.col("model_verdict") == v, 1))
    out = audits.select("model_verdict", F.explode(kinds).alias("_k")).groupBy("_k.kind", "_k.key").agg(
        F.count(F.lit(1)).alias("audited"), count("CONFIRMED").alias("confirmed"), count("REJECTED").alias("rejected"), count("UNSURE").alias("unsure"))
    return out.withColumn("precision", F.try_divide(F.col("confirmed"), F.col("confirmed") + F.col("rejected")))


def reject_report(hits: DataFrame, keys: Sequence[str], *, top: int = 20) -> DataFrame:
    """Reject share per query ranked by its Wilson lower bound, and the two companion lists."""
    z = 1.96
    n, r = F.col("evaluated"), F.col("rejected")
    p = r / n
    floor = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    count = lambda d: F.count(F.when(F.col("decision") == d, 1))
    per = hits.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("evaluated"), count("CONFIRMED").alias("matched"), count("REJECTED").alias("rejected"), count("PENDING").alias("pending")
    ).withColumn("reject_floor", floor)
    lists = {
        "highest reject rate": (F.col("rejected") > 0, [F.col("reject_floor").desc(), F.col("rejected").desc()]),
        "most mentions with no reject": ((F.col("matched") > 0) & (F.col("rejected") == 0), [F.col("matched").desc()]),
        "most pending": (F.col("pending") > 0, [F.col("pending").desc()]),
    }
    out = None
    for title, (keep, order) in lists.items():
        part = per.where(keep).orderBy(*order, *keys).limit(top).withColumn("list", F.lit(title))
        out = part if out is None else out.unionByName(part)
    return out


def fair_selection(hits: DataFrame, limit: int, now: Column, *, recent_hours: int = 72) -> DataFrame:
    """Newest of every instrument in turn, recent articles before old ones, cut at ``limit``.

    An instrument can contribute at most ``limit`` rows of a tier, so the per-instrument depth is limited
    before the shuffle and a hot instrument sends no more than that.
    """
    tier = F.when(F.col("available_at") >= F.timestamp_add("HOUR", F.lit(-recent_hours), now), 0).otherwise(1)
    w = W.partitionBy("tier", "instrument_id").orderBy(F.col("available_at").desc(), "hit_id")
    deep = hits.withColumn("tier", tier).withColumn("depth", F.row_number().over(w)).where(F.col("depth") <= limit)
    first = hits.withColumn("tier", tier).groupBy("tier", "instrument_id").agg(F.max("available_at").alias("_newest"))
    ordered = deep.join(first, ["tier", "instrument_id"])
    return ordered.orderBy("tier", "depth", F.col("_newest").desc(), "instrument_id").limit(limit).drop("_newest")


# ------------------------------------------------------------------ filing titles

# Phrases in rule order with event type, direction (None: undecided) and strength.
TITLE_RULES: tuple[tuple[tuple[str, ...], str, float | None, float], ...] = (
    (("자기주식취득신탁계약해지",), "SHAREHOLDER_RETURN", -0.3, 0.3),
    (("자기주식취득신탁계약체결",), "SHAREHOLDER_RETURN", 0.5, 0.5),
    (("자기주식취득결정",), "SHAREHOLDER_RETURN", 0.6, 0.6),
    (("주식소각결정",), "SHAREHOLDER_RETURN", 0.6, 0.6),
    (("현금현물배당결정", "현금배당결정"), "SHAREHOLDER_RETURN", 0.3, 0.3),
    (("유무상증자결정",), "CAPITAL_RAISE", -0.3, 0.5),
    (("무상증자결정",), "SHAREHOLDER_RETURN", 0.3, 0.4),
    (("기업가치제고계획",), "SHAREHOLDER_RETURN", 0.3, 0.3),
    (("자기주식처분결정", "자기전환사채매도결정"), "CAPITAL_RAISE", -0.3, 0.3),
    (("단일판매공급계약해지",), "ORDER_CONTRACT", -0.5, 0.5),
    (("단일판매공급계약체결",), "ORDER_CONTRACT", 0.5, 0.5),
    (("거래처와의거래중단",), "ORDER_CONTRACT", -0.5, 0.5),
    (("유상증자결정",), "CAPITAL_RAISE", -0.5, 0.6),
    (("전환사채권발행결정", "신주인수권부사채권발행결정", "교환사채권발행결정"), "CAPITAL_RAISE", -0.4, 0.5),
    (("감자결정",), "CAPITAL_RAISE", -0.5, 0.5),
    (("파산신청기각",), "LEGAL_REGULATORY", None, 0.4),
    (("횡령배임", "불성실공시법인지정", "상장적격성실질심사", "관리종목지정", "감사의견거절", "회생절차개시신청", "부도발생", "상장폐지"),
     "LEGAL_REGULATORY", -0.8, 0.9),
    (("파산신청",), "LEGAL_REGULATORY", -0.6, 0.7),
    (("소송등의제기",), "LEGAL_REGULATORY", -0.3, 0.4),
    (("소송등의판결",), "LEGAL_REGULATORY", None, 0.4),
    (("회사합병결정", "회사분할합병결정", "회사분할결정", "주식교환이전결정", "영업양수결정", "영업양도결정", "타법인주식및출자증권취득결정",
      "타법인주식및출자증권처분결정", "유형자산양수결정", "유형자산양도결정", "유형자산취득결정", "유형자산처분결정"), "MERGER_ACQUISITION", None, 0.5),
    (("잠정실적", "매출액또는손익구조"), "EARNINGS", None, 0.5),
    (("최대주주변경", "경영권변경등에관한계약체결"), "MANAGEMENT", None, 0.4),
    (("대표이사변경",), "MANAGEMENT", None, 0.2),
    (("투자판단관련주요경영사항",), "OTHER", None, 0.3),
)
NOT_EVENTS = ("결과보고서", "상황보고서", "거래정지해제")
SUBSIDIARY = ("자회사의주요경영사항", "종속회사의주요경영사항")
RULE_CONFIDENCE = 0.8


def classify_titles(filings: DataFrame, title: str = "report_nm") -> DataFrame:
    """Event of a filing title: first phrase in rule order; corrections and status reports are no events.

    Adds ``phrase, event_type, sentiment, intensity, subsidiary`` (all null when no event).  The rule table is
    constant, so this stays one projection.
    """
    t = F.col(title)
    tag = F.regexp_extract(t, r"^\s*(\[[^\]]*\])", 1)
    flat = F.regexp_replace(F.regexp_replace(t, r"^\s*\[[^\]]*\]", ""), r"[\s·ㆍ‧・()]+", "")
    staged = filings.withColumn("_flat", flat)
    f = F.col("_flat")
    none = tag.contains("정정")
    for n in NOT_EVENTS:
        none = none | f.contains(n)
    table = [(p, e, s, i) for phrases, e, s, i in TITLE_RULES for p in phrases]
    chain = F.when(none, F.lit(None).cast("int"))
    for k, (phrase, *_rest) in enumerate(table):
        chain = chain.when(f.contains(phrase), F.lit(k + 1))
    staged = staged.withColumn("_k", chain)

    def column(at: int, kind: str) -> Column:
        return F.element_at(F.array(*[F.lit(row[at]).cast(kind) for row in table]), F.col("_k"))

    sub = F.lit(False)
    for s in SUBSIDIARY:
        sub = sub | f.contains(s)
    hit = F.col("_k").isNotNull()
    return staged.withColumns({
        "phrase": F.when(hit, column(0, "string")), "event_type": F.when(hit, column(1, "string")),
        "sentiment": F.when(hit, column(2, "double")),
        "subsidiary": F.when(hit, sub),
        "intensity": F.when(hit, column(3, "double") * F.when(sub, 0.5).otherwise(1.0)),
    }).drop("_flat", "_k")


def strongest_intensity(classified: DataFrame) -> DataFrame:
    return classified.where("event_type IS NOT NULL").groupBy("instrument_id").agg(F.max("intensity").alias("intensity"))


def reaction_key(classified: DataFrame) -> DataFrame:
    """Detail key (phrase, subsidiary marked) and group key (type and direction) of an event."""
    way = F.when(sign("sentiment") > 0, "up").when(sign("sentiment") < 0, "down").otherwise("mixed")
    return classified.where("event_type IS NOT NULL").withColumns({
        "detail": F.concat("phrase", F.when(F.col("subsidiary"), "|자회사").otherwise("")),
        "kind": F.concat_ws("|", "event_type", way),
    })


def direction_band(sentiment: Column | str) -> Column:
    """Plain verdict of a news direction: bands at 0.2 and 0.6."""
    s = F.col(sentiment) if isinstance(sentiment, str) else sentiment
    return (
        F.when(s >= 0.6, "good").when(s >= 0.2, "rather good").when(s <= -0.6, "bad").when(s <= -0.2, "rather bad").otherwise("mixed")
    )


# Plain names of the event types.
KINDS = {
    "EARNINGS": "earnings", "GUIDANCE": "outlook", "ORDER_CONTRACT": "order or contract", "CAPITAL_RAISE": "new shares or bonds",
    "SHAREHOLDER_RETURN": "shareholder return", "MERGER_ACQUISITION": "merger or sale", "LEGAL_REGULATORY": "law or regulation",
    "MANAGEMENT": "management", "PRODUCT": "product", "ANALYST_RATING": "broker opinion", "INDUSTRY": "industry", "PRICE_MOVE": "price move",
    "OTHER": "other",
}


def explain_events(events: DataFrame) -> DataFrame:
    """Plain kind and verdict: filings by their title rule (softened for subsidiaries), news by its direction."""
    kinds = F.create_map(*[v for k, n in KINDS.items() for v in (F.lit(k), F.lit(n))])
    kind = F.coalesce(F.try_element_at(kinds, F.col("event_type")), F.lit("other"))
    filing = F.when(F.col("sentiment") > 0, "good").when(F.col("sentiment") < 0, "bad").otherwise("mixed")
    soft = F.when(F.col("subsidiary") & (filing == "good"), "rather good").when(F.col("subsidiary") & (filing == "bad"), "rather bad").otherwise(filing)
    is_filing = F.col("source") == "DART"
    return events.withColumns({
        "plain_kind": F.when(is_filing & F.col("subsidiary"), F.concat(F.lit("subsidiary "), kind)).otherwise(kind),
        "verdict": F.when(is_filing, soft).otherwise(direction_band("sentiment")),
        "verdict_source": F.when(is_filing, "title rule").otherwise("article reading"),
    })


def brief_events(members: DataFrame, filings: DataFrame, shown: DataFrame) -> DataFrame:
    """Events of list members: filings behind the list reason that are not already shown, then the shown ones."""
    reason = members.where(F.array_contains("reasons", "DISCLOSURE_EVENT")).select("instrument_id")
    dart = shown.where("lead_source = 'DART'").select(F.col("lead_id").alias("filing_id"))
    fresh = filings.join(reason, "instrument_id", "left_semi").join(dart, "filing_id", "left_anti").select(
        "instrument_id", F.col("filing_id").alias("lead_id"), F.lit("DART").alias("lead_source"), "event_type", F.lit(0).alias("section"))
    kept = shown.join(members.select("instrument_id"), "instrument_id", "left_semi").select(
        "instrument_id", "lead_id", "lead_source", "event_type", F.lit(1).alias("section"))
    return fresh.unionByName(kept)


# ------------------------------------------------------------------ overlay

# Half-lives in hours per event type.
HALF_LIVES = {
    "PRICE_MOVE": 24, "OTHER": 24, "INDUSTRY": 48, "PRODUCT": 72, "MANAGEMENT": 72, "ANALYST_RATING": 72, "EARNINGS": 120,
    "GUIDANCE": 120, "SHAREHOLDER_RETURN": 120, "ORDER_CONTRACT": 168, "CAPITAL_RAISE": 168, "LEGAL_REGULATORY": 168,
    "MERGER_ACQUISITION": 240,
}
HORIZON, CLUSTER_HOURS, MIN_CONFIDENCE, MAX_POINTS = 6, 24, 0.3, 10.0
LOOKBACK_HOURS = max(HALF_LIVES.values()) * HORIZON


def half_life(event_type: Column | str) -> Column:
    table = F.create_map(*[v for k, h in HALF_LIVES.items() for v in (F.lit(k), F.lit(float(h)))])
    c = F.col(event_type) if isinstance(event_type, str) else event_type
    return F.coalesce(F.try_element_at(table, c), F.lit(float(HALF_LIVES["OTHER"])))


#: Seconds of a bitmap block, as many as Spark's bitmaps hold.
_BLOCK = 32_768


def cluster_anchors(instants: DataFrame, keys: Sequence[str], *, window_hours: int = CLUSTER_HOURS) -> DataFrame:
    """Start of every cluster: the first instant, then the first more than the window after the last start.

    ``instants`` carries ``_t`` in whole seconds.  A block of 32,768 seconds is one bitmap of 4 KB, filled on the map side, so what meets
    for a key is bounded by the time it spans (660 KB for the overlay's 60 days), not by its instants.  A block takes the anchor before it
    to the anchor after it: the first set second past the window, again and again, which is looked up in the bitmap; blocks without one
    pass the anchor on.
    """
    width = window_hours * 3600
    place = F.pmod("_t", F.lit(_BLOCK))
    blocks = instants.groupBy(*keys, F.floor(F.col("_t") / _BLOCK).cast("long").alias("_block")).agg(F.bitmap_construct_agg(place).alias("_bits"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in instants.select(*keys).schema.fields)

    def chain(table: pa.Table) -> pa.Table:
        table = table.sort_by("_block")
        anchors: list[int] = []
        for block, bits in zip(table["_block"].to_pylist(), table["_bits"]):
            seconds = np.flatnonzero(np.unpackbits(np.frombuffer(bits.as_buffer(), np.uint8), bitorder="little")) + block * _BLOCK
            at = np.searchsorted(seconds, anchors[-1] + width, side="right") if anchors else 0
            while at < len(seconds):
                anchors.append(int(seconds[at]))
                at = np.searchsorted(seconds, anchors[-1] + width, side="right")
        return table.select(list(keys)).slice(0, 1).append_column("anchors", pa.array([anchors], pa.list_(pa.int64())))

    return blocks.groupBy(*keys).applyInArrow(chain, f"{kinds}, anchors array<long>")


#: Sums of this type do not depend on the order of their rows.
EXACT = "decimal(24,12)"


def clusters(readings: DataFrame, asof: Column, *, keys: Sequence[str] = ("instrument_id", "event_type")) -> DataFrame:
    """Event clusters usable at ``asof`` with direction, strength, decay, contribution and lead article.

    Readings are folded to one row per key and second before they are shuffled; each folded row then looks its cluster start up in at
    most 61 anchors.
    """
    now = F.unix_seconds(asof)
    t = F.unix_seconds("available_at")
    usable = readings.where(
        (F.col("confidence") >= MIN_CONFIDENCE) & (F.col("available_at") <= asof) & (now - t <= LOOKBACK_HOURS * 3600)
    ).withColumn("_t", t)
    pointed = F.col("directional")
    weight = F.col("intensity") * F.col("confidence")
    lead = F.struct(weight.alias("w"), (-F.col("item_id")).alias("i"), F.col("source").alias("s"))
    by_second = usable.groupBy(*keys, "_t").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(pointed, (F.col("sentiment") * F.col("confidence")).cast(EXACT))).alias("sc"),
        F.sum(F.when(pointed, F.col("confidence").cast(EXACT))).alias("c"),
        F.max("intensity").alias("intensity"),
        F.max(F.when(pointed, F.col("confidence"))).alias("confidence"),
        F.max(F.when(F.col("source") == "NEWS", lead)).alias("news"),
        F.max(lead).alias("any"),
    )
    anchors = cluster_anchors(by_second.select(*keys, "_t"), keys)
    placed = by_second.join(anchors, list(keys)).withColumn("_a", F.array_max(F.filter("anchors", lambda a: a <= F.col("_t"))))
    grouped = placed.groupBy(*keys, "_a").agg(
        F.sum("n").alias("articles"), F.sum("sc").alias("_sc"), F.sum("c").alias("_c"), F.max("intensity").alias("intensity"),
        F.coalesce(F.max("confidence"), F.lit(0.0)).alias("confidence"), F.coalesce(F.max("news"), F.max("any")).alias("_lead"),
    )
    age = (now - F.col("_a")) / 3600.0
    hl = half_life("event_type")
    kept = grouped.where(age <= hl * HORIZON)
    sentiment = F.when(F.col("_c") > 0, F.col("_sc").cast("double") / F.col("_c").cast("double")).otherwise(0.0)
    decay = F.pow(F.lit(0.5), age / hl)
    return kept.select(
        *keys, F.timestamp_seconds("_a").alias("first_at"), "articles", sentiment.alias("sentiment"), "intensity", "confidence",
        decay.alias("decay"), (sentiment * F.col("intensity") * F.col("confidence") * decay).alias("contribution"),
        (-F.col("_lead.i")).alias("lead_id"), F.col("_lead.s").alias("lead_source"),
    )


def overlay(cluster_rows: DataFrame) -> DataFrame:
    """Points per instrument: 10 tanh of the summed contributions."""
    return cluster_rows.groupBy("instrument_id").agg(
        F.sum("contribution").alias("raw"), F.count(F.lit(1)).alias("events"), F.sum("articles").alias("readings_used")
    ).withColumn("points", F.tanh("raw") * MAX_POINTS)


def top_clusters(cluster_rows: DataFrame, limit: int = 10) -> DataFrame:
    w = W.partitionBy("instrument_id").orderBy(F.abs("contribution").desc(), "event_type", "first_at")
    return cluster_rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


# ------------------------------------------------------------------ discovery and attention

def covered_days(intervals: DataFrame, windows: dict[str, tuple[Column, Column]], keys: Sequence[str] = ("instrument_id",)) -> DataFrame:
    """Length in days of the union of read intervals inside each named window.

    Intervals are cut at hour borders, and each hour keeps only its farthest end per start second, so no
    task sees more than 3,600 rows of one key and hour; hours are disjoint, so their unions just add up.
    """
    parts = F.array(*[
        F.struct(F.lit(n).alias("window"), F.unix_micros(F.greatest("lo", a)).alias("lo"), F.unix_micros(F.least("hi", b)).alias("hi"))
        for n, (a, b) in windows.items()
    ])
    cut = intervals.select(*keys, F.explode(parts).alias("_w")).select(*keys, "_w.*").where("hi > lo")
    hour = 3_600_000_000
    first, last = F.floor(F.col("lo") / hour), F.floor((F.col("hi") - 1) / hour)
    pieces = cut.select(*keys, "window", "lo", "hi", F.explode(F.sequence(first, last)).alias("_h")).select(
        *keys, "window", "_h", F.greatest("lo", F.col("_h") * hour).alias("lo"), F.least("hi", (F.col("_h") + 1) * hour).alias("hi"))
    folded = pieces.groupBy(*keys, "window", "_h", "lo").agg(F.max("hi").alias("hi"))
    w = W.partitionBy(*keys, "window", "_h").orderBy("lo").rowsBetween(W.unboundedPreceding, -1)
    gain = F.greatest(F.lit(0), F.col("hi") - F.greatest(F.col("lo"), F.coalesce(F.max("hi").over(w), F.col("lo"))))
    return folded.withColumn("_g", gain).groupBy(*keys, "window").agg((F.sum("_g") / F.lit(86_400_000_000.0)).alias("days"))


def merged_intervals(intervals: DataFrame, keys: Sequence[str] = ("instrument_id",), *, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Disjoint union of closed intervals per key, touching ones joined.

    First within a day: intervals are cut at midnight and only rows of one key and day meet.  What lies strictly inside its day is done; the
    at most two islands of a day that touch midnight, and those of the next days they touch, are joined in a second pass that sees no more
    than two rows a day however many intervals a key has.
    """
    day = 86_400_000_000
    spans = intervals.select(*keys, F.unix_micros(lo).alias("_lo"), F.unix_micros(hi).alias("_hi")).where("_hi >= _lo")
    cut = spans.withColumn("_d", F.explode(F.sequence(F.floor(F.col("_lo") / day), F.floor(F.col("_hi") / day))))
    cut = cut.select(*keys, "_d", F.greatest("_lo", F.col("_d") * day).alias("_lo"), F.least("_hi", (F.col("_d") + 1) * day).alias("_hi"))
    within = _islands(cut, [*keys, "_d"])
    touches = (F.col("_lo") == F.col("_d") * day) | (F.col("_hi") == (F.col("_d") + 1) * day)
    across = _islands(within.where(touches).drop("_d"), keys)
    out = within.where(~touches).drop("_d").unionByName(across)
    return out.select(*keys, F.timestamp_micros("_lo").alias(lo), F.timestamp_micros("_hi").alias(hi))


def _islands(spans: DataFrame, by: Sequence[str]) -> DataFrame:
    """Unions of the closed spans (_lo, _hi) of each group."""
    folded = spans.groupBy(*by, "_lo").agg(F.max("_hi").alias("_hi"))
    w = W.partitionBy(*by).orderBy("_lo")
    reach = F.max("_hi").over(w.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("_lo") > reach), 1).otherwise(0)
    island = folded.withColumn("_new", fresh).withColumn("_i", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return island.groupBy(*by, "_i").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi")).drop("_i")


def inside_any(moments: DataFrame, intervals: DataFrame, at: str, keys: Sequence[str] = ("instrument_id",)) -> DataFrame:
    """Flag moments that fall in some interval (closed at both ends).

    Both sides are bucketed by hour, so the join key is (key, hour) and the range test is local to it; an
    hour of one key keeps at most one interval per start instant.
    """
    hour = 3_600_000_000
    spans = intervals.select(*keys, F.unix_micros("lo").alias("_lo"), F.unix_micros("hi").alias("_hi"))
    cut = spans.select(*keys, "_lo", "_hi", F.explode(F.sequence(F.floor(F.col("_lo") / hour), F.floor(F.col("_hi") / hour))).alias("_h"))
    cut = cut.select(*keys, "_h", F.greatest("_lo", F.col("_h") * hour).alias("_t"), F.least("_hi", (F.col("_h") + 1) * hour - 1).alias("_end"))
    starts = cut.groupBy(*keys, "_h", "_t").agg(F.max("_end").alias("_end")).withColumn("_ask", F.lit(0))
    asked = moments.withColumns({"_t": F.unix_micros(at), "_ask": F.lit(1)}).withColumn("_h", F.floor(F.col("_t") / hour))
    merged = asked.unionByName(starts, allowMissingColumns=True)
    w = W.partitionBy(*keys, "_h").orderBy("_t", "_ask").rowsBetween(W.unboundedPreceding, 0)
    reach = F.max("_end").over(w)
    flagged = merged.withColumn("inside", F.coalesce(reach >= F.col("_t"), F.lit(False))).where("_ask = 1")
    return flagged.select(*moments.columns, "inside")


MIN_RECENT, MIN_RECENT_DAYS, MIN_BASELINE_DAYS, TOP = 3, 0.25, 1.0, 20


def discover(mentions: DataFrame, coverage: DataFrame, asof: Column, *, window_hours: int = 24, baseline_days: int = 14, top: int = TOP) -> DataFrame:
    """Surge of mentions in the last day over the two weeks before, per day actually read.

    Names with too few recent mentions are not looked at; names read for too short are ``unmeasured``.
    """
    start = F.timestamp_add("HOUR", F.lit(-window_hours), asof)
    base = F.timestamp_add("DAY", F.lit(-baseline_days), start)
    rows = mentions.where((F.col("available_at") > base) & (F.col("available_at") <= asof))
    seen = inside_any(rows.select("instrument_id", "available_at"), _clip_each(coverage, base, start, asof), "available_at")
    recent = F.col("available_at") > start
    counts = seen.groupBy("instrument_id").agg(
        F.count(F.when(recent, 1)).alias("_recent_any"), F.count(F.when(recent & F.col("inside"), 1)).alias("recent"),
        F.count(F.when(~recent & F.col("inside"), 1)).alias("baseline"),
    ).where(F.col("_recent_any") >= MIN_RECENT)
    days = covered_days(coverage, {"recent": (start, asof), "baseline": (base, start)})
    wide = days.groupBy("instrument_id").agg(
        *[F.coalesce(F.max(F.when(F.col("window") == n, F.col("days"))), F.lit(0.0)).alias(f"{n}_days") for n in ("recent", "baseline")])
    joined = counts.join(wide, "instrument_id", "left").fillna(0.0, ["recent_days", "baseline_days"])
    measured = (F.col("recent_days") >= MIN_RECENT_DAYS) & (F.col("baseline_days") >= MIN_BASELINE_DAYS)
    expected = F.col("baseline") / F.col("baseline_days") * F.col("recent_days")
    scored = joined.withColumns({
        "status": F.when(~measured, "UNMEASURED").when(F.col("recent") < MIN_RECENT, "THIN").otherwise("RANKED"),
        "expected": F.when(measured, expected), "score": F.when(measured, (F.col("recent") + 1.0) / (expected + 1.0)),
    }).drop("_recent_any")
    w = W.partitionBy("status").orderBy(F.col("score").desc(), F.col("recent").desc(), "instrument_id")
    ranked = scored.where("status = 'RANKED'").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return ranked.unionByName(scored.where("status = 'UNMEASURED'").withColumn("rank", F.lit(None).cast("int")))


def _clip_each(coverage: DataFrame, base: Column, start: Column, asof: Column) -> DataFrame:
    """Intervals cut to each of the two windows, so a baseline interval never vouches for a recent mention."""
    parts = F.array(
        F.struct(F.greatest("lo", base).alias("lo"), F.least("hi", start).alias("hi")),
        F.struct(F.greatest("lo", start).alias("lo"), F.least("hi", asof).alias("hi")),
    )
    return coverage.select("instrument_id", F.explode(parts).alias("_p")).select("instrument_id", "_p.*").where("hi > lo")


RECENT_SESSIONS, BASELINE_SESSIONS = 3, 20


def attention(series: DataFrame, fetches: DataFrame, sessions: DataFrame, spine: DataFrame) -> DataFrame:
    """Search interest of the last 3 sessions over the 20 before, a missing day counting as 0.

    ``fetches``: instrument_id, start_date, end_date, yesterday (one newest fetch each, or null dates);
    ``series``: instrument_id, day, ratio.  Dates are placed on the calendar by equality with its day spine.
    """
    need = RECENT_SESSIONS + BASELINE_SESSIONS
    last = F.least("end_date", "yesterday")
    sess = sessions.select("day", "ordinal")
    at_last = spine.select(F.col("day").alias("_last"), F.col("ordinal_upto").alias("_hi"), F.col("on_or_before").alias("_newest"))
    at_start = spine.select(F.col("day").alias("start_date"), (F.col("ordinal_upto") + F.when(F.col("is_session"), 0).otherwise(1)).alias("_lo"))
    today = spine.select(F.col("day").alias("yesterday"), F.col("on_or_before").alias("_m"))
    state = (
        fetches.withColumn("_last", F.when(F.col("end_date").isNotNull(), last)).join(at_last, "_last", "left").join(at_start, "start_date", "left").join(today, "yesterday", "left")
        .withColumn("_market", F.when(F.datediff("yesterday", "_m") <= 14, F.col("_m")))
    )
    status = (
        F.when(F.col("end_date").isNull(), "NO_FETCH").when(F.col("_last") < F.col("start_date"), "UNMEASURED")
        .when(F.col("_market").isNotNull() & (F.col("_newest").isNull() | (F.col("_newest") < F.col("_market"))), "STALE")
        .when(F.col("_lo").isNull() | (F.col("_hi") - F.col("_lo") + 1 < need), "UNMEASURED").otherwise("MEASURED")
    )
    state = state.withColumn("status", status)
    wanted = state.where("status = 'MEASURED'").select("instrument_id", F.col("_hi"), F.explode(F.sequence(F.col("_hi") - (need - 1), F.col("_hi"))).alias("ordinal"))
    valued = wanted.join(sess, "ordinal").join(series, ["instrument_id", "day"], "left")
    age = F.col("_hi") - F.col("ordinal")
    means = valued.groupBy("instrument_id").agg(
        (F.sum(F.when(age < RECENT_SESSIONS, F.coalesce("ratio", F.lit(0.0))).otherwise(0.0)) / RECENT_SESSIONS).alias("recent"),
        (F.sum(F.when(age >= RECENT_SESSIONS, F.coalesce("ratio", F.lit(0.0))).otherwise(0.0)) / BASELINE_SESSIONS).alias("baseline"))
    out = state.select("instrument_id", "status").join(means, "instrument_id", "left")
    return out.withColumn("surge", (F.col("recent") + 1.0) / (F.col("baseline") + 1.0))


# ------------------------------------------------------------------ analysts

# Spellings of broker opinions.
OPINIONS = {
    "BUY": ("buy", "매수", "strongbuy", "적극매수", "outperform", "overweight", "tradingbuy", "단기매수", "비중확대", "accumulate", "add"),
    "HOLD": ("hold", "중립", "neutral", "marketperform", "시장수익률", "시장평균", "보유", "marketweight", "equalweight", "sectorperform"),
    "SELL": ("sell", "매도", "underperform", "underweight", "reduce", "비중축소", "strongsell"),
}


def opinion_label(opinion: Column | str) -> Column:
    flat = F.lower(F.regexp_replace(F.col(opinion) if isinstance(opinion, str) else opinion, r"\s+", ""))
    chain = None
    for label, words in OPINIONS.items():
        chain = F.when(flat.isin(*words), label) if chain is None else chain.when(flat.isin(*words), label)
    return chain.otherwise("OTHER")


def analyst_summary(reports: DataFrame, day, prev_close: DataFrame, *, window_days: int = 90) -> DataFrame:
    """Newest report per broker in the 90 days before ``day`` against that broker's previous target.

    Both are picked by aggregates per (instrument, broker), so no broker's history is sorted in one task.
    """
    day = F.lit(day).cast("date") if isinstance(day, str) else day
    start = F.date_sub(day, window_days)
    order = F.struct(F.datediff("report_date", F.lit("1970-01-01").cast("date")).alias("d"), "id")
    rows = reports.where(F.col("report_date") < day).withColumns({"_o": order, "_in": F.col("report_date") >= start})
    keys = ["instrument_id", "broker"]
    latest = rows.where("_in").groupBy(*keys).agg(
        F.max(F.struct("_o", "opinion", "target")).alias("_l"), F.count(F.lit(1)).alias("_count"))
    before = rows.where("target IS NOT NULL").join(latest.select(*keys, F.col("_l._o").alias("_lo")), keys).where(
        F.col("_o") < F.col("_lo")).groupBy(*keys).agg(F.max_by("target", "_o").alias("_before"))
    joined = latest.join(before, keys, "left").select(*keys, "_count", "_l.*", "_before")
    label = opinion_label("opinion")
    out = joined.groupBy("instrument_id").agg(
        F.sum("_count").alias("reports"), F.count(F.lit(1)).alias("brokers"), F.avg("target").alias("avg_target"), F.count("target").alias("target_brokers"),
        *[F.count(F.when(label == o, 1)).alias(o.lower()) for o in ("BUY", "HOLD", "SELL", "OTHER")],
        F.count(F.when(F.col("target") > F.col("_before"), 1)).alias("raised"), F.count(F.when(F.col("target") < F.col("_before"), 1)).alias("lowered"),
        F.max_by("broker", F.struct("_o", "broker")).alias("latest_broker"),
    )
    upside = (F.try_divide(F.col("avg_target"), F.col("prev_close")) - 1) * 100
    return out.join(prev_close, "instrument_id", "left").withColumn("upside_pct", upside)
