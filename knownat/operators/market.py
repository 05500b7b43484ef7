"""Market regime, breadth, price limits, heavyweights, opening gaps, companions, call usage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from knownat.functions import numeric as num
from knownat.operators import indicators as ind

TREND, MONTH, RANK_WINDOW, HIGH_VOLATILITY, BREADTH = 200, 20, 250, 0.8, 50
HISTORY_NEEDED = RANK_WINDOW + MONTH + 1


def regime(closes: DataFrame, key: str = "instrument_id") -> DataFrame:
    """Trend and turbulence of every (index, session): RISK_ON / RISK_OFF / NEUTRAL, UNKNOWN under 271 closes.

    The volatility rank is strict and against the 249 sessions before, a bounded array per row.
    """
    by_day = W.partitionBy(key).orderBy("day")
    staged = closes.select(key, "day", "close", F.log(F.col("close") / F.lag("close").over(by_day)).alias("_r"),
                           F.row_number().over(by_day).alias("_n"),
                           F.min("close").over(ind.frame(HISTORY_NEEDED, key)).alias("_low"),
                           F.avg("close").over(ind.frame(TREND, key)).alias("_mean"), F.lag("close", MONTH).over(by_day).alias("_then"))
    vol = F.when(F.col("_n") > MONTH, F.stddev_samp("_r").over(ind.frame(MONTH, key)) * F.sqrt(F.lit(252.0)))
    staged = staged.withColumn("volatility", vol)
    past = F.collect_list("volatility").over(by_day.rowsBetween(-(RANK_WINDOW - 1), -1))
    staged = staged.withColumn("_past", past)
    rank = F.aggregate("_past", F.lit(0), lambda a, v: a + F.when(v < F.col("volatility"), 1).otherwise(0)) / F.lit(float(RANK_WINDOW - 1))
    known = (F.col("_n") >= HISTORY_NEEDED) & (F.col("_low") > 0)
    out = staged.withColumns({
        "trend_gap": F.when(known, F.col("close") / F.col("_mean") - 1), "return_20d": F.when(known, F.col("close") / F.col("_then") - 1),
        "volatility_rank": F.when(known, rank), "volatility": F.when(known, F.col("volatility")),
    })
    rising, wild = F.col("trend_gap") > 0, F.col("volatility_rank") >= HIGH_VOLATILITY
    label = F.when(~known, "UNKNOWN").when(rising & ~wild, "RISK_ON").when(~rising & wild, "RISK_OFF").otherwise("NEUTRAL")
    return out.withColumn("label", label).select(key, "day", "close", "trend_gap", "return_20d", "volatility", "volatility_rank", "label")


def breadth(bars: DataFrame) -> DataFrame:
    """Share of names above their own 50-session mean, per session, and how many were measured."""
    mean = ind.sma("close", BREADTH)
    rows = bars.withColumn("_m", mean).where("_m IS NOT NULL")
    return rows.groupBy("day").agg(F.avg(F.when(F.col("close") > F.col("_m"), 1.0).otherwise(0.0)).alias("breadth"), F.count(F.lit(1)).alias("names"))


def index_for(market: Column, listing: Column) -> Column:
    """Index a listing is read against."""
    return F.when(market == "US", "^GSPC").when(listing == "KOSDAQ", "^KQ11").otherwise("^KS11")


def signal_regimes(signals: DataFrame, regimes: DataFrame, sessions: DataFrame, spine: DataFrame) -> DataFrame:
    """Regime of the last session closed by each decision; UNKNOWN if the index bar of that session is not in."""
    place = spine.select(F.col("day").alias("_d"), F.col("on_or_before").alias("_s"))
    hours = sessions.select(F.col("day").alias("_s"), "close_at", "prev_day")
    asked = signals.select("signal_id", "index_code", "decision_at", F.to_date("decision_at").alias("_d"))
    at = asked.join(place, "_d", "left").join(hours, "_s", "left")
    closed = (F.col("_d") > F.col("_s")) | (F.col("close_at") <= F.col("decision_at"))
    resolved = at.select("signal_id", "index_code", F.when(closed, F.col("_s")).otherwise(F.col("prev_day")).alias("day"))
    return resolved.join(regimes, ["index_code", "day"], "left").withColumn("label", F.coalesce("label", F.lit("UNKNOWN")))


def upper_limit(base: Column | str) -> Column:
    """+30 % rounded down to a tick; null for a base that is not itself a whole tick."""
    base = num.col(base)
    whole = base.cast("long")
    raw = F.floor(whole * 13 / 10).cast("long")
    size = num.tick(raw)
    limit = F.floor(raw / size).cast("long") * size
    return F.when((base > 0) & (base == whole) & (whole % num.tick(whole) == 0), limit)


def limit_state(open_: str = "open", high: str = "high", low: str = "low", close: str = "close", base: str = "base") -> Column:
    """LOCKED (every price at the limit), CLOSED at it, TOUCHED it, or null."""
    limit = upper_limit(base)
    lowest = F.least(open_, high, low, close)
    return F.when(lowest >= limit, "LOCKED").when(F.col(close) >= limit, "CLOSED").when(F.col(high) >= limit, "TOUCHED")


def previous_limits(bars: DataFrame, sessions: DataFrame) -> DataFrame:
    """For every session: the previous session's change and limit state, only if its own bar is there.

    The base is the bar before it, at most 60 days back.
    """
    w = W.partitionBy("instrument_id").orderBy("day")
    based = bars.withColumns({"base": F.lag("close").over(w), "_bd": F.lag("day").over(w)})
    usable = based.where((F.col("base") > 0) & (F.datediff("day", "_bd") <= 60))
    nxt = sessions.select("day", F.col("next_day").alias("for_day"))
    return usable.join(nxt, "day").where("for_day IS NOT NULL").select(
        "instrument_id", "for_day", "day", "close", ((F.col("close") / F.col("base") - 1) * 100).alias("change_pct"), limit_state().alias("state"))


HEAVY_MIN, MAX_TABLE_AGE = 5.0, 10


def weight_tables(days: DataFrame, table_days: DataFrame, spine: DataFrame) -> DataFrame:
    """Newest weight table before each day if at most 10 sessions old, else the first on or after it (marked)."""
    known = table_days.select("day").distinct()
    merged = days.select("day", F.lit(1).alias("_ask")).distinct().unionByName(known.select("day", F.lit(0).alias("_ask")))
    table = F.when(F.col("_ask") == 0, F.col("day"))
    # one row per day on either side: bounded by the calendar
    back = W.orderBy("day", F.col("_ask").desc()).rowsBetween(W.unboundedPreceding, -1)
    ahead = W.orderBy("day", F.col("_ask").desc()).rowsBetween(1, W.unboundedFollowing)
    found = merged.withColumns({"_before": F.max(table).over(back), "_after": F.min(table).over(ahead)}).where("_ask = 1")
    ords = spine.select("day", "ordinal_upto")
    aged = found.join(ords, "day", "left").join(ords.select(F.col("day").alias("_before"), F.col("ordinal_upto").alias("_o")), "_before", "left")
    fresh = F.col("_before").isNotNull() & (F.col("ordinal_upto") - F.col("_o") <= MAX_TABLE_AGE)
    return aged.select("day", F.when(fresh, F.col("_before")).otherwise(F.col("_after")).alias("table_day"), (~fresh & F.col("_after").isNotNull()).alias("after_the_fact"))


def heavyweights(weights: DataFrame) -> DataFrame:
    return weights.withColumn("heavyweight", F.coalesce(F.col("weight_pct") >= HEAVY_MIN, F.lit(False)))


GAP_UP_AT, MISMATCH = 3.0, 0.15


def expected_gap(quotes: DataFrame) -> DataFrame:
    """Change the expected open implies, whether it can be trusted, and whether it is a gap up."""
    change = F.when(F.col("expected_price").isNotNull() & (F.col("expected_price") != 0) & (F.col("base_price") > 0), (F.col("expected_price") / F.col("base_price") - 1) * 100)
    off = F.abs(change - F.col("reported_pct"))
    judgeable = F.coalesce((F.col("expected_price") > 0) & (F.col("volume") > 0) & (off <= MISMATCH), F.lit(False))
    return quotes.withColumns({
        "change_pct": change, "judgeable": judgeable, "mismatched": F.coalesce(off > MISMATCH, F.lit(False)),
        "gap_up": F.coalesce(judgeable & (change >= GAP_UP_AT), F.lit(False)),
    })


# ------------------------------------------------------------------ companions

# Prefixes too common to tie names together, and words of things that are no companies.
STOP_PREFIXES = (
    "한국", "대한", "에스", "케이", "아이", "에이", "제이", "와이", "바이", "하이", "유니", "네오", "에코", "이노", "코스", "이지", "디와", "파인", "나노",
    "오리", "넥스", "폴라", "미래", "서울", "우리", "신한", "하나", "동일", "제일", "대성", "동양", "세원", "대원", "한일", "유진", "동국", "삼양", "원익",
    "한솔", "디에", "엘에", "에프", "티에", "피에", "비에", "씨에", "엠에", "지에", "알에", "오에", "브이", "디엔", "엔에", "엘비", "엠씨", "씨앤", "에이치",
    "아이씨", "부산", "대구", "인천", "광주", "대전", "울산", "세종", "경기", "강원", "충북", "충남", "전북", "전남", "경북", "경남", "제주", "경인", "호남",
    "영남", "동부", "서부", "남부", "북부",
)
NOT_STOCKS = ("스팩", "리츠")
GROUP_SIZE = (2, 6)
LEADER_AT, MAX_COMPANIONS = 7.0, 6


def name_prefix(name: Column | str, pattern: str = "^([가-힣]{2})") -> Column:
    """Leading two syllables that may tie a name to a group, or null."""
    name = num.col(name)
    prefix = F.regexp_extract(name, pattern, 1)
    bad = (prefix == "") | prefix.isin(*STOP_PREFIXES)
    for word in NOT_STOCKS:
        bad = bad | name.contains(word)
    return F.when(~bad, prefix)


def name_groups(names: DataFrame, keys: Sequence[str] = (), *, prefix: Column | None = None) -> DataFrame:
    """Pairs of names sharing a prefix, for groups of 2 to 6 members.

    Group sizes are counted first; only groups of at most six reach the self join, so no name meets more
    than five others.
    """
    tagged = names.withColumn("_p", name_prefix("name") if prefix is None else prefix).where("_p IS NOT NULL")
    sizes = tagged.groupBy(*keys, "_p").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n").between(*GROUP_SIZE))
    small = tagged.join(sizes.select(*keys, "_p"), [*keys, "_p"], "left_semi").select(*keys, "_p", "instrument_id")
    other = small.withColumnRenamed("instrument_id", "related_id")
    return small.join(other, [*keys, "_p"]).where(F.col("instrument_id") != F.col("related_id")).select(*keys, "instrument_id", "related_id")


def normalized_name(name: Column | str) -> Column:
    return F.upper(F.regexp_replace(num.col(name), r"\(주\)|주식회사|[\s()（）]", ""))


def resolve_names(asked: DataFrame, master: DataFrame) -> DataFrame:
    """Instrument whose normalised name is unique in the master list, else null."""
    unique = master.select("instrument_id", normalized_name("name").alias("_n")).groupBy("_n").agg(
        F.count(F.lit(1)).alias("_c"), F.max("instrument_id").alias("instrument_id")).where("_c = 1")
    return asked.withColumn("_n", normalized_name("asked_name")).join(unique.drop("_c"), "_n", "left").drop("_n")


def merge_relations(by_name: DataFrame, by_model: DataFrame) -> DataFrame:
    """Name and model relations per leader; an in-batch model answer counts only if the names agree."""
    named = by_name.select("instrument_id", "related_id", F.lit("NAME").alias("source"), F.lit(None).cast("string").alias("reason"), F.lit(False).alias("in_batch"))
    answered = by_model.where("instrument_id <> related_id").select("instrument_id", "related_id", F.lit("AI").alias("source"), "reason", "in_batch")
    both = named.unionByName(answered)
    merged = both.groupBy("instrument_id", "related_id").agg(
        F.sort_array(F.collect_set("source")).alias("sources"), F.max("reason").alias("reason"),
        F.max(F.when(F.col("source") == "NAME", 1).otherwise(0)).alias("_named"),
        F.max(F.when((F.col("source") == "AI") & ~F.col("in_batch"), 1).otherwise(0)).alias("_free"),
    )
    return merged.where("_named = 1 OR _free = 1").drop("_named", "_free")


def newest_answers(answers: DataFrame) -> DataFrame:
    """Relations of the newest ask per instrument."""
    last = answers.groupBy("instrument_id").agg(F.max("ask_id").alias("ask_id"))
    return answers.join(last, ["instrument_id", "ask_id"], "left_semi")


def companions(movers: DataFrame, relations: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Leaders up 7 % or more with their least-risen companions: unpriced last, more sources first, at most six."""
    leaders = movers.where(F.col("change_pct") >= LEADER_AT).select(*keys, F.col("instrument_id"), F.col("change_pct").alias("leader_change"))
    joined = leaders.join(relations, "instrument_id")
    priced = movers.select(*keys, F.col("instrument_id").alias("related_id"), F.col("change_pct").alias("companion_change"))
    joined = joined.join(priced, [*keys, "related_id"], "left")
    w = W.partitionBy(*keys, "instrument_id").orderBy(
        F.col("companion_change").asc_nulls_last(), F.size("sources").desc(), "related_id")
    return joined.withColumn("place", F.row_number().over(w)).where(F.col("place") <= MAX_COMPANIONS)


def ask_targets(movers: DataFrame, listed: DataFrame, asked: DataFrame) -> DataFrame:
    """Recent movers and list members that were not in a batch asked lately."""
    return movers.select("instrument_id").unionByName(listed.select("instrument_id")).distinct().join(asked, "instrument_id", "left_anti")


def minute_targets(alerts: DataFrame, limit: int = 30) -> DataFrame:
    """Names of a day's alerts whose minute bars are fetched, in order: leaders by falling change, each before its companions; every name once.

    ``alerts``: leader_id, companion_id, leader_change.  Rows: instrument_id, place from 1.  A name is folded to its best place before the top
    is taken, so a name of very many alerts is one row.
    """
    ends = F.array(F.struct(F.lit(0).alias("k"), F.col("leader_id").alias("id")), F.struct(F.lit(1).alias("k"), F.col("companion_id").alias("id")))
    at = F.struct((-F.col("leader_change")).alias("c"), F.col("leader_id").alias("l"), F.col("companion_id").alias("m"), F.col("_e.k").alias("k"))
    rows = alerts.where("leader_change IS NOT NULL").withColumn("_e", F.explode(ends)).where("_e.id IS NOT NULL")
    best = rows.groupBy(F.col("_e.id").alias("instrument_id")).agg(F.min(at).alias("_at"))
    top = best.orderBy("_at").limit(limit)
    return top.select("instrument_id", F.row_number().over(W.orderBy("_at")).alias("place"))  # `limit` rows


def mover_alerts(ranking: DataFrame, symbols: DataFrame, relations: DataFrame, *, first: int = 1, last: int = 10) -> DataFrame:
    """One minute's movers to companion rows.

    Rows are taken 1 to 10 minutes after the open and only once something has traded; common shares are ranked
    per market, mapped to instruments and joined to their relations.
    """
    rows = ranking.where(F.col("minute").between(first, last) & F.col("code").rlike("^.{5}0$") & F.col("change_pct").isNotNull())
    traded = rows.groupBy("day", "minute").agg(F.max("volume").alias("_v")).where("_v > 0")
    live = rows.join(traded.drop("_v"), ["day", "minute"], "left_semi")
    w = W.partitionBy("day", "minute", "market").orderBy(F.col("change_pct").desc(), "code")
    ranked = live.withColumn("market_rank", F.row_number().over(w))
    mapped = ranked.join(symbols, "code")
    return companions(mapped, relations, ["day", "minute"]).join(
        mapped.select("day", "minute", "instrument_id", "market_rank"), ["day", "minute", "instrument_id"])


# ------------------------------------------------------------------ call usage

def rolling_usage(buckets: DataFrame, *, minutes: int, cap: int) -> DataFrame:
    """Calls of each quota group in the window before every minute, and room left at half the cap.

    Buckets are one row per (group, minute), so a window holds at most ``minutes`` rows.
    """
    per = buckets.groupBy("quota_group", "minute_start").agg(F.sum("calls").alias("calls"))
    w = W.partitionBy("quota_group").orderBy(F.unix_seconds("minute_start")).rangeBetween(-(minutes * 60 - 1), 0)
    spent = F.sum("calls").over(w)
    return per.select("quota_group", "minute_start", "calls", spent.alias("spent"), F.greatest(F.lit(0), F.lit(cap // 2) - spent).alias("headroom"))
