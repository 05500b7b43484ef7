"""List selection: reasons, order, exclusions, pools, snapshots and promotions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from knownat.functions.scale import ordered_digest

MAX_MEMBERS = 40
OVERLAY_BAND, SEARCH_SURGE = 1.0, 2.0
EXCLUDE_JUDGED_BELOW, EXCLUDE_PREV_SURGE_AT = 40.0, 15.0
EVENT_REASONS = ("DISCOVERY_SURGE", "POSITIVE_NEWS_OVERLAY", "NEGATIVE_NEWS_OVERLAY", "DISCLOSURE_EVENT", "SEARCH_SURGE")


def reasons(version: int = 1) -> Column:
    """Reason codes of a candidate in fixed order; version 2 keeps only the event reasons."""
    c = F.col
    found = [
        F.when(c("discovery_score").isNotNull(), "DISCOVERY_SURGE"),
        F.when(c("overlay_points") >= OVERLAY_BAND, "POSITIVE_NEWS_OVERLAY"),
        F.when(c("overlay_points") <= -OVERLAY_BAND, "NEGATIVE_NEWS_OVERLAY"),
        F.when(c("has_disclosure_event"), "DISCLOSURE_EVENT"),
        F.when(c("search_surge") >= SEARCH_SURGE, "SEARCH_SURGE"),
    ]
    if version == 1:
        found += [F.when(c("tracked") & (c("last_action") == "BUY_INTEREST"), "TRACKED_HIGH_SCORE"), F.when(c("tracked"), "TRACKED")]
    return F.array_compact(F.array(*found))


def exclusions() -> Column:
    """Why a chosen name is shown apart; its rank stays."""
    return F.array_compact(F.array(
        F.when(F.col("judged_score") < EXCLUDE_JUDGED_BELOW, "LOW_SCORE"), F.when(F.col("prev_change") >= EXCLUDE_PREV_SURGE_AT, "PREV_SURGE")))


def select_names(pool: DataFrame, keys: Sequence[str], *, version: int = 1, limit: int | None = MAX_MEMBERS, exclude: bool = False) -> DataFrame:
    """Ranked picks per list, and how many with a reason did not fit.

    Ranking is a row-number limit, so each map task sends at most ``limit`` rows of a list to the shuffle.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    chosen = pool.withColumn("reasons", reasons(version)).where(F.size("reasons") > 0)
    standing = F.size(F.array_remove("reasons", "TRACKED")) if version == 1 else F.size("reasons")
    order = [standing.desc(), F.abs(zero("overlay_points")).desc(), zero("search_surge").desc(), zero("discovery_score").desc()]
    if version == 2:
        order.append(zero("disclosure_intensity").desc())
    w = W.partitionBy(*keys).orderBy(*order, "instrument_id")
    ranked = chosen.withColumn("rank", F.row_number().over(w))
    if limit is not None:
        ranked = ranked.where(F.col("rank") <= limit)
    none = F.array().cast("array<string>")
    return ranked.withColumn("excluded", exclusions() if exclude and version == 2 else none)


def left_out(pool: DataFrame, keys: Sequence[str], *, version: int = 1, limit: int = MAX_MEMBERS) -> DataFrame:
    chosen = pool.where(F.size(reasons(version)) > 0)
    return chosen.groupBy(*keys).agg(F.greatest(F.lit(0), F.count(F.lit(1)) - limit).alias("left_out"))


def freeze_pool(discovery: DataFrame, filings: DataFrame, focus: DataFrame, tracked: DataFrame) -> DataFrame:
    """Pool of a morning: discovered, with an event filing, or in focus, and by which of them."""
    d = discovery.select("instrument_id", F.col("score").alias("discovery_score"))
    f = filings.select("instrument_id", F.col("intensity").alias("disclosure_intensity"))
    o = focus.select("instrument_id", F.lit(True).alias("_focus")).distinct()
    t = tracked.select("instrument_id", F.lit(True).alias("tracked")).distinct()
    pool = d.join(f, "instrument_id", "full").join(o, "instrument_id", "full").join(t, "instrument_id", "left")
    sources = F.array_compact(F.array(
        F.when(F.col("discovery_score").isNotNull(), "DISCOVERY"), F.when(F.col("disclosure_intensity").isNotNull(), "DISCLOSURE"), F.when(F.col("_focus"), "FOCUS")))
    return pool.select("instrument_id", sources.alias("sources"), F.coalesce("tracked", F.lit(False)).alias("tracked"), "discovery_score",
                       F.col("disclosure_intensity").isNotNull().alias("has_disclosure_event"), "disclosure_intensity")


def work_list(ranked: DataFrame, keys: Sequence[str], stale: Column, *, cap: int = 150) -> DataFrame:
    """Names to refresh first: stale ones in rank order, at most ``cap`` per list (a fetch budget)."""
    w = W.partitionBy(*keys).orderBy("rank")
    return ranked.where(stale).withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= cap)


def peer_hash(peers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Size and fingerprint of the peer set a score was ranked in (a market's tracked names), whatever its size."""
    once = peers.select(*keys, "instrument_id").distinct()
    return ordered_digest(once, keys, "instrument_id", "instrument_id", "peer_hash").withColumnRenamed("n", "peer_count")


def snapshot(pool: DataFrame, taken: DataFrame, keys: Sequence[str] = ("session_no",)) -> DataFrame:
    """Members of every list version of a morning, for days without a stored list."""
    todo = pool.join(taken, list(keys), "left_anti")
    cols = [*keys, "instrument_id", "rank", "reasons", "excluded", "tracked", "overlay_points", "search_surge", "discovery_score", "judged_score", "prev_change"]
    one = select_names(todo, keys, version=1).select(F.lit(1).alias("selection_version"), *cols)
    two = select_names(todo, keys, version=2, exclude=True).select(F.lit(2).alias("selection_version"), *cols)
    return one.unionByName(two)


def input_audit(pool: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many of a list's inputs were there when it was taken."""
    have = lambda c: F.count(c).alias(f"with_{c}")
    return pool.groupBy(*keys).agg(F.count(F.lit(1)).alias("pool"), *[have(c) for c in ("overlay_points", "search_surge", "discovery_score", "judged_score", "prev_change")])


def promote(candidates: DataFrame, bars: DataFrame, facts: DataFrame) -> DataFrame:
    """Candidates with daily bars are promoted; the outcome says what they came with."""
    b = bars.groupBy("instrument_id").agg(F.count(F.lit(1)).alias("candle_bars"))
    f = facts.groupBy("instrument_id").agg(F.count(F.lit(1)).alias("fundamental_facts"))
    out = candidates.join(b, "instrument_id", "left").join(f, "instrument_id", "left").fillna(0, ["candle_bars", "fundamental_facts"])
    ok = F.col("candle_bars") > 0
    return out.withColumns({"promoted": ok, "reason": F.when(~ok, "no daily bars").when(F.col("fundamental_facts") == 0, "promoted without financial facts").otherwise("promoted")})


def list_view(members: DataFrame, tracked: DataFrame, keys: Sequence[str] = ("session_no",)) -> DataFrame:
    """Kept members by rank, version 2 before version 1; tracked names where a day has no list."""
    best = members.groupBy(*keys).agg(F.max("selection_version").alias("selection_version"))
    shown = members.join(best, [*keys, "selection_version"], "left_semi").where(F.size("excluded") == 0)
    view = shown.select(*keys, "instrument_id", "rank", F.lit("LIST").alias("origin"))
    fallback = tracked.join(members.select(*keys).distinct(), list(keys), "left_anti")
    return view.unionByName(fallback.select(*keys, "instrument_id", F.lit(None).cast("int").alias("rank"), F.lit("TRACKED").alias("origin")))


def signal_rows(view: DataFrame, weights: DataFrame, limits: DataFrame, analysts: DataFrame) -> DataFrame:
    """List rows with what is shown beside them: market weight, the previous session's limit state and change, the analysts' summary.

    ``weights``, ``limits`` and ``analysts`` have a row an instrument at most; what is not known of an instrument is null and it is no
    heavyweight.  None of it takes part in selection or scoring, so no row is lost or doubled by it.
    """
    w = weights.select("instrument_id", F.col("weight_pct").alias("market_weight_pct"), F.col("heavyweight").alias("_heavy"))
    p = limits.select("instrument_id", F.col("state").alias("prev_limit"), F.col("change_pct").alias("prev_change_pct"))
    a = analysts.select("instrument_id", F.struct("reports", "brokers", "avg_target", "buy", "hold", "sell", "raised", "lowered", "upside_pct").alias("analyst"))
    rows = view
    for side in (w, p, a):
        rows = rows.join(side, "instrument_id", "left")
    return rows.withColumn("heavyweight", F.coalesce("_heavy", F.lit(False))).drop("_heavy")
