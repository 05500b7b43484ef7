"""Event studies: filings, overnight references, pre-market entries and post windows.

Daily bars carry one row per name and session; every window below runs over a name's or an indicator's
days, or over the calendar, all of them bounded by the number of sessions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from knownat.functions.numeric import sign
from knownat.functions.scale import newest
from knownat.operators import stats
from knownat.operators.calendar import session_grid
from knownat.session import cut_lineage

# Fixed values of the registered studies.
PRICE_LIMIT, LIMIT_SLACK, LIMIT_UP, COST = 0.3, 0.001, 0.295, 0.003
HIGH_INTENSITY = 0.5
SIGMA_WINDOW, BIG, TOP, T_SELECT, MIN_LIST, T_QUALITY, NORMAL_MIN = 60, 2.0, 15, 3.0, 5, 2.0, 20
FILING_HOLDOUT, OVERNIGHT_HOLDOUT = 15, 60


# ------------------------------------------------------------------ filings

def filing_candidates(filings: DataFrame, master: DataFrame, spine: DataFrame, *, first: str, last: str) -> DataFrame:
    """Filings with the session they can first be traded on, or why they drop out.

    ``filings``: receipt, corp_code, filed_on and the classified title columns.  Repeated receipts count once.
    """
    one = newest(filings, ["receipt"], ["filed_on"])
    joined = one.join(master, "corp_code", "left").join(spine.select(F.col("day").alias("filed_on"), F.col("after").alias("entry_day")), "filed_on", "left")
    why = (
        F.when(F.col("instrument_id").isNull(), "not listed").when(F.col("event_type").isNull(), "no event")
        .when(F.col("entry_day").isNull() | (F.col("entry_day") < F.lit(first).cast("date")) | (F.col("entry_day") > F.lit(last).cast("date")), "outside the window")
    )
    return joined.withColumn("dropped", why)


def day_moves(bars: DataFrame) -> DataFrame:
    """Gap from the previous session's close and open-to-close move; needs ``prev_session`` to be the bar's own."""
    w = W.partitionBy("instrument_id").orderBy("day")
    return bars.withColumns({"prev_close": F.lag("close").over(w), "prev_bar": F.lag("day").over(w)}).withColumns({
        "gap": F.col("open") / F.col("prev_close") - 1, "open_close": F.col("close") / F.col("open") - 1})


def event_sample(candidates: DataFrame, moves: DataFrame, index_moves: DataFrame, sessions: DataFrame) -> DataFrame:
    """Strongest filing per name and entry day with its moves against the index; ``dropped`` says what is missing."""
    kept = candidates.where("dropped IS NULL")
    best = newest(
        kept.select("instrument_id", F.col("entry_day").alias("day"), "event_type", "sentiment", "intensity", "receipt"),
        ["instrument_id", "day"], ["intensity", F.abs(F.coalesce("sentiment", F.lit(0.0))), "event_type", "receipt"])
    joined = (
        best.join(moves.select("instrument_id", "day", "gap", "open_close", "prev_bar"), ["instrument_id", "day"], "left")
        .join(sessions.select("day", "prev_day"), "day", "left")
        .join(index_moves.select("day", F.col("gap").alias("index_gap"), F.col("open_close").alias("index_open_close")), "day", "left")
    )
    why = (
        F.when(F.col("open_close").isNull(), "no bar").when(F.col("prev_bar").isNull() | (F.col("prev_bar") != F.col("prev_day")), "no previous bar")
        .when(F.col("index_gap").isNull(), "no index").when(F.abs("gap") > PRICE_LIMIT + LIMIT_SLACK, "beyond the limit")
    )
    return joined.withColumn("dropped", why).withColumns({
        "excess": F.col("open_close") - F.col("index_open_close"), "excess_gap": F.col("gap") - F.col("index_gap")})


def _questions(parts: dict[str, Column], by_day: DataFrame) -> DataFrame:
    q = F.array(*[F.struct(F.lit(k).alias("question"), v.alias("value")) for k, v in parts.items()])
    return by_day.select("day", F.explode(q).alias("_q")).select("day", "_q.*").where("value IS NOT NULL")


def filing_questions(events: DataFrame) -> DataFrame:
    """D1 excess, D2 signed excess, D3 signed gap, D4 strong against weak filings, one value per day."""
    s, strong = sign("sentiment"), F.col("intensity") >= HIGH_INTENSITY
    by_day = events.groupBy("day").agg(
        F.avg("excess").alias("D1"), F.avg(F.when(s != 0, s * F.col("excess"))).alias("D2"), F.avg(F.when(s != 0, s * F.col("excess_gap"))).alias("D3"),
        (F.avg(F.when(strong, F.abs("excess"))) - F.avg(F.when(~strong, F.abs("excess")))).alias("D4"))
    return _questions({q: F.col(q) for q in ("D1", "D2", "D3", "D4")}, by_day)


def by_type(events: DataFrame) -> DataFrame:
    """Per event type: events, days, mean daily excess with t, share of names above the index."""
    daily = stats.mean_t(stats.day_means(events, ["event_type"], "excess"), ["event_type"])
    counts = events.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.avg(F.when(F.col("excess") > 0, 1.0).otherwise(0.0)).alias("up_share"))
    return counts.join(daily, "event_type")


def first_hour_measures(bars: DataFrame) -> DataFrame:
    """Return, best and worst move of the first hour from the 09:00 open (selling possible from 09:01)."""
    later = F.col("minute") >= 1
    hour = bars.where("minute >= 0 AND minute < 60").groupBy("instrument_id", "day").agg(
        F.max(F.when(F.col("minute") == 0, F.col("open"))).alias("_e"), F.max_by("close", "minute").alias("_c"),
        F.max(F.when(later, F.col("high"))).alias("_h"), F.min(F.when(later, F.col("low"))).alias("_l"))
    return hour.where("_e > 0 AND _h IS NOT NULL").select(
        "instrument_id", "day", *[(F.col(c) / F.col("_e") - 1).alias(n) for c, n in (("_c", "ret"), ("_h", "mfe"), ("_l", "mae"))])


def first_hour_questions(events: DataFrame) -> DataFrame:
    """F1 mean return, F2 good against bad, F3 strong against weak range, F4 best against worst move."""
    s, strong, width = sign("sentiment"), F.col("intensity") >= HIGH_INTENSITY, F.col("mfe") - F.col("mae")
    by_day = events.groupBy("day").agg(
        F.avg("ret").alias("F1"), (F.avg(F.when(s > 0, F.col("ret"))) - F.avg(F.when(s < 0, F.col("ret")))).alias("F2"),
        (F.avg(F.when(strong, width)) - F.avg(F.when(~strong, width))).alias("F3"), F.avg(F.col("mfe") + F.col("mae")).alias("F4"))
    return _questions({q: F.col(q) for q in ("F1", "F2", "F3", "F4")}, by_day)


# ------------------------------------------------------------------ overnight references

def quality_gate(ours: DataFrame, other: DataFrame) -> DataFrame:
    """Shares of name-days on which a second source agrees: coverage, open within 0.1 %, close within 0.3 %."""
    joined = ours.join(other.select("instrument_id", "day", F.col("open").alias("_o"), F.col("close").alias("_c")), ["instrument_id", "day"], "left")
    near = lambda a, b, tol: F.when(F.col(b).isNotNull(), F.when(F.abs(F.col(b) / F.col(a) - 1) <= tol, 1.0).otherwise(0.0))
    row = joined.agg(
        F.avg(F.when(F.col("_o").isNotNull(), 1.0).otherwise(0.0)).alias("coverage"), F.avg(near("open", "_o", 0.001)).alias("open_ok"),
        F.avg(near("close", "_c", 0.003)).alias("close_ok"), F.count(F.lit(1)).alias("name_days"))
    return row.withColumn("passed", (F.col("coverage") >= 0.95) & (F.col("open_ok") >= 0.90) & (F.col("close_ok") >= 0.90))


def liquid(bars: DataFrame, *, min_days: int = 200, min_value: float = 1e9) -> DataFrame:
    agg = bars.groupBy("instrument_id").agg(F.count(F.lit(1)).alias("days"), F.avg(F.col("close") * F.col("volume")).alias("traded_value"))
    return agg.where((F.col("days") >= min_days) & (F.col("traded_value") >= min_value))


def align(sessions: DataFrame, series: DataFrame) -> DataFrame:
    """Foreign return known at each local open: last close strictly before it over the last strictly before the
    previous local close; null when no new foreign session fell in between.

    As-of by union and carry-forward: one row per session and foreign day, no range join.
    """
    prev = sessions.withColumn("prev_close_at", F.lag("close_at").over(W.orderBy("day"))).select("ordinal", "day", "open_at", "prev_close_at")
    grid = session_grid(series.select("code").distinct(), prev).where("prev_close_at IS NOT NULL")
    asks = F.array(F.struct(F.lit("open").alias("ask"), F.col("open_at").alias("t")), F.struct(F.lit("prev").alias("ask"), F.col("prev_close_at").alias("t")))
    asked = grid.select("code", "day", F.explode(asks).alias("_a")).select(
        "code", "day", "_a.*", F.lit(0).alias("_k"), F.lit(None).cast("struct<t:timestamp,price:double>").alias("_s"))
    known = series.select("code", "t", F.lit(1).alias("_k"), F.struct("t", F.col("price").cast("double").alias("price")).alias("_s"),
                          F.lit(None).cast("date").alias("day"), F.lit(None).cast("string").alias("ask"))
    merged = asked.select("code", "t", "_k", "_s", "day", "ask").unionByName(known)
    w = W.partitionBy("code").orderBy("t", "_k").rowsBetween(W.unboundedPreceding, -1)
    found = merged.withColumn("_f", F.last("_s", ignorenulls=True).over(w)).where("ask IS NOT NULL")
    both = found.groupBy("code", "day").agg(
        F.max(F.when(F.col("ask") == "open", F.col("_f"))).alias("_open"), F.max(F.when(F.col("ask") == "prev", F.col("_f"))).alias("_prev"))
    fresh = F.col("_open.t") != F.col("_prev.t")
    return both.select("code", "day", F.when(fresh, F.col("_open.price") / F.col("_prev.price") - 1).alias("r"))


def overnight_reference(sessions: DataFrame, series: DataFrame, *, split_suspect: float = 0.3) -> DataFrame:
    """Overnight change in percent; a jump beyond 30 % is a suspected split and is withheld."""
    r = align(sessions, series)
    suspect = F.coalesce(F.abs("r") > split_suspect, F.lit(False))
    return r.select("code", "day", F.when(~suspect, F.col("r") * 100).alias("change_pct"), suspect.alias("split_suspect"))


def residuals(returns: DataFrame, market: str, train: Column) -> DataFrame:
    """Indicator returns less beta times the market's; beta is fitted on the training days only."""
    m = returns.where(F.col("code") == market).select("day", F.col("r").alias("m"))
    joined = returns.where(F.col("code") != market).join(m, "day", "left")
    both = train & F.col("r").isNotNull() & F.col("m").isNotNull()
    beta = joined.where(both).groupBy("code").agg(F.regr_slope("r", "m").alias("beta"))
    return joined.join(beta, "code").select("code", "day", "beta", (F.col("r") - F.col("beta") * F.col("m")).alias("e"))


def trailing_sigma(res: DataFrame, *, window: int = SIGMA_WINDOW) -> DataFrame:
    """Deviation of the last ``window`` days that had a residual, before each day; big and calm days."""
    have = res.where("e IS NOT NULL")
    w = W.partitionBy("code").orderBy("day").rowsBetween(-(window - 1), 0)
    after = have.select("code", "day", F.when(F.count("e").over(w) == window, F.stddev_samp("e").over(w)).alias("_sd"))
    joined = res.join(after, ["code", "day"], "left")
    past = W.partitionBy("code").orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    out = joined.withColumn("sigma", F.last("_sd", ignorenulls=True).over(past)).drop("_sd")
    known = F.col("e").isNotNull() & (F.col("sigma") > 0)
    return out.withColumns({"big": F.coalesce(known & (F.col("e") >= BIG * F.col("sigma")), F.lit(False)),
                            "calm": F.coalesce(known & (F.abs("e") < BIG * F.col("sigma")), F.lit(False))})


def usable() -> Column:
    return (F.abs("gap") <= PRICE_LIMIT + LIMIT_SLACK) & (F.col("gap") < LIMIT_UP)


def relative_gaps(moves: DataFrame) -> DataFrame:
    """Gap and first hour less the equal-weight universe of the day (usable names only)."""
    day = moves.where(usable()).groupBy("day").agg(F.avg("gap").alias("ew_gap"), F.avg("first_hour").alias("ew_first_hour"))
    return moves.where(usable()).join(day, "day").withColumn("gap_rel", F.col("gap") - F.col("ew_gap"))


def corr_t(x: str, y: str) -> tuple[Column, Column, Column]:
    """Aggregates: correlation, its t value (infinite at +-1), and pairs used."""
    n = F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1))
    rho = F.when(n >= 3, F.corr(x, y))
    t = F.when(F.abs(rho) >= 1, F.lit(float("inf"))).otherwise(rho * F.sqrt((n - 2).cast("double")) / F.sqrt(1 - rho * rho))
    return rho, F.when(~F.isnan(rho), t), n


def select_names(res: DataFrame, gaps: DataFrame, *, top: int = TOP, t_min: float = T_SELECT) -> DataFrame:
    """Names whose relative gap follows an indicator's residual: t at least ``t_min``, the ``top`` correlations.

    ``res`` (code, day, e) and ``gaps`` (instrument_id, day, gap_rel) meet on the day; the pair sums are
    partial aggregates, nothing is gathered per pair.
    """
    rho, t, n = corr_t("e", "gap_rel")
    pairs = res.where("e IS NOT NULL").select("code", "day", "e").join(gaps.select("instrument_id", "day", "gap_rel"), "day")
    found = pairs.groupBy("code", "instrument_id").agg(rho.alias("rho"), t.alias("t"), n.alias("n")).where(F.col("t") >= t_min)
    w = W.partitionBy("code").orderBy(F.col("rho").desc(), "instrument_id")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)


def quality(res: DataFrame, gaps: DataFrame, train_days: DataFrame, *, top: int = TOP, t_min: float = T_SELECT, min_list: int = MIN_LIST) -> DataFrame:
    """Select on the front half of training; its mean must follow the indicator in the back half."""
    w = W.orderBy("day")
    n = F.count(F.lit(1)).over(W.partitionBy(F.lit(1)))
    half = train_days.select("day", (F.row_number().over(w) <= F.floor(n / 2)).alias("front"))
    r, g = res.join(half, "day"), gaps.join(half.select("day"), "day", "left_semi")
    chosen = select_names(r.where("front"), g, top=top, t_min=t_min)
    back = r.where("NOT front AND e IS NOT NULL").select("code", "day", "e").join(chosen.select("code", "instrument_id"), "code").join(
        g.select("instrument_id", "day", "gap_rel"), ["instrument_id", "day"])
    daily = back.groupBy("code", "day").agg(F.first("e").alias("e"), F.avg("gap_rel").alias("gap_rel"))
    rho, t, _ = corr_t("e", "gap_rel")
    tested = daily.groupBy("code").agg(rho.alias("back_rho"), t.alias("back_t"))
    size = chosen.groupBy("code").agg(F.count(F.lit(1)).alias("front_list"))
    out = res.select("code").distinct().join(size, "code", "left").join(tested, "code", "left").fillna(0, ["front_list"])
    enough = F.col("front_list") >= min_list
    return out.select("code", "front_list", F.when(enough, F.col("back_rho")).alias("back_rho"), F.when(enough, F.col("back_t")).alias("back_t"),
                      F.coalesce(enough & (F.col("back_t") >= T_QUALITY), F.lit(False)).alias("passed"))


def own_baseline(moves: DataFrame, sessions: DataFrame) -> DataFrame:
    """Mean first hour of a name's calm, usable days in the 60 sessions before, from at least 20 of them."""
    rows = moves.join(sessions.select("day", "ordinal"), "day")
    ok = F.when(F.col("calm") & usable(), F.col("first_hour"))
    w = W.partitionBy("instrument_id").orderBy("ordinal").rangeBetween(-SIGMA_WINDOW, -1)
    return rows.withColumn("baseline", F.when(F.count(ok).over(w) >= NORMAL_MIN, F.avg(ok).over(w)))


def observations(signal_days: DataFrame, lists: DataFrame, moves: DataFrame) -> DataFrame:
    """O1-O4 per signal day and indicator: members' gap, first hour, first hour after cost and against their own past.

    ``moves`` carries gap, first_hour, ew_gap, ew_first_hour and baseline of usable names.
    """
    rows = signal_days.select("code", "day").join(lists.select("code", "instrument_id"), "code").join(moves, ["instrument_id", "day"])
    return rows.groupBy("code", "day").agg(
        F.avg(F.col("gap") - F.col("ew_gap")).alias("O1"), F.avg(F.col("first_hour") - F.col("ew_first_hour")).alias("O2"),
        F.avg(F.col("first_hour") - COST).alias("O3"), F.avg(F.col("first_hour") - F.col("baseline")).alias("O4"))


def equal_weight(obs: DataFrame, questions: Sequence[str], drops: Sequence[str] = ()) -> DataFrame:
    """Mean over the day's indicators per question, also with each indicator left out."""
    q = F.array(*[F.struct(F.lit(k).alias("question"), F.col(f"`{k}`").alias("v")) for k in questions])
    long = obs.select("code", "day", F.explode(q).alias("_q")).select("code", "day", "_q.*").where("v IS NOT NULL")
    scopes = F.filter(F.array(F.lit("none"), *[F.lit(d) for d in drops]), lambda d: d != F.col("code"))
    return long.select("day", "question", "v", F.explode(scopes).alias("dropped")).groupBy("dropped", "question", "day").agg(F.avg("v").alias("value"))


def list_overlaps(lists: DataFrame) -> DataFrame:
    """Names shared by two indicators' lists (lists hold at most 15 names)."""
    a, b = lists.select(F.col("code").alias("a"), "instrument_id"), lists.select(F.col("code").alias("b"), "instrument_id")
    return a.join(b, "instrument_id").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


# ------------------------------------------------------------------ pre-market entries

def premarket(bars: DataFrame, *, first: int = 0, last: int = 4, pre_last: int = 49, min_value: float = 1e7) -> DataFrame:
    """Average price paid in the first five pre-market minutes (by traded value), first open and last pre-market close."""
    m = F.col("minute")
    live = bars.where((F.col("volume") > 0) & m.between(first, pre_last))
    early = m <= last
    agg = live.groupBy("instrument_id", "day").agg(
        F.sum(F.when(early, F.col("close") * F.col("volume"))).alias("value"), F.sum(F.when(early, F.col("volume"))).alias("_v"),
        F.min_by("open", F.when(early, m)).alias("first_open"), F.max_by("close", m).alias("pre_close"))
    return agg.select("instrument_id", "day", "value", F.when(F.coalesce(F.col("value") >= min_value, F.lit(False)), F.col("value") / F.col("_v")).alias("entry"), "first_open", "pre_close")


def name_days(rows: DataFrame) -> DataFrame:
    """Gaps and returns of a pre-market entry; prices beyond the daily limit or at its top drop out."""
    cols = ("entry", "prev_close", "open9", "close10")
    ok = F.lit(True)
    for c in cols:
        ok = ok & (F.col(c) > 0) & ~F.isnan(c)
    out = rows.where(ok).withColumns({
        "g8": F.col("entry") / F.col("prev_close") - 1, "g9": F.col("open9") / F.col("prev_close") - 1, "a": F.col("open9") / F.col("entry") - 1,
        "b": F.col("close10") / F.col("entry") - 1, "krx": F.col("close10") / F.col("open9") - 1})
    edge = PRICE_LIMIT + LIMIT_SLACK
    return out.where((F.abs("g8") <= edge) & (F.abs("g9") <= edge) & (F.abs("g8") < LIMIT_UP))


def control_sample(candidates: DataFrame, exclude: DataFrame, *, size: int = 30) -> DataFrame:
    """The ``size`` names of a day with the smallest sha256 of ``ticker|day``: the same draw every time."""
    pool = candidates.join(exclude, ["day", "ticker"], "left_anti")
    digest = F.sha2(F.concat_ws("|", "ticker", F.date_format("day", "yyyy-MM-dd")), 256)
    w = W.partitionBy("day").orderBy("_h", "ticker")
    return pool.withColumn("_h", digest).withColumn("draw", F.row_number().over(w)).where(F.col("draw") <= size).drop("_h")


def premarket_observations(signal_days: DataFrame, lists: DataFrame, values: DataFrame, control: DataFrame, *, min_names: int = 2, min_control: int = 5, cost: float = COST) -> DataFrame:
    """N1-N4 per signal day and indicator against the day's control names."""
    ctrl = control.join(values, ["instrument_id", "day"]).groupBy("day").agg(
        F.count(F.lit(1)).alias("_c"), F.avg("a").alias("_ca"), F.avg("b").alias("_cb"))
    mine = signal_days.select("code", "day").join(lists.select("code", "instrument_id"), "code").join(values, ["instrument_id", "day"]).groupBy("code", "day").agg(
        F.count(F.lit(1)).alias("names"), F.avg("a").alias("_a"), F.avg("b").alias("_b")).where(F.col("names") >= min_names)
    joined = mine.join(ctrl, "day", "left")
    thick = F.col("_c") >= min_control
    return joined.select("code", "day", F.when(thick, F.col("_a") - F.col("_ca")).alias("N1"), (F.col("_a") - cost).alias("N2"), (F.col("_b") - cost).alias("N3"),
                         F.when(thick, F.col("_b") - F.col("_cb")).alias("N4"))


# ------------------------------------------------------------------ posts

def mentions_keyword(text: Column | str, word: str = "tariff") -> Column:
    """The word occurs outside of links, any case; blank posts never count."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_replace(text, r"(?i)(?:https?://|www\.)\S+", " ").rlike(f"(?i){word}"), F.lit(False))


def counts_in_windows(posts: DataFrame, windows: DataFrame) -> DataFrame:
    """Posts in each half-open window [start, end).

    Posts are counted per instant first; windows open and close cumulative counts, so the work is one sort of
    instants and borders and no post meets a window.
    """
    instants = posts.groupBy(F.col("at").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    # coarse blocks keep the running count distributed: a window needs the total before its block and inside it
    block = F.floor(F.unix_seconds("t") / 86400)
    day_totals = instants.groupBy(block.alias("_b")).agg(F.sum("n").alias("_n"))
    before = W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = day_totals.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    borders = windows.select("day", F.explode(F.array(F.struct(F.lit(-1).alias("s"), F.col("start").alias("t")), F.struct(F.lit(1).alias("s"), F.col("end").alias("t")))).alias("_w")).select("day", "_w.s", "_w.t")
    merged = instants.select("t", "n", F.lit(1).alias("_k"), F.lit(None).cast("date").alias("day"), F.lit(None).cast("int").alias("s")).unionByName(
        borders.select("t", F.lit(0).cast("long").alias("n"), F.lit(0).alias("_k"), "day", "s"))
    local = W.partitionBy("_b").orderBy("t", "_k").rowsBetween(W.unboundedPreceding, -1)
    inside = merged.withColumn("_b", block).withColumn("_in", F.coalesce(F.sum("n").over(local), F.lit(0))).where("_k = 0")
    # a border's block may hold no post of its own: carry the total of the last block that does
    blocks = inside.select("_b").distinct().join(offsets, "_b", "full")
    upto = W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    carried = blocks.withColumn("_total", F.coalesce(F.sum("_n").over(upto), F.lit(0))).select("_b", "_total")
    return inside.join(carried, "_b").groupBy("day").agg(F.sum(F.col("s") * (F.col("_in") + F.col("_total"))).alias("posts"))


def day_values(rows: DataFrame, *, min_names: int = 1000) -> DataFrame:
    """Mean gap and first hour of a day over valid names, from at least ``min_names`` of them."""
    ok = F.lit(True)
    for c in ("prev_close", "open9", "close10"):
        ok = ok & (F.col(c) > 0) & ~F.isnan(c)
    g = F.col("open9") / F.col("prev_close") - 1
    valid = rows.where(ok).withColumn("g", g).where((F.abs("g") <= PRICE_LIMIT + LIMIT_SLACK) & (F.col("g") < LIMIT_UP))
    return valid.groupBy("day").agg(F.avg("g").alias("g"), F.avg(F.col("close10") / F.col("open9") - 1).alias("f"), F.count(F.lit(1)).alias("names")).where(
        F.col("names") >= min_names)


def post_window_verdicts(days: DataFrame, *, cost: float = COST, holdout: int = 60, min_days: int = 20, min_t: float = 2.0) -> DataFrame:
    """T1-T3: month-matched differences on signal days (T1 gap, T3 first hour) and the plain mean after cost (T2).

    ``days``: day, signal, long, monday, g, f.  Study days are split at the middle signal day; the last 60 days are
    held out.  Each fit is a set of Spark sums with a small solve; the verdict rows are the only output.
    """
    spark = days.sparkSession
    # one row per session, read by every fit: written once
    tagged = cut_lineage(days.join(stats.split_days(days, holdout), "day").withColumns({
        "month": F.date_format("day", "yyyy-MM"), "week": F.date_trunc("week", "day"), "net": F.col("f") - cost}))
    study, held = tagged.where("NOT held"), tagged.where("held")
    w = W.orderBy("day")
    n = F.count(F.lit(1)).over(W.partitionBy(F.lit(1)))
    middle = study.where("signal = 1").select("day", (F.row_number().over(w) - 1).alias("_k"), F.floor(n / 2).alias("_m")).where("_k = _m").select(F.col("day").alias("_cut"))
    split = study.join(middle, F.col("day").isNotNull(), "left")
    parts = {"study": study, "front": split.where(F.col("day") < F.col("_cut")), "back": split.where(F.col("day") >= F.col("_cut")), "holdout": held}
    counts = study.agg(F.sum("signal").alias("s"), F.sum(1 - F.col("signal")).alias("c")).first()
    n_sig, n_cmp = int(counts["s"] or 0), int(counts["c"] or 0)
    out = []
    for key in ("T1", "T2", "T3"):
        fits = {}
        for name, rows in parts.items():
            if key == "T2":
                fits[name] = stats.ols_cluster(rows.where("signal = 1"), "net", [], "week", "const")
            else:
                fits[name] = stats.ols_cluster(rows, "g" if key == "T1" else "f", ["signal", "long", "monday"], "week", "signal", group="month")
        s = fits["study"]
        state = stats.NOT_ESTABLISHED
        if n_sig < min_days or n_cmp < min_days or s["b"] is None or s["t"] is None:
            state = stats.TOO_FEW
        else:
            way = 1.0 if s["b"] > 0 else -1.0
            strong = abs(s["t"]) >= min_t if key == "T1" else s["b"] > 0 and s["t"] >= min_t
            if strong and all(fits[p]["b"] is not None and fits[p]["b"] * way > 0 for p in ("front", "back", "holdout")):
                state = stats.ESTABLISHED
        out.append((key, n_sig, n_cmp, s["b"], s["t"], fits["front"]["b"], fits["back"]["b"], fits["holdout"]["b"], state))
    return spark.createDataFrame(out, "question string, signal_days long, comparison_days long, b double, t double, front_b double, back_b double, holdout_b double, state string")


def carried_on(verdicts: DataFrame, sets: dict[str, Sequence[str]], *, question: str = "question", state: str = "state") -> DataFrame:
    """Whether a study's result is carried on: every question of some set is established.  One row per named set, with the questions that are missing.

    Questions that were never judged count as not established; an empty table carries nothing on.
    """
    held = lambda q: F.coalesce(F.bool_or((F.col(question) == q) & (F.col(state) == "established")), F.lit(False))
    wanted = sorted({q for qs in sets.values() for q in qs})
    row = verdicts.agg(*[held(q).alias(f"_{q}") for q in wanted])
    rows = F.array(*[
        F.struct(F.lit(name).alias("rule"), F.array_compact(F.array(*[F.when(~F.col(f"_{q}"), q) for q in qs])).alias("missing")) for name, qs in sets.items()])
    return row.select(F.explode(rows).alias("_r")).select("_r.rule", (F.size("_r.missing") == 0).alias("carried_on"), "_r.missing")


#: Sets of questions that carry a study on: the overnight sectors' next version, the pre-market entry and the post window as candidates.
CARRIED_ON = {"overnight": ("O3", "O4"), "absolute entry": ("N1", "N2"), "entry over control": ("N3", "N4"), "post window": ("T2", "T3")}
