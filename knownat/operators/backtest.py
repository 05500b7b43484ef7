"""Forward record of signals, and backtests with walk-forward windows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from knownat.functions.scale import exact_quantile, ordered_digest
from knownat.operators import indicators as ind
from knownat.operators.calendar import session_grid
from knownat.session import cut_lineage
from knownat.sources.store import StoredTable

HORIZONS = (1, 5, 20)
TRADING_DAYS, MIN_OBSERVATIONS = 252, 20


# ------------------------------------------------------------------ forward record

def outcomes(signals: DataFrame, bars: DataFrame, sessions: DataFrame, *, now: Column | None = None, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Return from the exact entry open to the close of the h-th session, where both bars are stored and closed."""
    entry = bars.select("instrument_id", F.col("day").alias("entry_day"), F.col("open").alias("entry_price")).where("entry_price > 0")
    ords = sessions.select("day", "ordinal", "close_at")
    asked = signals.join(entry, ["instrument_id", "entry_day"]).join(ords.select(F.col("day").alias("entry_day"), F.col("ordinal").alias("_o")), "entry_day")
    asked = asked.select("*", F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon")).withColumn("_x", F.col("_o") + F.col("horizon") - 1)
    ends = ords.select(F.col("ordinal").alias("_x"), F.col("day").alias("exit_day"), F.col("close_at").alias("exit_at"))
    if now is not None:
        ends = ends.where(F.col("exit_at") <= now)
    closes = bars.select("instrument_id", F.col("day").alias("exit_day"), F.col("close").alias("exit_price"))
    out = asked.join(ends, "_x").join(closes, ["instrument_id", "exit_day"])
    return out.withColumn("return_pct", (F.col("exit_price") / F.col("entry_price") - 1) * 100).drop("_o", "_x")


def open_signals(signals: DataFrame, measured: DataFrame, now: Column, *, days: int = 60) -> DataFrame:
    """Recent signals that do not have every horizon yet."""
    done = measured.groupBy("signal_id").agg(F.count(F.lit(1)).alias("_n"))
    recent = signals.where(F.col("decision_at") >= F.timestamp_add("DAY", F.lit(-days), now)).where(F.col("decision_at") <= now)
    return recent.join(done, "signal_id", "left").where(F.coalesce("_n", F.lit(0)) < len(HORIZONS)).withColumn("measured", F.coalesce("_n", F.lit(0))).drop("_n")


def first_signals(signals: DataFrame, version: str) -> DataFrame:
    """First signal per (instrument, decision) of one version, not written after its entry."""
    ok = signals.where((F.col("strategy_version") == version) & (F.col("ingested_at") <= F.col("earliest_execution_at")))
    first = ok.groupBy("instrument_id", "decision_at").agg(F.min("signal_id").alias("signal_id"))
    return signals.join(first.select("signal_id"), "signal_id", "left_semi")


def records(measured: DataFrame, overlays: DataFrame, regimes: DataFrame, attention: DataFrame, *, overlay_version: int, regime_version: int, attention_version: int) -> DataFrame:
    """Outcomes with the overlay, regime and attention of the wanted versions, and the excess over the mean of
    the same market, entry and horizon."""
    o = overlays.where(F.col("overlay_version") == overlay_version).select("signal_id", "points")
    r = regimes.where(F.col("regime_version") == regime_version).select("signal_id", F.col("label").alias("regime"))
    a = attention.where(F.col("attention_version") == attention_version).select("signal_id", F.col("status").alias("attention"))
    base = measured.groupBy("horizon", "market", "entry_day").agg(F.avg("return_pct").alias("_base"))
    out = measured.join(o, "signal_id", "left").join(r, "signal_id", "left").join(a, "signal_id", "left")
    return out.join(base, ["horizon", "market", "entry_day"]).withColumn("excess", F.col("return_pct") - F.col("_base")).drop("_base")


def overlay_band(points: Column | str) -> Column:
    p = F.col(points) if isinstance(points, str) else points
    return F.when(p.isNull(), "no overlay").when(p >= 1, "good news").when(p <= -1, "bad news").otherwise("neutral")


def forward_report(rows: DataFrame) -> DataFrame:
    """Count, days, mean, exact median, hit rate and excess per horizon and label of every grouping."""
    labels = F.array(
        F.struct(F.lit("action").alias("grouping"), F.col("action").alias("label")),
        F.struct(F.lit("overlay").alias("grouping"), overlay_band("points").alias("label")),
        F.struct(F.lit("regime").alias("grouping"), F.coalesce("regime", F.lit("no regime")).alias("label")),
        F.struct(F.lit("attention").alias("grouping"), F.coalesce("attention", F.lit("not recorded")).alias("label")),
    )
    long = rows.select("horizon", "entry_day", "return_pct", "excess", F.explode(labels).alias("_l")).select("horizon", "entry_day", "return_pct", "excess", "_l.*")
    keys = ["horizon", "grouping", "label"]
    # names of a day first, so distinct days are a plain count afterwards
    daily = long.groupBy(*keys, "entry_day").agg(F.count(F.lit(1)).alias("n"), F.sum("return_pct").alias("s"), F.sum("excess").alias("x"), F.count(F.when(F.col("return_pct") > 0, 1)).alias("h"))
    agg = daily.groupBy(*keys).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("days"), (F.sum("s") / F.sum("n")).alias("mean"), (F.sum("h") / F.sum("n")).alias("hit_rate"), (F.sum("x") / F.sum("n")).alias("mean_excess"))
    return agg.join(exact_quantile(long.select(*keys, "return_pct"), keys, "return_pct").drop("n"), keys)


# ------------------------------------------------------------------ strategies

def moving_average_cross(bars: DataFrame, short: int = 20, long: int = 60) -> DataFrame:
    if short >= long:
        raise ValueError(f"short ({short}) must be under long ({long})")
    fast, slow = ind.sma("close", short), ind.sma("close", long)
    rows = bars.withColumns({"_f": fast, "_s": slow})
    return rows.withColumn("signal", F.when(F.col("_s").isNull(), "ABSTAIN").when(F.col("_f") > F.col("_s"), "ENTER").otherwise("EXIT")).drop("_f", "_s")


def buy_and_hold(bars: DataFrame) -> DataFrame:
    return bars.withColumn("signal", F.lit("ENTER"))


def scored_rule(scored: DataFrame) -> DataFrame:
    """BUY_INTEREST enters, CAUTION exits, no judgement abstains, anything else holds."""
    a = F.col("action")
    return scored.withColumn("signal", F.when(a == "BUY_INTEREST", "ENTER").when(a == "CAUTION", "EXIT").when(a == "ABSTAINED", "ABSTAIN").otherwise("HOLD"))


KINDS = {"moving_average_cross": moving_average_cross, "buy_and_hold": buy_and_hold}


def build(bars: DataFrame, kind: str, params: dict) -> DataFrame:
    if kind not in KINDS:
        raise ValueError(f"no strategy kind {kind!r}; known: {', '.join(sorted(KINDS))}")
    return KINDS[kind](bars, **params)


def fingerprint(kind: Column, version: Column, params: Column) -> Column:
    """First 16 hex digits of the sha256 of a definition; parameters are ordered by name."""
    body = F.array_join(F.transform(F.array_sort(F.map_entries(params)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return F.substring(F.sha2(F.concat_ws("|", kind, version, body), 256), 1, 16)


def trace_fingerprint(choices: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fingerprint of the sequence of chosen definitions, in window order."""
    text = F.concat(F.col("window_index").cast("string"), F.lit(":"), F.col("chosen_fingerprint"))
    out = ordered_digest(choices, keys, "window_index", text, "fit_trace", separator=";")
    return out.select(*keys, F.substring("fit_trace", 1, 16).alias("fit_trace"))


# ------------------------------------------------------------------ windows

def walk_forward_windows(sessions: DataFrame, *, train: int, evaluate: int, holdout: int = 0, anchored: bool = False) -> DataFrame:
    """Train/evaluation windows that tile the sessions once, after the hold-out is cut off the end."""
    if train < 1 or evaluate < 1 or holdout < 0:
        raise ValueError("window lengths must be positive")
    total = sessions.agg(F.max("ordinal").alias("_n")).withColumn("_usable", F.col("_n") - holdout)
    count = F.floor((F.col("_usable") - train) / evaluate)
    starts = total.where(F.col("_usable") >= train + evaluate).select("_n", "_usable", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("window_index"))
    lo = F.lit(1).cast("long") if anchored else F.col("window_index") * evaluate + 1
    hi = F.col("window_index") * evaluate + train
    spans = starts.select("window_index", F.explode(F.array(
        F.struct(F.lit("TRAIN").alias("sample"), lo.alias("first"), hi.alias("last")),
        F.struct(F.lit("EVALUATE").alias("sample"), (hi + 1).alias("first"), (hi + evaluate).alias("last")))).alias("_s")).select("window_index", "_s.*")
    if holdout:
        spans = spans.unionByName(total.select(F.lit(-1).cast("long").alias("window_index"), F.lit("HOLDOUT").alias("sample"), (F.col("_usable") + 1).alias("first"), F.col("_n").alias("last")))
    a = sessions.select(F.col("ordinal").alias("first"), F.col("day").alias("start_day"))
    b = sessions.select(F.col("ordinal").alias("last"), F.col("day").alias("end_day"), F.col("close_at").alias("window_end"))
    return spans.join(a, "first").join(b, "last").select("window_index", "sample", "start_day", "end_day", "window_end", (F.col("last") - F.col("first") + 1).alias("sessions"))


# ------------------------------------------------------------------ fills

COMMISSION, SLIPPAGE = 0.0005, 0.0005


def decisions(signals: DataFrame, sessions: DataFrame, windows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per (key, window, session): own bar, mark, signal and the next session's open.

    Built by joins for all keys at once; the mark is the last known close, and a session without its own bar
    carries no decision.
    """
    grid = session_grid(signals.select(*keys).distinct(), sessions.select("ordinal", "day", "next_day"))
    bars = signals.select(*keys, "day", "open", "close", "signal")
    w = W.partitionBy(*keys).orderBy("day")
    marked = grid.join(bars, [*keys, "day"], "left").select(
        *keys, "day", "next_day", F.last("close", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)).alias("mark"),
        F.col("close").isNotNull().alias("own_bar"), "signal", F.lead("open").over(w).alias("_next_open"))
    # windows as (window, session) rows: bounded by windows x sessions, met by equality on the day
    spans = windows.select("window_index", "sample", "start_day", "end_day", F.explode(F.sequence("start_day", "end_day")).alias("day"))
    rows = marked.join(spans, "day")
    inside = F.col("next_day") <= F.col("end_day")
    return rows.select(*keys, "window_index", "sample", "day", "mark", "own_bar", "signal", "next_day",
                       F.when(inside, F.col("_next_open")).alias("fill_open"), (~F.coalesce(inside, F.lit(False))).alias("past_end"))


def filled(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fills at the next open, closed trades and the value of one unit invested, per (key, window) of ``decisions``.

    A decision is usable if its session has a bar and the next open lies in the window.  What is held before a session
    is the newest usable decision before it, so a fill is a usable decision that differs from that: windows alone,
    without a running account.  ``event`` says why a session did nothing; ``trade_return`` is net of slippage and
    commission on both sides; ``equity`` reinvests everything, marked at the last known close.
    """
    w = W.partitionBy(*keys, "window_index", "sample").orderBy("day")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    wanted = F.col("own_bar") & F.coalesce(F.col("signal").isin("ENTER", "EXIT"), F.lit(False))
    usable = wanted & ~F.col("past_end") & F.coalesce(F.col("fill_open") > 0, F.lit(False))
    staged = rows.withColumn("_held", F.coalesce(F.last(F.when(usable, F.col("signal") == "ENTER"), ignorenulls=True).over(before), F.lit(False)))
    turns = wanted & ((F.col("signal") == "ENTER") != F.col("_held"))
    fill = F.when(turns & usable, F.when(F.col("_held"), "SELL").otherwise("BUY"))
    staged = staged.withColumns({
        "fill": fill,
        "price": F.when(fill == "BUY", F.col("fill_open") * (1 + SLIPPAGE)).when(fill == "SELL", F.col("fill_open") * (1 - SLIPPAGE)),
        "event": F.when(~F.col("own_bar"), "NO_DATA").when(F.col("signal") == "ABSTAIN", "ABSTAIN").when(turns & ~usable, "UNFILLED"),
    })
    staged = staged.withColumn("_paid", F.last(F.when(F.col("fill") == "BUY", F.col("price") * (1 + COMMISSION)), ignorenulls=True).over(before))
    staged = staged.withColumn("trade_return", F.when(F.col("fill") == "SELL", F.col("price") * (1 - COMMISSION) / F.col("_paid") - 1))
    grown = F.exp(F.coalesce(F.sum(F.ln(F.col("trade_return") + 1)).over(before), F.lit(0.0)))
    equity = grown * F.when(F.col("_held"), F.col("mark") / F.col("_paid")).otherwise(1.0)
    return staged.withColumn("equity", equity).select(*keys, "window_index", "sample", "day", "equity", "fill", "price", "trade_return", "event")


# ------------------------------------------------------------------ metrics

def performance(curve: DataFrame, keys: Sequence[str], *, equity: str = "equity") -> DataFrame:
    """Total return, CAGR (30 days on), maximum drawdown and Sharpe (20 observations on) of equity curves."""
    w = W.partitionBy(*keys).orderBy("day")
    v = F.col(equity)
    before = F.lag(equity).over(w)
    peak = F.max(equity).over(w.rowsBetween(W.unboundedPreceding, 0))
    rows = curve.where(v.isNotNull()).withColumns({"_r": F.when(before > 0, v / before - 1), "_d": F.when(peak > 0, v / peak - 1)})
    agg = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.count("_r").alias("observations"), F.avg("_r").alias("_m"), F.stddev_samp("_r").alias("_sd"), F.min("_d").alias("_dd"),
        F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.min_by(equity, "day").alias("_v0"), F.max_by(equity, "day").alias("_v1"))
    enough = (F.col("_n") >= 2) & (F.col("_v0") > 0)
    days = F.datediff("last_day", "first_day")
    growth = F.col("_v1") / F.col("_v0")
    return agg.where("_n >= 2").select(
        *keys, "first_day", "last_day", "observations", F.when(enough, growth - 1).alias("total_return"),
        F.when(enough & (F.col("_v1") > 0) & (days >= 30), F.pow(growth, 365.25 / days) - 1).alias("cagr"),
        F.least(F.col("_dd"), F.lit(0.0)).alias("max_drawdown"),
        F.when((F.col("observations") >= MIN_OBSERVATIONS) & (F.col("_sd") > 0), F.col("_m") / F.col("_sd") * F.sqrt(F.lit(float(TRADING_DAYS)))).alias("sharpe"))


def trade_stats(trades: DataFrame, keys: Sequence[str], *, pnl: str = "pnl") -> DataFrame:
    p = F.col(pnl)
    gains, losses = F.sum(F.when(p > 0, p).otherwise(0.0)), -F.sum(F.when(p < 0, p).otherwise(0.0))
    return trades.where(p.isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trades"), F.avg(F.when(p > 0, 1.0).otherwise(0.0)).alias("win_rate"), F.when(losses > 0, gains / losses).alias("profit_factor"))


def window_results(fills: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Everything stored per window: performance, trades, and how many sessions abstained, lacked data or failed to fill."""
    group = [*keys, "window_index", "sample"]
    perf = performance(fills, group)
    trades = trade_stats(fills, group, pnl="trade_return")
    count = lambda e: F.count(F.when(F.col("event") == e, 1))
    notes = fills.groupBy(*group).agg(F.count(F.lit(1)).alias("sessions"), count("ABSTAIN").alias("abstained"), count("NO_DATA").alias("without_data"), count("UNFILLED").alias("unfilled"))
    return notes.join(perf, group, "left").join(trades, group, "left").fillna(0, ["trades"])


def choose_fitted(results: DataFrame, keys: Sequence[str], *, objective: str = "total_return") -> DataFrame:
    """Per window, the strategy that did best on its training rows, with its evaluation result."""
    train = results.where("sample = 'TRAIN'")
    best = train.groupBy(*keys, "window_index").agg(F.max_by("strategy", F.struct(F.coalesce(objective, F.lit(float("-inf"))), "strategy")).alias("strategy"))
    return results.where("sample = 'EVALUATE'").join(best, [*keys, "window_index", "strategy"], "left_semi")


# ------------------------------------------------------------------ gates, reproduction, storage

def data_gates(span: DataFrame, bars: DataFrame, sessions: DataFrame, facts: DataFrame, gaps: DataFrame, versions: DataFrame, *, start: str, end: str, current_version: int, max_stale: int = 550) -> DataFrame:
    """Refusal reasons per instrument for a backtest over [start, end]; names with none may run."""
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    inside = sessions.where((F.col("day") >= lo) & (F.col("day") <= hi)).select("day")
    expected = inside.agg(F.count(F.lit(1)).alias("_want"))
    have = bars.join(inside, "day", "left_semi").groupBy("instrument_id").agg(F.count(F.lit(1)).alias("_have"))
    ends = facts.where(F.col("period_start").isNotNull()).groupBy("instrument_id").agg(F.min("filed_at").alias("_first_filed"), F.max(F.when(F.col("filed_at") <= hi, F.col("filed_at"))).alias("_last_filed"))
    middle = gaps.where(F.col("is_gap") & (F.col("period_end") < hi) & (F.col("next_end") > lo)).groupBy("instrument_id").agg(F.count(F.lit(1)).alias("_gaps"))
    rows = span.join(have, "instrument_id", "left").join(expected, F.col("instrument_id").isNotNull()).join(ends, "instrument_id", "left").join(middle, "instrument_id", "left").join(versions, "instrument_id", "left")
    checks = F.array_compact(F.array(
        F.when(F.col("first_bar").isNull() | (F.col("first_bar") > lo) | (F.col("last_bar") < hi), "prices do not span the period"),
        F.when(F.coalesce("_have", F.lit(0)) < F.col("_want"), "sessions without a bar"),
        F.when(F.col("_first_filed").isNull() | (F.col("_first_filed") > lo), "filings start too late"),
        F.when(F.col("_gaps") > 0, "annual filings have a gap"),
        F.when(F.col("_last_filed").isNull() | (F.datediff(hi, "_last_filed") > max_stale), "newest filing is too old"),
        F.when(F.col("oldest_version").isNull() | (F.col("oldest_version") < current_version), "facts read by an old version")))
    return rows.select("instrument_id", checks.alias("refusals"))


MEASURES = ("sessions", "observations", "total_return", "cagr", "max_drawdown", "sharpe", "win_rate", "profit_factor", "trades", "abstained", "without_data", "unfilled")


def reproduce(stored: DataFrame, rerun: DataFrame, keys: Sequence[str], *, tolerance: float = 1e-8) -> DataFrame:
    """Windows whose rerun differs from what was stored, with the measures that differ (null equals null)."""
    b = rerun.select(*keys, *[F.col(m).alias(f"_{m}") for m in MEASURES], F.lit(True).alias("_there"))
    joined = stored.withColumn("_was", F.lit(True)).join(b, list(keys), "full")

    def differs(m: str) -> Column:
        old, new = F.col(m).cast("double"), F.col(f"_{m}").cast("double")
        same = F.coalesce(F.abs(old - new) <= tolerance * F.greatest(F.lit(1.0), F.abs(old)), F.lit(False)) | (old.isNull() & new.isNull())
        return F.when(~same, m)

    missing = F.when(F.col("_there").isNull(), "missing in rerun").when(F.col("_was").isNull(), "not stored")
    diffs = F.when(missing.isNotNull(), F.array(missing)).otherwise(F.array_compact(F.array(*[differs(m) for m in MEASURES])))
    return joined.select(*keys, diffs.alias("differences"))


def integrity(windows: DataFrame, *, run: str = "run_id") -> DataFrame:
    """Findings about stored runs: overlapping evaluations, training that reaches into evaluation, repeated
    hold-outs, and a hold-out that is not after every evaluation."""
    w = W.partitionBy(run).orderBy("start_day")
    ev = windows.where("sample = 'EVALUATE'").withColumn("_prev", F.lag("end_day").over(w))
    overlap = ev.where(F.col("start_day") <= F.col("_prev")).select(run, F.lit("evaluation windows overlap").alias("finding"))
    train = windows.where("sample = 'TRAIN'").select(run, "window_index", F.col("end_day").alias("_te"))
    leak = windows.where("sample = 'EVALUATE'").join(train, [run, "window_index"]).where(F.col("_te") >= F.col("start_day")).select(run, F.lit("training reaches into evaluation").alias("finding"))
    held = windows.where("sample = 'HOLDOUT'")
    twice = held.groupBy(run).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(run, F.lit("more than one hold-out").alias("finding"))
    last = windows.where("sample = 'EVALUATE'").groupBy(run).agg(F.max("end_day").alias("_le"))
    early = held.join(last, run).where(F.col("start_day") <= F.col("_le")).select(run, F.lit("hold-out is not after the evaluations").alias("finding"))
    return overlap.unionByName(leak).unionByName(twice).unionByName(early).distinct()


def storable_windows(existing: DataFrame, incoming: DataFrame, runs: DataFrame, coordinates: Sequence[str]) -> DataFrame:
    """Incoming windows that may be appended: one hold-out per run, and only from the experiment that made the run."""
    had = existing.where("sample = 'HOLDOUT'").select("run_id").distinct().withColumn("_had", F.lit(True))
    same = F.lit(True)
    for c in coordinates:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    known = runs.select("run_id", *[F.col(c).alias(f"_{c}") for c in coordinates])
    joined = incoming.join(known, "run_id").join(had, "run_id", "left")
    is_holdout = F.col("sample") == "HOLDOUT"
    refused = F.when(is_holdout & F.col("_had").isNotNull(), "hold-out already used").when(is_holdout & ~same, "hold-out of another experiment")
    return joined.withColumn("refused", refused).drop("_had", *[f"_{c}" for c in coordinates])


class RunStore:
    """Stored backtest runs and their windows.

    A run is known by its id and keeps every coordinate it was made with.  Windows are appended once; a hold-out is appended only by the
    experiment that made the run, and only one a run.  Saving the same again adds nothing.
    """

    def __init__(self, spark: SparkSession, path: str, coordinates: Sequence[str]):
        self.coordinates = list(coordinates)
        self.runs = StoredTable(spark, f"{path}/runs", ["run_id"])
        self.windows = StoredTable(spark, f"{path}/windows", ["run_id", "window_index", "sample"])

    def save_runs(self, runs: DataFrame) -> int | None:
        return self.runs.insert_new(runs)

    def save_windows(self, windows: DataFrame) -> DataFrame:
        """Appends what may be stored; returns the refused windows of known runs with the reason.

        ``windows``: run_id, window_index, sample, the coordinates they were made with, and measures.  Of several hold-outs of a run that come
        together, the one of the smallest index counts.
        """
        held = self.windows.read()
        key = ["run_id", "window_index", "sample"]
        existing = windows.limit(0) if held is None else held
        known = existing.select(*[F.col(k).alias(f"_{k}") for k in key])
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key])
        fresh = windows.join(known, same, "left_anti")
        checked = storable_windows(existing, fresh, self.runs.read(), self.coordinates)
        first = W.partitionBy("run_id", "sample", F.col("refused").isNull()).orderBy("window_index")
        again = (F.col("sample") == "HOLDOUT") & F.col("refused").isNull() & (F.row_number().over(first) > 1)
        checked = cut_lineage(checked.withColumn("refused", F.when(again, "hold-out already used").otherwise(F.col("refused"))))
        self.windows.insert_new(checked.where("refused IS NULL").drop("refused"))
        return checked.where("refused IS NOT NULL")

    def list_runs(self) -> DataFrame:
        """Every stored run with its coordinates, its number of windows and hold-outs; runs without a window too."""
        held = self.windows.read()
        runs = self.runs.read()
        if held is None:
            return runs.withColumns({"windows": F.lit(0).cast("long"), "holdouts": F.lit(0).cast("long")})
        counts = held.groupBy("run_id").agg(F.count(F.lit(1)).alias("windows"), F.count(F.when(F.col("sample") == "HOLDOUT", 1)).alias("holdouts"))
        return runs.join(counts, "run_id", "left").fillna(0, ["windows", "holdouts"])


def candidate_bands(measured: DataFrame, *, band: int = 10) -> DataFrame:
    """Outcomes of listed candidates by rank band and horizon: names, days, mean, hit rate, and the mean excess over the day's whole list.

    ``measured``: day, rank, horizon, return_pct.  A row a candidate of a day's list and horizon; ranks from 1.
    """
    base = measured.groupBy("horizon", "day").agg(F.avg("return_pct").alias("_base"))
    rows = measured.join(base, ["horizon", "day"]).withColumn("band", (F.floor((F.col("rank") - 1) / band) * band + 1).cast("long"))
    return rows.groupBy("horizon", "band").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("day").alias("days"), F.avg("return_pct").alias("mean"),
        F.avg((F.col("return_pct") > 0).cast("double")).alias("hit_rate"), F.avg(F.col("return_pct") - F.col("_base")).alias("mean_excess"))
