"""Pre-registered statistics: every figure is a mean over days, so names of one day count once.

Day values are at most one row per (question, day); windows over them are bounded by the calendar.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from knownat.functions.numeric import col


def day_means(rows: DataFrame, keys: Sequence[str], value: Column | str, day: str = "day") -> DataFrame:
    return rows.groupBy(*keys, day).agg(F.avg(col(value)).alias("value"), F.count(col(value)).alias("names")).where("value IS NOT NULL")


def t_value(mean: Column, spread: Column, n: Column) -> Column:
    """Mean over its standard error; null under two values or without spread."""
    return F.when((n >= 2) & (spread > 0), mean / (spread / F.sqrt(n)))


def mean_t(days: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    agg = days.groupBy(*keys).agg(
        F.count(value).alias("days"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("_sd")
    )
    return agg.select(*keys, "days", "mean", t_value(F.col("mean"), F.col("_sd"), F.col("days")).alias("t"))


def split_days(days: DataFrame, holdout: int, *, keep_all_when_short: bool = False) -> DataFrame:
    """Flag the last ``holdout`` distinct days; optionally none when there are no more than that."""
    ordered = days.select("day").distinct()
    from_end = F.row_number().over(W.orderBy(F.col("day").desc()))
    flagged = ordered.select("day", from_end.alias("_k"), F.count(F.lit(1)).over(W.partitionBy(F.lit(1))).alias("_n"))
    held = F.col("_k") <= holdout
    if keep_all_when_short:
        held = held & (F.col("_n") > holdout)
    return flagged.select("day", held.alias("held"))


def halves(days: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Day values with ``half`` 1 for the first ``n div 2`` days and 2 for the rest."""
    w = W.partitionBy(*keys).orderBy("day")
    n = F.count(F.lit(1)).over(W.partitionBy(*keys))
    return days.withColumn("half", F.when(F.row_number().over(w) <= F.floor(n / 2), 1).otherwise(2))


ESTABLISHED, NOT_ESTABLISHED, TOO_FEW = "established", "not established", "not enough days"


def judge(
    values: DataFrame, split: DataFrame, keys: Sequence[str] = ("question",), *, min_days: int = 20, min_t: float = 2.0
) -> DataFrame:
    """Gate: enough study days, a hold-out, mean > 0, t high enough, both halves > 0, hold-out > 0."""
    tagged = values.join(split, "day")
    study = halves(tagged.where("NOT held"), keys)
    s = study.groupBy(*keys).agg(
        F.count("value").alias("days"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("_sd"),
        F.avg(F.when(F.col("half") == 1, F.col("value"))).alias("first_half"),
        F.avg(F.when(F.col("half") == 2, F.col("value"))).alias("second_half"),
    )
    h = tagged.where("held").groupBy(*keys).agg(F.count("value").alias("holdout_days"), F.avg("value").alias("holdout_mean"))
    out = s.join(h, list(keys), "full").withColumns({
        "days": F.coalesce("days", F.lit(0)), "holdout_days": F.coalesce("holdout_days", F.lit(0)),
        "t": t_value(F.col("mean"), F.col("_sd"), F.col("days")),
    }).drop("_sd")
    passed = (
        (F.col("mean") > 0) & (F.col("t") >= min_t) & (F.col("first_half") > 0) & (F.col("second_half") > 0)
        & (F.col("holdout_mean") > 0)
    )
    few = (F.col("days") < min_days) | (F.col("holdout_days") == 0)
    return out.withColumn(
        "state", F.when(few, TOO_FEW).when(F.coalesce(passed, F.lit(False)), ESTABLISHED).otherwise(NOT_ESTABLISHED)
    )


def forward_judge(
    values: DataFrame, keys: Sequence[str] = ("question",), *, sign: Column | None = None, read_days: int = 20,
    decide_days: int = 60, min_t: float = 2.0, infinite_t: bool = False,
) -> DataFrame:
    """Decide once on the first ``decide_days`` days, readable from ``read_days``; ``sign`` -1 predicts a loss."""
    w = W.partitionBy(*keys).orderBy("day")
    first = values.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= decide_days)
    marked = halves(first, keys)
    s = F.lit(1.0) if sign is None else F.max(sign)
    agg = marked.groupBy(*keys).agg(
        F.count("value").alias("days"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("_sd"),
        F.avg(F.when(F.col("half") == 1, F.col("value"))).alias("first_half"),
        F.avg(F.when(F.col("half") == 2, F.col("value"))).alias("second_half"), s.alias("_s"),
    ).withColumn("t", t_value(F.col("mean"), F.col("_sd"), F.col("days")))
    strong = F.col("t") * F.col("_s") >= min_t
    if infinite_t:
        strong = strong | (F.col("t").isNull() & (F.col("days") > 1) & (F.col("mean") * F.col("_s") > 0))
    passed = (F.col("mean") * F.col("_s") > 0) & strong & (F.col("first_half") * F.col("_s") > 0) & (
        F.col("second_half") * F.col("_s") > 0)
    state = F.when(F.col("days") < read_days, TOO_FEW).when(F.col("days") < decide_days, "reading").when(
        F.coalesce(passed, F.lit(False)), ESTABLISHED).otherwise(NOT_ESTABLISHED)
    return agg.withColumn("state", state).drop("_sd", "_s")


def paired_days(members: DataFrame, questions: dict[str, tuple[Column, Column | None, Column]]) -> DataFrame:
    """Per question and day: mean of the group minus mean of those it is compared with.

    ``questions`` maps a key to (group flag, comparison flag or None for the mean itself, measure).  All
    questions are answered by one aggregation over the members.
    """
    aggs = []
    for key, (group, against, measure) in questions.items():
        aggs.append(F.avg(F.when(group, measure)).alias(f"{key}_g"))
        if against is not None:
            aggs.append(F.avg(F.when(against, measure)).alias(f"{key}_o"))
    by_day = members.groupBy("day").agg(*aggs)
    parts = [
        F.struct(F.lit(k).alias("question"), (F.col(f"{k}_g") - F.col(f"{k}_o") if q[1] is not None else F.col(f"{k}_g")).alias("value"))
        for k, q in questions.items()
    ]
    return by_day.select("day", F.explode(F.array(*parts)).alias("_q")).select("day", "_q.*").where("value IS NOT NULL")


def spread(rows: DataFrame, keys: Sequence[str], *, good: Column, bad: Column, value: str = "value", day: str = "day") -> DataFrame:
    """Good minus bad: means of day means with a combined standard error."""
    side = F.when(good, "good").when(bad, "bad")
    daily = day_means(rows.withColumn("_side", side).where("_side IS NOT NULL"), [*keys, "_side"], value, day)
    per = daily.groupBy(*keys, "_side").agg(
        F.count("value").alias("d"), F.avg("value").alias("m"), (F.stddev_samp("value") / F.sqrt(F.count("value"))).alias("se")
    )
    pick = lambda c, s: F.max(F.when(F.col("_side") == s, F.col(c)))
    wide = per.groupBy(*keys).agg(
        *[pick(c, s).alias(f"{s}_{n}") for s in ("good", "bad") for c, n in (("d", "days"), ("m", "mean"), ("se", "se"))]
    )
    diff = F.col("good_mean") - F.col("bad_mean")
    se = F.sqrt(F.col("good_se") * F.col("good_se") + F.col("bad_se") * F.col("bad_se"))
    return wide.withColumns({
        "good_days": F.coalesce("good_days", F.lit(0)), "bad_days": F.coalesce("bad_days", F.lit(0)),
        "difference": diff, "t": F.when(se > 0, diff / se),
    })


def age_bucket(age_days: Column | str) -> Column:
    a = col(age_days)
    return (
        F.when(a < 1, "under 1 day").when(a < 3, "1-3 days").when(a < 7, "3-7 days").otherwise("7+ days")
    )


def sign_test(wins: Column | str, losses: Column | str) -> Column:
    """One-sided chance of at least ``wins`` successes in a fair coin; null without a trial.

    Adds up binomial terms from the top, in logarithms so large counts neither overflow nor vanish.
    """
    wins, losses = col(wins).cast("int"), col(losses).cast("int")
    n = wins + losses
    ks = F.when(losses > 0, F.sequence(n, wins + 1)).otherwise(F.array().cast("array<int>"))
    top = -n * F.lit(math.log(2.0))
    start = F.struct(top.alias("log_term"), F.exp(top).alias("total"))

    def step(s: Column, k: Column) -> Column:
        lower = s["log_term"] + F.log(k.cast("double")) - F.log((n - k + 1).cast("double"))
        return F.struct(lower.alias("log_term"), (s["total"] + F.exp(lower)).alias("total"))

    return F.when(n > 0, F.aggregate(ks, start, step, lambda s: s["total"]))


MAX_REGRESSORS = 500


def ols_cluster(rows: DataFrame, y: str, regressors: Sequence[str], clusters: str, target: str,
                group: str | None = None) -> dict:
    """OLS with group fixed effects and cluster-robust (CR1) errors.

    Rows become sparse (regressor, value) pairs; X'X, X'y and the sum of squared cluster scores are Spark
    aggregates, and only k x k matrices (k checked) reach the driver.  Constant and collinear columns are
    dropped in order; the first level of ``group`` is the base.
    """
    cells = [F.struct(F.lit("const").alias("j"), F.lit(1.0).alias("x"))]
    cells += [F.struct(F.lit(r).alias("j"), F.col(r).cast("double").alias("x")) for r in regressors]
    if group is not None:
        cells.append(F.struct(F.concat(F.lit("fe:"), F.col(group).cast("string")).alias("j"), F.lit(1.0).alias("x")))
    data = rows.select(F.col(y).cast("double").alias("_y"),
                       F.col(clusters).alias("_c"), F.filter(F.array(*cells), lambda c: c["x"] != 0).alias("_x"))
    pairs = data.select("_y", F.explode("_x").alias("a"), "_x").select("_y", "a", F.explode("_x").alias("b"))
    gram_rows = pairs.groupBy(F.col("a.j").alias("i"), F.col("b.j").alias("j")).agg(F.sum(F.col("a.x") * F.col("b.x")).alias("v"))
    xy_rows = data.select("_y", F.explode("_x").alias("a")).groupBy(F.col("a.j").alias("i")).agg(
        F.sum(F.col("a.x") * F.col("_y")).alias("v"), F.count(F.lit(1)).alias("n"))
    xy_list = xy_rows.limit(MAX_REGRESSORS + 1).collect()
    if len(xy_list) > MAX_REGRESSORS:
        raise ValueError("too many regressors for a driver-side solve")
    xy = {r["i"]: r["v"] for r in xy_list}
    if not xy:
        return {"b": None, "t": None, "n": 0, "clusters": 0, "dropped": ""}
    gram = {(r["i"], r["j"]): r["v"] for r in gram_rows.collect()}
    n = int(round(gram[("const", "const")]))
    levels = sorted(k for k in xy if k.startswith("fe:"))[1:]
    kept, dropped = ["const"], []
    # target first, then fixed effects, then the remaining controls
    for name in [*regressors[:1], *levels, *regressors[1:]]:
        s, s2 = gram.get((name, "const"), 0.0), gram.get((name, name), 0.0)
        trial = [*kept, name]
        g = np.array([[gram.get((a, b), 0.0) for b in trial] for a in trial])
        scale = np.sqrt(np.outer(np.diag(g), np.diag(g)))
        if abs(n * s2 - s * s) < 1e-9 * max(1.0, n * s2) or np.linalg.matrix_rank(g / np.where(scale > 0, scale, 1.0), tol=1e-9) < len(trial):
            dropped.append(name)
        else:
            kept = trial
    if target not in kept:
        count = data.select("_c").distinct().count()
        return {"b": None, "t": None, "n": n, "clusters": count, "dropped": ",".join(dropped)}
    g = np.array([[gram.get((a, b), 0.0) for b in kept] for a in kept])
    inverse = np.linalg.inv(g)
    beta = inverse @ np.array([xy.get(k, 0.0) for k in kept])
    effect = F.lit(0.0)
    coefficients = F.create_map(*[v for k, b in zip(kept, beta) for v in (F.lit(k), F.lit(float(b)))])
    fitted = F.aggregate("_x", effect, lambda acc, c: acc + c["x"] * F.coalesce(F.try_element_at(coefficients, c["j"]), F.lit(0.0)))
    scores = data.withColumn("_e", F.col("_y") - fitted).select("_c", "_e", F.explode("_x").alias("a")).where(
        F.col("a.j").isin(kept)).groupBy("_c", F.col("a.j").alias("j")).agg(F.sum(F.col("a.x") * F.col("_e")).alias("s"))
    packed = scores.groupBy("_c").agg(F.collect_list(F.struct("j", "s")).alias("_s"))  # at most k entries
    outer = packed.select(F.explode("_s").alias("a"), "_s").select("a", F.explode("_s").alias("b")).groupBy(
        F.col("a.j").alias("i"), F.col("b.j").alias("j")).agg(F.sum(F.col("a.s") * F.col("b.s")).alias("v"))
    meat = {(r["i"], r["j"]): r["v"] for r in outer.collect()}
    clusters_n = packed.count()
    k, at = len(kept), kept.index(target)
    b = float(beta[at])
    if clusters_n < 2 or n <= k:
        return {"b": b, "t": None, "n": n, "clusters": clusters_n, "dropped": ",".join(dropped)}
    m = np.array([[meat.get((a, c), 0.0) for c in kept] for a in kept])
    cov = clusters_n / (clusters_n - 1) * (n - 1) / (n - k) * inverse @ m @ inverse
    se = math.sqrt(cov[at, at]) if cov[at, at] > 0 else 0.0
    return {"b": b, "t": b / se if se else None, "n": n, "clusters": clusters_n, "dropped": ",".join(dropped)}


# ------------------------------------------------------------------ the overlay decision

MIN_DAYS_PER_SIDE, MIN_DAYS_PER_SPLIT, OVERLAY_MIN_T = 20, 5, 2.0
DECISION_DAYS, EXTENDED_DAYS = 60, 120
GOOD_NEWS, BAD_NEWS = 1.0, -1.0


def overlay_review(records: DataFrame) -> DataFrame:
    """Decide once: on the first 60 entry days, or the first 120 when news was thin in the first 60.

    ``records``: day, excess, overlay_points, regime.  One row: sample, good-minus-bad spread, its halves and
    regimes, and whether the question passed.
    """
    good, bad = F.col("overlay_points") >= GOOD_NEWS, F.col("overlay_points") <= BAD_NEWS
    days = records.select("day").distinct().withColumn("_k", F.row_number().over(W.orderBy("day")))
    ranked = records.join(days, "day")
    trial = ranked.select(
        "excess", "overlay_points", "day",
        F.explode(F.array_compact(F.array(
            F.when(F.col("_k") <= DECISION_DAYS, F.lit(DECISION_DAYS)), F.when(F.col("_k") <= EXTENDED_DAYS, F.lit(EXTENDED_DAYS)),
        ))).alias("gate"),
    )
    sides = spread(trial, ["gate"], good=good, bad=bad, value="excess")
    enough = (F.col("good_days") >= MIN_DAYS_PER_SIDE) & (F.col("bad_days") >= MIN_DAYS_PER_SIDE)
    thick = sides.agg(F.max(F.when((F.col("gate") == DECISION_DAYS) & enough, 1)).alias("_ok60"))
    total = days.agg(F.max("_k").alias("entry_days"))
    sample = total.join(thick, F.col("entry_days").isNotNull(), "left").select(
        "entry_days",
        F.when(F.col("entry_days") < DECISION_DAYS, F.lit(None))
        .when(F.col("_ok60") == 1, DECISION_DAYS).when(F.col("entry_days") >= EXTENDED_DAYS, EXTENDED_DAYS).cast("int").alias("sample_days"),
    )
    chosen = ranked.join(sample, F.col("_k") <= F.coalesce("sample_days", "entry_days"))
    middle = F.floor(F.least(F.coalesce("sample_days", "entry_days"), F.col("entry_days")) / 2)
    slices = F.array_compact(F.array(
        F.lit("whole"), F.when(F.col("_k") <= middle, "first_half").otherwise("second_half"),
        F.when(F.col("regime") == "RISK_ON", "risk_on").when(F.col("regime") != "UNKNOWN", "other_regimes"),
    ))
    per = spread(chosen.select("day", "excess", "overlay_points", F.explode(slices).alias("slice")), ["slice"], good=good, bad=bad, value="excess")
    tested = (F.col("good_days") >= MIN_DAYS_PER_SPLIT) & (F.col("bad_days") >= MIN_DAYS_PER_SPLIT)
    held = F.when(tested, F.coalesce(F.col("difference") > 0, F.lit(False)))

    def of(name: str, value: Column) -> Column:
        return F.max(F.when(F.col("slice") == name, value))

    row = per.agg(
        of("whole", F.col("good_days")).alias("good_days"), of("whole", F.col("bad_days")).alias("bad_days"),
        of("whole", F.col("difference")).alias("difference"), of("whole", F.col("t")).alias("t"),
        *[of(n, held).alias(n) for n in ("first_half", "second_half", "risk_on", "other_regimes")],
    )
    strong = (F.col("difference") > 0) & (F.col("t") >= OVERLAY_MIN_T)
    passed = (
        (F.col("good_days") >= MIN_DAYS_PER_SIDE) & (F.col("bad_days") >= MIN_DAYS_PER_SIDE) & strong
        & F.coalesce("first_half", F.lit(False)) & F.coalesce("second_half", F.lit(False))
        & F.coalesce("risk_on", F.lit(True)) & F.coalesce("other_regimes", F.lit(True))
    )
    ready = F.col("sample_days").isNotNull()
    return sample.join(row, F.col("entry_days").isNotNull(), "left").withColumns({
        "ready": ready, "passed": F.coalesce(ready & passed, F.lit(False)),
    })


def by_age(observations: DataFrame) -> DataFrame:
    """Signed excess by the age of the event: ``age_days, day, value``; negative ages are dropped."""
    rows = observations.where("age_days >= 0").withColumn("bucket", age_bucket("age_days"))
    return mean_t(day_means(rows, ["bucket"], "value"), ["bucket"])


def gate_dates(asks: DataFrame, spine: DataFrame, sessions: DataFrame) -> DataFrame:
    """Earliest close at which a gate of ``need`` days can be met given ``have`` of them on ``day``."""
    last = sessions.agg(F.max("ordinal").alias("_last"), F.max("day").alias("_last_day"))
    on_or_after = spine.select("day", (F.col("ordinal_upto") + F.when(F.col("is_session"), 0).otherwise(1)).alias("_from"))
    joined = asks.join(on_or_after, "day").join(last, F.col("day").isNotNull())
    at = F.least(F.col("_from") + F.col("need") - F.col("have") + F.col("horizon") - 1, F.col("_last"))
    open_gate = (F.col("have") < F.col("need")) & (F.col("day") < F.col("_last_day"))
    wanted = joined.withColumn("ordinal", F.when(open_gate, at))
    return wanted.join(sessions.select("ordinal", F.col("close_at").alias("earliest")), "ordinal", "left").select(*asks.columns, "earliest")
