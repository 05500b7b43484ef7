"""Technical and fundamental factors, freshness, and the combined signal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from knownat.functions import numeric as num
from knownat.operators import indicators as ind
from knownat.operators import pit

MIN_BARS = 60
MIN_METRICS = 3
MIN_PEERS = 5
WEIGHTS = {"technical": 0.6, "fundamental": 0.4}
BUY_INTEREST, CAUTION = 70.0, 35.0
STRATEGY_VERSION = "cross-sectional-fundamental-3"


def metric(name: str, raw: Column, normalized: Column) -> Column:
    """A metric struct, or null when it could not be computed."""
    return F.when(
        normalized.isNotNull(),
        F.struct(F.lit(name).alias("name"), raw.cast("double").alias("raw"), normalized.cast("double").alias("normalized")),
    )


def mean_score(metrics: Column) -> Column:
    total = F.aggregate(metrics, F.lit(0.0), lambda a, m: a + m["normalized"])
    return num.clamp(F.try_divide(total, F.size(metrics)))


# ------------------------------------------------------------------ technical

def technical_inputs(bars: DataFrame) -> DataFrame:
    """Every indicator of the technical factor per (instrument, day): windows over one sort, then the recursive ones in one pass over the same groups."""
    upper, _, lower = ind.bollinger("close")
    staged = bars.select(
        "instrument_id", "day", "close", "volume",
        F.count(F.lit(1)).over(ind.frame(ind.HISTORY)).alias("bars"),
        ind.sma("close", 20).alias("ma20"),
        ind.sma("close", 60).alias("ma60"),
        ind.zscore("volume", 20).alias("volume_z"),
        upper.alias("_upper"), lower.alias("_lower"),
    )
    return ind.recursive(staged, ["rsi", "histogram"]).select(
        "instrument_id", "day", "close", "volume", "bars", "ma20", "ma60", "volume_z",
        "rsi",
        num.percent_distance("close", "ma20").alias("ma20_distance"),
        num.percent_distance("ma20", "ma60").alias("trend_spread"),
        ind.band_position("close", F.col("_upper"), F.col("_lower")).alias("band_position"),
        F.col("histogram").alias("macd_histogram"),
    )


def technical_factor(inputs: DataFrame) -> DataFrame:
    """Mean of the available metrics, each on 0..100; unavailable under ``MIN_BARS`` bars."""
    metrics = F.array_compact(F.array(
        metric("RSI", F.col("rsi"), num.peak_at("rsi", 55.0, 45.0)),
        metric("MA20 distance", F.col("ma20_distance"), num.bounded("ma20_distance", -10.0, 10.0)),
        metric("MA20/MA60 spread", F.col("trend_spread"), num.bounded("trend_spread", -10.0, 10.0)),
        metric("Volume z-score", F.col("volume_z"), num.bounded("volume_z", -2.0, 3.0)),
        metric("Bollinger position", F.col("band_position"), num.clamp(F.col("band_position") * 100.0)),
        metric("MACD histogram", F.col("macd_histogram"),
               num.bounded(F.try_divide("macd_histogram", "close") * 100.0, -2.0, 2.0)),
    ))
    ready = F.col("bars") >= MIN_BARS
    out = inputs.withColumn("metrics", F.when(ready, metrics))
    return out.withColumn("technical_score", mean_score(F.col("metrics"))).withColumn(
        "technical_available", ready
    ).withColumn(
        "technical_reason",
        F.when(~ready, F.format_string("%d daily bars; the 60-day mean needs %d", F.col("bars"), F.lit(MIN_BARS))),
    )


def technical_reasons(inputs: DataFrame) -> DataFrame:
    """Evidence lines of the technical factor, one row per (instrument, day, metric)."""
    def line(name: str, value: str, status: Column, text: Column) -> Column:
        return F.when(F.col(value).isNotNull(), F.struct(F.lit(name).alias("metric"), status.alias("status"), text.alias("text")))

    rsi, dist, spread, z = (F.col(c) for c in ("rsi", "ma20_distance", "trend_spread", "volume_z"))
    lines = F.array(
        line("RSI", "rsi", F.when((rsi >= 70) | (rsi <= 30), "OPPOSES").otherwise("SUPPORTS"),
             F.when(rsi >= 70, "overbought").when(rsi <= 30, "oversold").otherwise("no extreme")),
        line("MA20 distance", "ma20_distance",
             F.when(dist > 1, "SUPPORTS").when(dist < -1, "OPPOSES").otherwise("NEUTRAL"),
             F.when(dist > 1, "above its 20-day mean").when(dist < -1, "below its 20-day mean").otherwise("near its 20-day mean")),
        line("MA20/MA60 spread", "trend_spread", F.when(spread > 0, "SUPPORTS").otherwise("OPPOSES"),
             F.when(spread > 0, "rising trend").otherwise("falling trend")),
        line("Volume z-score", "volume_z", F.when(z >= 1, "SUPPORTS").when(z <= -1, "OPPOSES").otherwise("NEUTRAL"),
             F.when(z >= 1, "more volume than usual").when(z <= -1, "less volume than usual").otherwise("usual volume")),
        line("MACD histogram", "macd_histogram", F.when(F.col("macd_histogram") > 0, "SUPPORTS").otherwise("OPPOSES"),
             F.when(F.col("macd_histogram") > 0, "positive").otherwise("negative")),
    )
    rows = inputs.where(F.col("bars") >= MIN_BARS)
    return rows.select("instrument_id", "day", F.explode(F.array_compact(lines)).alias("_l")).select("instrument_id", "day", "_l.*")


# ------------------------------------------------------------------ fundamental

RATIOS = ("roe", "debt_ratio", "op_margin", "growth")


def ratios(snapshots: DataFrame) -> DataFrame:
    """The four comparable ratios; null where an input is missing or its denominator says nothing."""
    c = F.col
    rfc = "RevenueFromContractWithCustomerExcludingAssessedTax"
    revenue = F.coalesce(c(rfc), c("Revenues"))
    prior = F.coalesce(c(f"prior_{rfc}"), c("prior_Revenues"))
    return snapshots.withColumns({
        "revenue": revenue,
        "prior_revenue": prior,
        "roe": F.when(c("StockholdersEquity") > 0, c("NetIncomeLoss") / c("StockholdersEquity")),
        "debt_ratio": F.when(c("Assets") > 0, c("Liabilities") / c("Assets")),
        "op_margin": F.when(revenue > 0, c("OperatingIncomeLoss") / revenue),
        "growth": F.when(prior > 0, (revenue - prior) / prior),
    })


def peer_positions(ratio_rows: DataFrame, population: Sequence[str], member: Sequence[str] = ("instrument_id",)) -> DataFrame:
    """Midpoint rank of every ratio inside its population, e.g. (market, instant).

    One long pass for all ratios: a population holds one row per listed instrument, so its window is
    bounded by the size of a market.
    """
    keys = [*population, *member]
    long = ratio_rows.select(
        *keys,
        F.explode(F.array(*[F.struct(F.lit(r).alias("ratio"), F.col(r).alias("value")) for r in RATIOS])).alias("_m"),
    ).select(*keys, "_m.*").where("value IS NOT NULL")
    w = W.partitionBy(*population, "ratio").orderBy("value")
    same = w.rangeBetween(0, 0)
    ranked = long.select(
        *keys, "ratio",
        ((F.rank().over(w) - 1 + 0.5 * F.count(F.lit(1)).over(same)) / F.count(F.lit(1)).over(W.partitionBy(*population, "ratio")) * 100.0).alias("p"),
        F.count(F.lit(1)).over(W.partitionBy(*population, "ratio")).alias("n"),
    )
    cols = []
    for r in RATIOS:
        cols += [F.max(F.when(F.col("ratio") == r, F.col("p"))).alias(f"{r}_rank"),
                 F.coalesce(F.max(F.when(F.col("ratio") == r, F.col("n"))), F.lit(0)).alias(f"{r}_peers")]
    return ranked.groupBy(*keys).agg(*cols)


def _placed(name: str, fixed: Column, *, invert: bool = False) -> Column:
    rank = F.col(f"{name}_rank")
    ranked = 100.0 - rank if invert else rank
    return F.when(F.col(name).isNotNull(), F.when(F.col(f"{name}_peers") >= MIN_PEERS, ranked).otherwise(fixed))


def fundamental_factor(rows: DataFrame) -> DataFrame:
    """Score of a snapshot with its ``price``, ratios and peer ranks.

    P/E keeps an absolute scale (a loss scores 0); each of the other four is ranked among at least
    five peers of its own, else mapped onto a fixed scale; ``*_scale`` says which, null without the ratio.  At least three metrics, one of them a profitability metric, are needed.
    """
    c = F.col
    eps = c("EarningsPerShareBasic")
    per = F.when(eps > 0, c("price") / eps)
    per_score = F.when(c("price").isNotNull() & eps.isNotNull(), F.when(eps <= 0, F.lit(0.0)).otherwise(num.peak_at(per, 15.0, 25.0)))
    equity, income = c("StockholdersEquity"), c("NetIncomeLoss")
    roe_score = F.when(income.isNotNull() & (equity < 0), F.lit(0.0)).otherwise(_placed("roe", num.bounded("roe", 0.0, 0.30)))
    scales = {
        f"{n}_scale": F.when(c(ratio).isNotNull(), F.when(F.coalesce(c(f"{ratio}_peers"), F.lit(0)) >= MIN_PEERS, "ranked").otherwise("fixed"))
        for n, ratio in (("roe", "roe"), ("debt", "debt_ratio"), ("margin", "op_margin"), ("growth", "growth"))
    }
    staged = rows.withColumns(scales | {
        "per": per,
        "per_score": per_score,
        "roe_score": roe_score,
        "debt_score": _placed("debt_ratio", num.bounded("debt_ratio", 0.2, 0.8, invert=True), invert=True),
        "margin_score": _placed("op_margin", num.bounded("op_margin", 0.0, 0.30)),
        "growth_score": _placed("growth", num.bounded("growth", -0.20, 0.40)),
    })
    metrics = F.array_compact(F.array(
        metric("P/E", F.coalesce(per, F.lit(0.0)), c("per_score")),
        metric("ROE", F.coalesce(c("roe") * 100.0, F.lit(0.0)), c("roe_score")),
        metric("Debt ratio", c("debt_ratio") * 100.0, c("debt_score")),
        metric("Operating margin", c("op_margin") * 100.0, c("margin_score")),
        metric("Revenue growth", c("growth") * 100.0, c("growth_score")),
    ))
    staged = staged.withColumn("fundamental_metrics", metrics)
    count = F.size("fundamental_metrics")
    profitable = c("roe_score").isNotNull() | c("margin_score").isNotNull()
    absent = F.filter(
        F.array(*[F.when(c(n).isNull(), F.lit(n)) for n in pit.SNAPSHOT_CONCEPTS]), lambda x: x.isNotNull()
    )
    more = F.size(absent) - 1
    missing = F.when(
        F.size(absent) > 0,
        F.concat(F.lit("no value: "), F.element_at(absent, 1), F.when(more > 0, F.format_string(" and %d more", more)).otherwise("")),
    ).when(c("price").isNull(), "no price for a value ratio").otherwise("no financial inputs")
    reason = (
        F.when(count == 0, missing)
        .when(count < MIN_METRICS, F.format_string("only %d of %d ratios", count, F.lit(MIN_METRICS)))
        .when(~profitable, "no profitability ratio")
    )
    return staged.withColumns({
        "fundamental_reason": reason,
        "fundamental_available": reason.isNull(),
        "fundamental_score": F.when(reason.isNull(), mean_score(c("fundamental_metrics"))),
        "fundamental_count": count,
    })


def fundamental_reasons(rows: DataFrame) -> DataFrame:
    """Evidence status of every ratio, long."""
    c = F.col
    eps, per = c("EarningsPerShareBasic"), c("per")

    def line(name: str, status: Column) -> Column:
        return F.when(status.isNotNull(), F.struct(F.lit(name).alias("metric"), status.alias("status")))

    lines = F.array(
        line("P/E", F.when(c("per_score").isNull(), None).when(eps <= 0, "OPPOSES").when(per > 27.5, "OPPOSES")
             .when(per < 2.5, "NEUTRAL").otherwise("SUPPORTS")),
        line("ROE", F.when(c("roe_score").isNull(), None).when(c("StockholdersEquity") < 0, "OPPOSES")
             .when(c("roe") >= 0.15, "SUPPORTS").when(c("roe") <= 0, "OPPOSES").otherwise("NEUTRAL")),
        line("Debt ratio", F.when(c("debt_ratio").isNull(), None).when(c("debt_ratio") >= 0.7, "OPPOSES").otherwise("SUPPORTS")),
        line("Operating margin", F.when(c("op_margin").isNull(), None).when(c("op_margin") <= 0, "OPPOSES")
             .when(c("op_margin") >= 0.20, "SUPPORTS").otherwise("NEUTRAL")),
        line("Revenue growth", F.when(c("growth").isNull(), None).when(c("growth") >= 0.10, "SUPPORTS")
             .when(c("growth") < 0, "OPPOSES").otherwise("NEUTRAL")),
    )
    return rows.select("instrument_id", F.explode(F.array_compact(lines)).alias("_l")).select("instrument_id", "_l.*")


def snapshots_over_time(facts: DataFrame, keys: Sequence[str] = ("instrument_id",)) -> DataFrame:
    """One anchored snapshot per instrument and instant at which its knowledge changed.

    Linear in the number of revisions: a running maximum finds the anchor known at each instant, then
    instants and revisions of the same fiscal period are merged in time order and the newest revision
    of every concept is carried forward.  Nothing is rebuilt between change instants.
    """
    keys = list(keys)
    annual = facts.where(F.when(F.col("period_start").isNotNull(), pit.duration_ok(12)).otherwise(True))
    by_time = W.partitionBy(*keys).orderBy("available_at").rangeBetween(W.unboundedPreceding, 0)
    anchor_of = [
        F.max(F.when((F.col("concept") == a) & F.col("period_start").isNotNull(), F.col("period_end"))).over(by_time)
        for a in pit.ANCHORS
    ]
    changes = annual.groupBy(*keys, "available_at", "concept", "period_start", "period_end").agg(F.lit(1).alias("_"))
    instants = (
        changes.withColumn("anchor_end", F.coalesce(*anchor_of))
        .groupBy(*keys, "available_at").agg(F.max("anchor_end").alias("anchor_end"))
    )
    order = ["filed_at", "id"]
    revisions = annual.groupBy(*keys, "concept", "period_end", "period_start", "available_at").agg(
        F.max_by("value", F.struct(*order)).alias("value"), F.max(F.struct(*order)).alias("_filed")
    )
    none = F.lit(None).cast("double")
    # revisions at the anchor period itself
    own = revisions.select(
        *keys, F.col("period_end").alias("anchor_end"), "available_at", F.lit(0).alias("_ask"), "_filed",
        F.col("concept").alias("_slot"), "value",
    )
    # revenues of the annual period before an anchor: at most one or two fiscal periods fall in reach
    anchors = instants.where("anchor_end IS NOT NULL").select(*keys, "anchor_end").distinct()
    revenue = revisions.where(F.col("concept").isin(*pit.SNAPSHOT_CONCEPTS[:2]) & F.col("period_start").isNotNull())
    gap = F.datediff("anchor_end", "period_end")
    prior = revenue.join(anchors, keys).where((gap > 0) & (gap <= pit.ANNUAL_ADJACENCY_DAYS)).select(
        *keys, "anchor_end", "available_at", F.lit(0).alias("_ask"), "_filed",
        F.concat(F.lit("prior_"), "concept").alias("_slot"), "value",
    )
    asks = instants.where("anchor_end IS NOT NULL").select(
        *keys, "anchor_end", "available_at", F.lit(1).alias("_ask"),
        F.lit(None).cast(revisions.schema["_filed"].dataType).alias("_filed"), F.lit("").alias("_slot"), none.alias("value"),
    )
    merged = own.unionByName(prior).unionByName(asks)
    w = W.partitionBy(*keys, "anchor_end").orderBy("available_at", "_ask", "_filed").rowsBetween(W.unboundedPreceding, 0)
    slots = [*pit.SNAPSHOT_CONCEPTS, *[f"prior_{c}" for c in pit.SNAPSHOT_CONCEPTS[:2]]]
    carried = merged.select(
        *keys, "anchor_end", "available_at", "_ask",
        *[F.last(F.when(F.col("_slot") == s, F.col("value")), ignorenulls=True).over(w).alias(s) for s in slots],
    )
    return carried.where("_ask = 1").drop("_ask")


def as_of_snapshots(points: DataFrame, snapshots: DataFrame, at: str, keys: Sequence[str] = ("instrument_id",)) -> DataFrame:
    """Attach to each point the last snapshot at or before ``at`` (union and carry forward, no range join)."""
    keys = list(keys)
    value_cols = [c for c in snapshots.columns if c not in (*keys, "available_at")]
    packed = snapshots.select(*keys, F.col("available_at").alias("_t"), F.lit(0).alias("_ask"), F.struct(*value_cols).alias("_snap"))
    point_cols = [c for c in points.columns if c not in keys]
    asked = points.select(*keys, F.col(at).alias("_t"), F.lit(1).alias("_ask"), F.struct(*point_cols).alias("_point"))
    merged = packed.unionByName(asked, allowMissingColumns=True)
    w = W.partitionBy(*keys).orderBy("_t", "_ask").rowsBetween(W.unboundedPreceding, 0)
    out = merged.withColumn("_snap", F.last("_snap", ignorenulls=True).over(w)).where("_ask = 1")
    return out.select(*keys, "_point.*", "_snap.*")


# ------------------------------------------------------------------ freshness and combination

def freshness(rule: str, *, asof: str = "source_asof", now: str = "now", checked: str = "checked_at", limit: int = 1,
              behind: str = "behind") -> Column:
    """FRESH / STALE / MISSING.

    ``sessions``: at most ``limit`` sessions behind; ``wall_clock``: at most ``limit`` hours old;
    ``source_check``: the source was looked at within ``limit`` days, and a missing check is stale.
    """
    missing = F.col(asof).isNull()
    if rule == "sessions":
        fresh = F.col(behind) <= limit
    elif rule == "wall_clock":
        fresh = F.col(now) <= F.timestamp_add("HOUR", F.lit(limit), F.col(asof))
    elif rule == "source_check":
        fresh = F.col(checked).isNotNull() & (F.col(now) <= F.timestamp_add("DAY", F.lit(limit), F.col(checked)))
    else:
        raise ValueError(f"unknown freshness rule {rule!r}")
    return F.when(missing, "MISSING").when(fresh, "FRESH").otherwise("STALE")


def effective_weight(requested: float, available: Column, fresh: Column) -> Column:
    """Requested weight if the factor computed and its data is fresh, else 0."""
    return F.when(available & fresh, F.lit(requested)).otherwise(F.lit(0.0))


def renormalized(weights: dict[str, Column]) -> dict[str, Column]:
    """Surviving weights rescaled to sum to one (all zero when none survives)."""
    total = sum(weights.values(), F.lit(0.0))
    return {k: F.coalesce(F.try_divide(w, total), F.lit(0.0)) for k, w in weights.items()}


def action_for(score: Column, weight: Column, buy: float = BUY_INTEREST, caution: float = CAUTION) -> Column:
    """Thresholds scale with the weight that took part; nothing taking part is an abstention."""
    return (
        F.when(weight <= 0, "ABSTAINED").when(score >= weight * buy, "BUY_INTEREST")
        .when(score <= weight * caution, "CAUTION").otherwise("WATCH")
    )


def combine(rows: DataFrame, *, technical_fresh: Column | None = None, fundamental_fresh: Column | None = None,
            buy: float = BUY_INTEREST, caution: float = CAUTION) -> DataFrame:
    """Weighted total and action; the technical factor is required, so without it the rule abstains."""
    yes = F.lit(True)
    tw = effective_weight(WEIGHTS["technical"], F.col("technical_available"), technical_fresh if technical_fresh is not None else yes)
    fw = effective_weight(WEIGHTS["fundamental"], F.coalesce("fundamental_available", F.lit(False)),
                          fundamental_fresh if fundamental_fresh is not None else yes)
    out = rows.withColumns({"technical_weight": tw, "fundamental_weight": fw})
    total = F.coalesce("technical_score", F.lit(0.0)) * F.col("technical_weight") + F.coalesce(
        "fundamental_score", F.lit(0.0)) * F.col("fundamental_weight")
    weight = F.col("technical_weight") + F.col("fundamental_weight")
    abstain = F.col("technical_weight") == 0
    return out.withColumns({
        "weight_total": weight,
        "total_score": F.when(abstain, F.lit(0.0)).otherwise(total),
        "action": F.when(abstain, "ABSTAINED").otherwise(action_for(total, weight, buy, caution)),
    }).withColumn("judged_score", judged_score(F.col("total_score"), F.col("weight_total"), F.col("action")))


def checked_clocks(rows: DataFrame) -> DataFrame:
    """Fail the job on a decision before its data or an execution not after its decision."""
    bad = (F.col("decision_at") < F.col("data_asof")) | (F.col("earliest_execution_at") <= F.col("decision_at"))
    guard = F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit("a judgement cannot predate its inputs or follow its fill")))
    return rows.withColumn("decision_at", F.coalesce(guard.cast("timestamp"), F.col("decision_at")))


def judged_score(total: Column, weight: Column, action: Column) -> Column:
    """Total over the participating weight; null when the rule abstained."""
    return F.when(action != "ABSTAINED", F.try_divide(total, weight))


def signal_rows(rows: DataFrame) -> DataFrame:
    """The stored decomposition: metric -> factor -> signal, as nested columns."""
    def factor(engine: str, metrics: str) -> Column:
        score = F.coalesce(F.col(f"{engine}_score"), F.lit(0.0))
        weight = F.col(f"{engine}_weight")
        return F.struct(
            F.lit(engine.upper()).alias("engine"), score.alias("score"), F.lit(WEIGHTS[engine]).alias("requested_weight"),
            weight.alias("effective_weight"), (score * weight).alias("contribution"),
            F.when(weight > 0, "AVAILABLE").otherwise("UNAVAILABLE").alias("availability"),
            F.col(f"{engine}_reason").alias("reason"), F.col(metrics).alias("metrics"),
        )

    return rows.select(
        "instrument_id", "day", "data_asof", "decision_at", "earliest_execution_at", "total_score", "action",
        "judged_score", F.lit(STRATEGY_VERSION).alias("strategy_version"),
        F.array(factor("technical", "metrics"), factor("fundamental", "fundamental_metrics")).alias("factors"),
    )


def top_per_category(rows: DataFrame, keys: Sequence[str], scores: dict[str, str], *, limit: int = 3, rank: str = "rank") -> DataFrame:
    """The best ``limit`` rows per category; ties keep the list rank."""
    pairs = F.array(*[F.struct(F.lit(k).alias("category"), F.col(c).alias("score")) for k, c in scores.items()])
    long = rows.select("*", F.explode(pairs).alias("_p")).select("*", "_p.*").drop("_p").where("score IS NOT NULL")
    w = W.partitionBy(*keys, "category").orderBy(F.col("score").desc(), rank)
    return long.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)
