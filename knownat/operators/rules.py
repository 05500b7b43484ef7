"""Entry and exit rules over the first hour, and the rule laboratory.

Every rule is a set of column aggregates over a name-day's bars before 10:00 (at most 60), so a whole
grid of rules is one ``groupBy`` and no rule is replayed bar by bar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from knownat.functions import numeric as num
from knownat.operators import stats

# Fixed values of the registered study: cost per round trip, times as minutes from 09:00, gates.
COST = 0.003
CONFIRM, AFTER_CONFIRM, BREAKOUT_LAST = 4, 5, 29
STOP, TAKE = 0.02, 0.03
HOLDOUT_DAYS, MIN_DAYS, MIN_T = 15, 20, 2.5
TAKES = (0.025, 0.03, 0.05)
STOPS: tuple[float | None, ...] = (None, 0.01, 0.015, 0.02, 0.03)
HEADLINE = ((0.025, None), (0.025, 0.02), (0.05, 0.01))
DAY = ("instrument_id", "day")


def first_hour(bars: DataFrame) -> DataFrame:
    """Bars before 10:00 whose four prices are finite and positive, with the 09:00 open as ``entry``.

    ``entry`` is null for name-days without a 09:00 bar: no rule applies to them.
    """
    ok = F.lit(True)
    for c in ("open", "high", "low", "close"):
        ok = ok & (F.col(c) > 0) & ~F.isnan(c) & (F.col(c) < F.lit(float("inf")))
    hour = bars.where((F.col("minute") < 60) & ok)
    return hour.withColumn("entry", F.max(F.when(F.col("minute") == 0, F.col("open"))).over(W.partitionBy(*DAY)))


def first_trade_as_open(bars: DataFrame) -> DataFrame:
    """Relabel the first valid bar of a name-day as 09:00 when there is none."""
    first = F.min("minute").over(W.partitionBy(*DAY))
    return bars.withColumn("minute", F.when(F.col("minute") == first, F.lit(0)).otherwise(F.col("minute")).cast("long"))


def _last_close() -> Column:
    return F.max_by("close", "minute")


def exits(hour: DataFrame, rules: Sequence[tuple[float, float | None]]) -> DataFrame:
    """Return of every take/stop rule per name-day, long: ``take, stop, ret`` (null stop: none).

    Within a bar the order is: gap through the stop, gap through the take, stop, take.  A take needs the
    price to trade through it, a stop sells one tick below.  Rules are exploded inside the partition that
    already holds the name-day, so the grid adds no shuffle.
    """
    table = F.array(*[F.struct(F.lit(t).alias("take"), F.lit(s).cast("double").alias("stop")) for t, s in rules])
    e = F.col("entry")
    staged = hour.where("entry > 0").select("*", F.explode(table).alias("_rule")).select("*", "_rule.*").drop("_rule")
    staged = staged.withColumns({"_target": num.round_up(e * (1 + F.col("take"))), "_floor": e * (1 - F.col("stop"))})
    staged = staged.withColumns({"_at_open": num.sell_below("open"), "_at_floor": num.sell_below("_floor")})
    booked = F.col("_target") / e - 1
    chain = (
        F.when(F.col("minute") == 0, F.lit(None).cast("double"))
        .when(F.col("open") <= F.col("_floor"), F.col("_at_open") / e - 1)
        .when(F.col("open") >= F.col("_target"), booked)
        .when(F.col("low") <= F.col("_floor"), F.col("_at_floor") / e - 1)
        .when(F.col("high") > F.col("_target"), booked)
    )
    staged = staged.withColumn("_booked", chain)
    agg = staged.groupBy(*DAY, "take", "stop").agg(
        F.min_by("_booked", F.when(F.col("_booked").isNotNull(), F.col("minute"))).alias("_first"),
        F.first("entry").alias("_e"), _last_close().alias("_last"),
    )
    return agg.select(*DAY, "take", "stop", F.coalesce("_first", F.col("_last") / F.col("_e") - 1).alias("ret"))


def reach(take: float, stop: float | None = None) -> Column:
    """1 where this bar reaches the take, 0 where it is stopped first, null where nothing happens."""
    e = F.col("entry")
    target = num.round_up(e * (1 + take))
    chain = F.when(F.col("minute") == 0, F.lit(None).cast("int"))
    if stop is not None:
        chain = chain.when(F.col("open") <= e * (1 - stop), F.lit(0))
    chain = chain.when(F.col("open") >= target, F.lit(1))
    if stop is not None:
        chain = chain.when(F.col("low") <= e * (1 - stop), F.lit(0))
    return chain.when(F.col("high") > target, F.lit(1))


def reached_at(hour: DataFrame, takes: Sequence[float], *, stop: float | None = None) -> DataFrame:
    """Minute at which each take is reached (null when stopped first or never)."""
    staged = hour.where("entry > 0").withColumns({f"_r{t * 1000:.0f}": reach(t, stop) for t in takes})
    aggs = [
        F.min(F.when(F.col(f"_r{t * 1000:.0f}").isNotNull(), F.struct("minute", F.col(f"_r{t * 1000:.0f}").alias("won")))).alias(f"_f{t * 1000:.0f}")
        for t in takes
    ]
    agg = staged.groupBy(*DAY).agg(*aggs)
    return agg.select(*DAY, *[
        F.when(F.col(f"_f{t * 1000:.0f}.won") == 1, F.col(f"_f{t * 1000:.0f}.minute")).alias(f"reach_{t * 1000:.0f}") for t in takes
    ])


def entries(hour: DataFrame, *, confirm: int = CONFIRM, after: int = AFTER_CONFIRM, entry_ticks: int = 0) -> DataFrame:
    """r0 (hold), buy at 09:05 with and without confirmation, and breakout, per name-day."""
    m, e = F.col("minute"), F.col("entry")
    day = W.partitionBy(*DAY)
    high5 = F.max(F.when(m == 0, F.col("open")).when(m <= CONFIRM, F.col("high"))).over(day)
    staged = hour.where("entry > 0").withColumn("_h", high5)
    fill = F.col("open") + num.tick("open").cast("double") * entry_ticks
    breaks = m.between(AFTER_CONFIRM, BREAKOUT_LAST) & (F.col("high") > F.col("_h"))
    breakout = F.greatest(F.col("_h") + num.tick("_h").cast("double"), fill)
    agg = staged.groupBy(*DAY).agg(
        F.first("entry").alias("_e"),
        _last_close().alias("_last"),
        F.max_by("close", F.when(m <= confirm, m)).alias("_confirm"),
        F.min_by(fill, F.when(m >= after, m)).alias("_fill"),
        F.min_by(breakout, F.when(breaks, m)).alias("_breakout"),
    )
    unconditional = F.col("_last") / F.col("_fill") - 1
    return agg.select(
        *DAY,
        (F.col("_last") / F.col("_e") - 1).alias("r0"),
        unconditional.alias("r_0905"),
        F.when(F.col("_confirm") > F.col("_e"), unconditional).alias("r1"),
        (F.col("_last") / F.col("_breakout") - 1).alias("r2"),
    )


def study_values(entry_rows: DataFrame, exit_rows: DataFrame, *, cost: float = COST) -> DataFrame:
    """Day values of the five registered questions."""
    r3 = exit_rows.where((F.col("take") == TAKE) & (F.col("stop") == STOP)).select(*DAY, F.col("ret").alias("r3"))
    rows = entry_rows.join(r3, list(DAY))
    by_day = rows.groupBy("day").agg(
        F.avg(F.col("r1") - cost).alias("E1"),
        (F.avg("r1") - F.avg("r_0905")).alias("D1'"),
        F.avg(F.col("r2") - cost).alias("E2"),
        F.avg(F.col("r3") - cost).alias("E3"),
        F.avg(F.col("r3") - F.col("r0")).alias("D3"),
    )
    parts = [F.struct(F.lit(q).alias("question"), F.col(q).alias("value")) for q in ("E1", "D1'", "E2", "E3", "D3")]
    return by_day.select("day", F.explode(F.array(*parts)).alias("_q")).select("day", "_q.*").where("value IS NOT NULL")


def judge_entries(values: DataFrame, entry_days: DataFrame) -> DataFrame:
    return stats.judge(values, stats.split_days(entry_days, HOLDOUT_DAYS), min_days=MIN_DAYS, min_t=MIN_T)


def rule_candidates(verdicts: DataFrame) -> DataFrame:
    """Rules all of whose questions are established."""
    need = {"R1": ("E1", "D1'"), "R2": ("E2",), "R3": ("E3", "D3")}
    ok = {q: F.max(F.when((F.col("question") == q) & (F.col("state") == stats.ESTABLISHED), 1).otherwise(0)) for q in ("E1", "D1'", "E2", "E3", "D3")}
    row = verdicts.agg(*[c.alias(q) for q, c in ok.items()])
    parts = []
    for rule, questions in need.items():
        together = F.lit(True)
        for q in questions:
            together = together & (F.col(f"`{q}`") == 1)
        parts.append(F.struct(F.lit(rule).alias("rule"), together.alias("candidate")))
    return row.select(F.explode(F.array(*parts)).alias("_r")).select("_r.*")


# ------------------------------------------------------------------ laboratory

# Bucket edges and labels.
GAP = ((-3.0, -1.0, 1.0, 3.0), ("under -3%", "-3..-1%", "-1..+1%", "+1..+3%", "+3% and up"))
PREV = ((-5.0, -2.0, 0.0, 2.0, 5.0, 15.0), ("under -5%", "-5..-2%", "-2..0%", "0..+2%", "+2..+5%", "+5..+15%", "+15% and up"))
SCORE = ((40.0, 60.0, 75.0), ("under 40", "40-60", "60-75", "75 and up"))
RANK = ((11.0, 21.0, 31.0), ("1-10", "11-20", "21-30", "31-40"))
VOLUME = ((0.7, 1.5, 3.0, 10.0), ("under 0.7x", "0.7-1.5x", "1.5-3x", "3-10x", "10x and up"))
PRICE = ((2000.0, 5000.0, 10000.0, 50000.0), ("under 2k", "2k-5k", "5k-10k", "10k-50k", "50k and up"))
MARKET_GAP = ((-1.0, 1.0), ("gap under -1%", "gap within 1%", "gap +1% and up"))
READ_DAYS, DECIDE_DAYS, LAB_MIN_T = 20, 60, 2.0


def buckets(samples: DataFrame) -> DataFrame:
    """Every single-label bucket of a sample as a column."""
    def score(c: str) -> Column:
        return F.coalesce(num.cut(c, *SCORE), F.lit("no score"))

    return samples.withColumns({
        "gap_bucket": num.cut("gap", *GAP), "prev_bucket": num.cut("prev_change", *PREV),
        "technical_bucket": score("technical"), "rank_bucket": num.cut("rank", *RANK),
        "volume_bucket": num.cut("volume_ratio", *VOLUME), "price_bucket": num.cut("price", *PRICE),
        "market_gap": F.concat_ws(" ", F.col("market"), num.cut("gap", *MARKET_GAP)),
    }).withColumn("market_gap", F.when(F.col("market").isNotNull() & F.col("gap").isNotNull(), F.col("market_gap")))


def rule_stats(rows: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Per group: name-days, days, mean of day means with t, halves, and whether the halves agree."""
    daily = stats.day_means(rows, keys, value)
    marked = stats.halves(daily, keys)
    agg = marked.groupBy(*keys).agg(
        F.sum("names").alias("n"), F.count("value").alias("days"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("_sd"),
        F.avg(F.when(F.col("half") == 1, F.col("value"))).alias("first_half"),
        F.avg(F.when(F.col("half") == 2, F.col("value"))).alias("_second"),
    )
    second = F.when(F.col("days") >= 2, F.col("_second"))
    few = (F.col("days") < READ_DAYS) | F.col("first_half").isNull() | second.isNull()
    agree = (F.col("first_half") > 0) == (second > 0)
    return agg.select(
        *keys, "n", "days", "mean", stats.t_value(F.col("mean"), F.col("_sd"), F.col("days")).alias("t"), "first_half",
        second.alias("second_half"),
        F.when(few, "too few days").when(agree, "halves agree").otherwise("halves differ").alias("flag"),
    )


def one_of(rules: Sequence[tuple[float, float | None]]) -> Column:
    """Rows of one of these (take, stop) rules."""
    test = F.lit(False)
    for t, stop in rules:
        test = test | ((F.col("take") == t) & (F.col("stop").isNull() if stop is None else F.col("stop") == stop))
    return F.coalesce(test, F.lit(False))


def rule_long(samples: DataFrame, exit_rows: DataFrame, rules: Sequence[tuple[float, float | None]], *, cost: float = COST) -> DataFrame:
    """Samples with one row per rule: return in percent after cost."""
    chosen = exit_rows.where(one_of(rules)).select(*DAY, "take", "stop", ((F.col("ret") - cost) * 100).alias("value"))
    return samples.join(chosen, list(DAY))


def grid(samples: DataFrame, exit_rows: DataFrame) -> DataFrame:
    """All takes x stops for the whole list and each market: each sample counts for both scopes."""
    rules = [(t, s) for t in TAKES for s in STOPS]
    long = rule_long(samples.select(*DAY, "market"), exit_rows, rules)
    scoped = long.select("day", "take", "stop", "value", F.explode(F.array_compact(F.array(F.lit("all"), F.col("market")))).alias("scope"))
    return rule_stats(scoped, ["scope", "take", "stop"])


def labels(samples: DataFrame, features: dict[str, Column]) -> DataFrame:
    """(feature, label) membership: array features give one row per element."""
    def tagged(name: str, values: Column) -> Column:
        return F.transform(values, lambda x: F.struct(F.lit(name).alias("feature"), x.alias("label")))

    parts = [tagged(k, v) for k, v in features.items()]
    return samples.select(*samples.columns, F.explode(F.flatten(F.array(*parts))).alias("_f")).select(
        *samples.columns, "_f.*").where("label IS NOT NULL")


def conditions(samples: DataFrame, exit_rows: DataFrame, reached: DataFrame, features: dict[str, Column]) -> DataFrame:
    """Headline rules and the +2.5 % hit rate for every feature label."""
    tagged = labels(samples, features).select(*DAY, "feature", "label")
    long = rule_long(tagged, exit_rows, HEADLINE)
    scored = rule_stats(long, ["feature", "label", "take", "stop"])
    hits = tagged.join(reached, list(DAY)).groupBy("feature", "label").agg(
        F.avg(F.when(F.col("reach_25").isNotNull(), 1.0).otherwise(0.0)).alias("hit25"))
    return scored.join(hits, ["feature", "label"], "left")


FOUR_REASONS = ("POSITIVE_NEWS_OVERLAY", "DISCLOSURE_EVENT", "DISCOVERY_SURGE", "SEARCH_SURGE")


def overlap(reasons: Column | str) -> Column:
    return F.size(F.array_intersect(F.array(*[F.lit(r) for r in FOUR_REASONS]), num.col(reasons)))


def pick_top(members: DataFrame, *, top: int = 2, need: int = 3) -> DataFrame:
    """Names with three of the four reasons, the two best technical scores per day, ties by list rank."""
    pool = members.where(F.col("excluded").isNull() & F.col("technical").isNotNull() & (overlap("reasons") >= need))
    w = W.partitionBy("day").orderBy(F.col("technical").desc(), "rank")
    return pool.withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= top)


def peak(bars: DataFrame) -> DataFrame:
    """Best prices of the first hour and the day against the 09:00 open, when, and how deep it dipped first."""
    day = W.partitionBy(*DAY)
    m = F.col("minute")
    staged = bars.withColumn("_e", F.max(F.when(m == 0, F.col("open"))).over(day)).where("_e > 0")
    staged = staged.withColumn("_at", F.min_by("minute", F.struct(-F.col("high"), "minute")).over(day))
    agg = staged.groupBy(*DAY).agg(
        F.first("_e").alias("_e"), F.first("_at").alias("max_day_at"), F.max("high").alias("_hi"),
        F.max(F.when(m < 60, F.col("high"))).alias("_hi10"),
        F.min_by("minute", F.when(m < 60, F.struct(-F.col("high"), m))).alias("max_ten_at"),
        F.min(F.when(m < 60, F.col("low"))).alias("_lo10"), F.min(F.when(m <= F.col("_at"), F.col("low"))).alias("_dip"),
        _last_close().alias("_last"), F.max("minute").alias("last_at"),
    )
    pct = lambda c: num.percent_change("_e", c)
    return agg.select(*DAY, pct("_hi10").alias("max_ten"), "max_ten_at", pct("_hi").alias("max_day"), "max_day_at",
                      pct("_lo10").alias("low_ten"), pct("_dip").alias("dip_before_peak"), pct("_last").alias("last"), "last_at",
                      (F.col("last_at") >= 60).alias("after_ten"))


def peak_bucket(minute: Column | str) -> Column:
    return num.cut(minute, (5.0, 15.0, 30.0, 60.0), ("09:00-09:04", "09:05-09:14", "09:15-09:29", "09:30-09:59", "after 10:00"))


def reached_day(bars: DataFrame, take: float) -> DataFrame:
    """First minute of the whole day at the take (gap or trade-through)."""
    staged = bars.withColumn("entry", F.max(F.when(F.col("minute") == 0, F.col("open"))).over(W.partitionBy(*DAY))).where("entry > 0")
    return staged.withColumn("_r", reach(take)).groupBy(*DAY).agg(F.min(F.when(F.col("_r") == 1, F.col("minute"))).alias("reached_at"))


# ------------------------------------------------------------------ usual reactions

def reaction_stats(paths: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How names with this kind of filing usually moved in their first hour."""
    from knownat.functions.scale import exact_quantile

    hit = F.col("hit_25").isNotNull()
    base = paths.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.when(hit & (F.col("hit_25") < 10), 1.0).otherwise(0.0)).alias("hit_10"),
        F.avg(F.when(hit, 1.0).otherwise(0.0)).alias("hit_60"),
        F.avg(F.when(hit, F.col("low_before_25"))).alias("low_before"),
        F.avg(F.when(~hit, F.col("at_10"))).alias("miss_at_10"),
        F.avg(F.when(F.col("hit_5").isNotNull(), 1.0).otherwise(0.0)).alias("hit5_60"),
    )
    minutes = exact_quantile(paths.select(*keys, F.col("hit_25").cast("double").alias("v")), keys, "v", name="hit_minute").drop("n")
    gaps = exact_quantile(paths.select(*keys, F.col("gap").alias("v")), keys, "v", name="gap_median").drop("n")
    return base.join(minutes, list(keys), "left").join(gaps, list(keys), "left")


def usual_reaction(asked: DataFrame, detail: DataFrame, group: DataFrame, *, min_n: int = 10) -> DataFrame:
    """Statistics of the same filing if recorded often enough, else of its group, else none."""
    d = detail.where(F.col("n") >= min_n).select("detail", F.struct("n", "hit_10", "hit_60", "hit_minute").alias("_d"))
    g = group.where(F.col("n") >= min_n).select("kind", F.struct("n", "hit_10", "hit_60", "hit_minute").alias("_g"))
    out = asked.join(d, "detail", "left").join(g, "kind", "left")
    scope = F.when(F.col("_d").isNotNull(), "same filing").when(F.col("_g").isNotNull(), "similar filings")
    return out.withColumn("scope", scope).withColumn("_s", F.coalesce("_d", "_g")).select(*asked.columns, "scope", "_s.*")


# ------------------------------------------------------------------ list review

def review_groups(rows: DataFrame) -> DataFrame:
    """Membership of every name-day in the review's groups, long: heavyweights are reported apart."""
    rest = ~F.col("heavyweight")
    gap = num.cut("gap", (-2.0, 0.0, 2.0), ("gap under -2%", "gap -2..0%", "gap 0..+2%", "gap +2% and up"))
    one = F.array_compact(F.array(
        F.when(rest, "list"),
        F.when(~rest, "heavyweights"),
        F.when(rest & F.col("excluded").isNull(), "kept"),
        F.when(rest & F.col("excluded").isNotNull(), F.concat(F.lit("out: "), "excluded")),
        F.when(rest, F.concat(F.lit("action "), F.coalesce("action", F.lit("NONE")))),
        F.when(rest & (F.col("reports") > 0), "broker reports").when(rest & (F.col("reports") == 0), "no broker reports"),
        F.when(rest & F.col("prev_limit").isNotNull(), F.concat(F.lit("limit "), "prev_limit")),
        F.when(rest & F.col("gap").isNotNull(), gap),
        F.when(rest & (F.col("market") > 0), "market up").when(rest & (F.col("market") <= 0), "market down or flat"),
    ))
    reasons = F.transform(F.when(rest, F.col("reasons")).otherwise(F.array().cast("array<string>")), lambda r: F.concat(F.lit("reason "), r))
    kinds = F.transform(F.when(rest, F.col("kinds")).otherwise(F.array().cast("array<string>")), lambda r: F.concat(F.lit("filing "), r))
    tops = F.transform(F.col("tops"), lambda r: F.concat(F.lit("top3 "), r))
    return rows.withColumn("grp", F.explode(F.concat(one, reasons, kinds, tops)))


def review_stats(members: DataFrame, keys: Sequence[str] = ("grp",)) -> DataFrame:
    """Counts, mean moves, medians and +2.5 % reach of each review group."""
    from knownat.functions.scale import exact_quantile

    hit = F.col("hit_25")
    has_path = F.col("at_10").isNotNull()
    base = members.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("first_hour").alias("first_hour"), F.avg("open_close").alias("open_close"),
        F.avg(F.col("open_close") - F.col("market")).alias("vs_market"), F.count(F.when(F.col("open_close") > 0, 1)).alias("up_close"),
        F.avg("peak_930").alias("peak_930"), F.count(F.when(F.col("peak_930") >= 2, 1)).alias("peak_930_2pct"),
        F.avg(F.when(has_path, F.when(hit < 10, 1.0).otherwise(0.0))).alias("hit25_10"),
        F.avg(F.when(has_path, F.when(hit.isNotNull(), 1.0).otherwise(0.0))).alias("hit25_60"),
        F.avg(F.when(has_path & hit.isNull(), F.col("at_10"))).alias("miss_at10"),
    )
    median = exact_quantile(members.select(*keys, "mfe"), list(keys), "mfe", name="mfe_median").drop("n")
    return base.join(median, list(keys), "left")
