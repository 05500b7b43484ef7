"""Point-in-time reads over append-only revisions.

Two clocks bound every read: ``available_at`` (the market could know it) and ``ingested_at``
(we held it).  The held-by bound chooses among revisions; the known-by bound is applied to the
chosen revision, so a newer revision that was not yet public hides the bar instead of
falling back to an older one.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from knownat.functions.scale import newest


class PitViolation(Exception):
    """A read outside the window a view is confined to."""


def _at(moment: datetime | str | Column) -> Column:
    return moment if isinstance(moment, Column) else F.lit(moment).cast("timestamp")


def finite(*columns: str) -> Column:
    """All columns present and neither NaN nor infinite."""
    test = F.lit(True)
    for c in columns:
        v = F.col(c).cast("double")
        test = test & v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    return test


def current_bars(
    bars: DataFrame,
    *,
    keys: Sequence[str] = ("instrument_id", "bar_key"),
    ties: Sequence[str] = (),
    prices: Sequence[str] = ("close",),
    held_by: datetime | str | Column | None = None,
    known_by: datetime | str | Column | None = None,
    since: Column | None = None,
) -> DataFrame:
    """Newest finite revision per bar held by one instant, then only those known by another."""
    rows = bars.where(finite(*prices))
    if held_by is not None:
        rows = rows.where(F.col("ingested_at") <= _at(held_by))
    if since is not None:
        rows = rows.where(since)
    chosen = newest(rows, list(keys), ["ingested_at", *ties])
    return chosen if known_by is None else chosen.where(F.col("available_at") <= _at(known_by))


def last_bars(bars: DataFrame, limit: int, *, key: str = "instrument_id", order: str = "bar_key") -> DataFrame:
    """Newest ``limit`` bars per instrument; the rank limit is applied before the shuffle."""
    w = W.partitionBy(key).orderBy(F.col(order).desc())
    return bars.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= limit).drop("_rn")


def opening_prices(bars: DataFrame, wanted: DataFrame, *, ties: Sequence[str] = (), held_by=None) -> DataFrame:
    """Newest ``open`` at exactly each wanted bar; not gated by the bar's completion."""
    rows = bars.where(finite("open"))
    if held_by is not None:
        rows = rows.where(F.col("ingested_at") <= _at(held_by))
    rows = rows.join(wanted.select("instrument_id", "bar_key").distinct(), ["instrument_id", "bar_key"], "left_semi")
    return rows.groupBy("instrument_id", "bar_key").agg(
        F.max_by("open", F.struct("ingested_at", *ties)).alias("open")
    )


@dataclass(frozen=True)
class PitView:
    """Reads confined to [not_before, not_after]; narrowing can only tighten the bounds."""

    bars: DataFrame
    asof: datetime
    held_by: datetime
    not_before: datetime | None = None
    not_after: datetime | None = None
    ties: tuple[str, ...] = ()

    def windowed(self, *, not_before: datetime | None = None, not_after: datetime | None = None) -> PitView:
        lows = [b for b in (self.not_before, not_before) if b is not None]
        highs = [b for b in (self.not_after, not_after) if b is not None]
        return replace(self, not_before=max(lows, default=None), not_after=min(highs, default=None))

    def at(self, asof: datetime) -> PitView:
        if self.not_after is not None and asof > self.not_after:
            raise PitViolation(f"{asof} is after the window's end {self.not_after}")
        if self.not_before is not None and asof < self.not_before:
            raise PitViolation(f"{asof} is before the window's start {self.not_before}")
        return replace(self, asof=asof)

    def read(self, limit: int) -> DataFrame:
        asof = self.at(self.asof).asof
        known = current_bars(self.bars, ties=self.ties, held_by=self.held_by, known_by=asof)
        if self.not_before is not None:
            known = known.where(F.col("available_at") >= _at(self.not_before))
        return last_bars(known, limit)


def bar_inventory(bars: DataFrame, *, prices: Sequence[str] = ("close",)) -> DataFrame:
    """Distinct bars, revisions, first/last bar and coverage span per instrument.

    Revisions are folded to one row per bar before bars are counted.
    """
    per_bar = bars.where(finite(*prices)).groupBy("instrument_id", "bar_key").agg(
        F.count(F.lit(1)).alias("revisions"), F.min("available_at").alias("lo"), F.max("available_at").alias("hi")
    )
    return per_bar.groupBy("instrument_id").agg(
        F.count(F.lit(1)).alias("bars"),
        F.sum("revisions").alias("revisions"),
        F.max("bar_key").alias("latest_bar"),
        F.min("lo").alias("covered_from"),
        F.max("hi").alias("covered_to"),
    )


# ------------------------------------------------------------------ reported facts

ANNUAL_ADJACENCY_DAYS = 430
CONTEXT = ("instrument_id", "concept", "unit", "period_start", "period_end")


def duration_ok(months: int | None) -> Column:
    """Facts spanning about ``months`` months, or balances (no start) when ``months`` is None."""
    if months is None:
        return F.col("period_start").isNull()
    span = F.datediff("period_end", "period_start")
    return F.col("period_start").isNotNull() & span.between(28 * months, 31 * months + 10)


def visible(facts: DataFrame, *, asof=None, held_by=None) -> DataFrame:
    if asof is not None:
        facts = facts.where(F.col("available_at") <= _at(asof))
    if held_by is not None:
        facts = facts.where(F.col("ingested_at") <= _at(held_by))
    return facts


def value_as_of(facts: DataFrame, *, asof=None, held_by=None, first_filed: bool = False, keys=CONTEXT) -> DataFrame:
    """One revision per reporting context (null starts match null starts): newest or first filed, ties by id."""
    seen = visible(facts, asof=asof, held_by=held_by)
    filed = F.datediff(F.col("filed_at"), F.lit("1970-01-01").cast("date"))
    return newest(seen, list(keys), [-filed if first_filed else filed, "id"])


def latest_value_as_of(facts: DataFrame, *, asof=None, held_by=None, months_of: Column | None = None) -> DataFrame:
    """Newest period per concept (twelve-month durations, or balances), at its newest revision."""
    annual = F.when(F.col("period_start").isNotNull(), duration_ok(12)).otherwise(True)
    current = value_as_of(facts.where(annual if months_of is None else months_of), asof=asof, held_by=held_by)
    return newest(current, ["instrument_id", "concept", "unit"], ["period_end", "period_start"])


def previous_annual(facts: DataFrame, *, asof=None, held_by=None, max_gap: int = ANNUAL_ADJACENCY_DAYS) -> DataFrame:
    """Latest annual value beside the one of the annual period before it; none when over ``max_gap`` days apart."""
    annual = value_as_of(facts.where(duration_ok(12)), asof=asof, held_by=held_by)
    w = W.partitionBy("instrument_id", "concept", "unit").orderBy(F.col("period_end").desc())
    ranked = annual.select(
        "instrument_id", "concept", "unit", "period_end", "value",
        F.row_number().over(w).alias("_rn"),
        F.lead("period_end").over(w).alias("_prior_end"),
        F.lead("value").over(w).alias("_prior_value"),
    ).where("_rn = 1")
    near = F.datediff("period_end", "_prior_end") <= max_gap
    return ranked.select(
        "instrument_id", "concept", "unit", "period_end", "value",
        F.when(near, F.col("_prior_end")).alias("prior_end"),
        F.when(near, F.col("_prior_value")).alias("prior_value"),
    )


def annual_gaps(facts: DataFrame, *, keys=("instrument_id",), max_gap: int = ANNUAL_ADJACENCY_DAYS) -> DataFrame:
    """Annual period ends with the next one, flagged when too far apart."""
    ends = facts.where(duration_ok(12)).select(*keys, "period_end").distinct()
    w = W.partitionBy(*keys).orderBy("period_end")
    following = F.lead("period_end").over(w)
    return ends.select(*keys, "period_end", following.alias("next_end")).withColumn(
        "is_gap", F.coalesce(F.datediff("next_end", "period_end") > max_gap, F.lit(False))
    )


def coverage_start(facts: DataFrame, *, held_by=None) -> DataFrame:
    return visible(facts, held_by=held_by).groupBy("instrument_id").agg(F.min("filed_at").alias("coverage_start"))


def oldest_reading_version(facts: DataFrame, *, held_by=None) -> DataFrame:
    """Newest reading version of every filed fact, then the oldest of those per instrument."""
    per_fact = visible(facts, held_by=held_by).groupBy(*CONTEXT, "filed_at").agg(
        F.max("semantic_version").alias("v")
    )
    return per_fact.groupBy("instrument_id").agg(F.min("v").alias("oldest_version"))


# Periodic report families per source.
FORM_FAMILIES = {
    "SEC": ("10-K", "10-Q", "20-F", "40-F"),
    "DART": ("사업보고서", "반기보고서", "분기보고서"),
}


def form_family(form: Column | str) -> Column:
    """Form name without a leading ``[tag]``, a trailing ``(period)`` or a ``/A`` suffix."""
    form = F.col(form) if isinstance(form, str) else form
    bare = F.regexp_replace(F.regexp_replace(form, r"^\s*\[[^\]]*\]\s*", ""), r"\s*\([^)]*\)\s*$", "")
    return F.trim(F.substring_index(bare, "/", 1))


def covering_reports(filings: DataFrame, *, asof=None, held_by=None) -> DataFrame:
    """Earliest periodic report known by ``asof`` per (instrument, reported period)."""
    rows = visible(filings, asof=asof, held_by=held_by)
    periodic = F.lit(False)
    for source, families in FORM_FAMILIES.items():
        periodic = periodic | ((F.col("source") == source) & form_family("form").isin(*families))
    return rows.where(periodic).groupBy("instrument_id", F.col("period_of_report").alias("period_end")).agg(
        F.min_by(F.struct(F.col("form").alias("covering_form"), F.col("filed_at").alias("covering_filed_at")),
                 F.struct("filed_at", "id")).alias("_c")
    ).select("instrument_id", "period_end", "_c.*")


def register_start(filings: DataFrame, *, held_by=None) -> DataFrame:
    return visible(filings, held_by=held_by).groupBy("instrument_id").agg(F.min("filed_at").alias("register_start"))


def lookup(requests: DataFrame, facts: DataFrame, filings: DataFrame, *, asof, held_by=None) -> DataFrame:
    """Value or reasoned absence for each requested context (``requests`` carries the context columns)."""
    found = value_as_of(facts, asof=asof, held_by=held_by).select(*CONTEXT, "value", "filed_at")
    on = [requests[k].eqNullSafe(found[k]) for k in CONTEXT]
    joined = requests.join(found, on, "left").select(*[requests[c] for c in requests.columns], "value", "filed_at")
    joined = (
        joined.join(coverage_start(facts, held_by=held_by), "instrument_id", "left")
        .join(register_start(filings, held_by=held_by), "instrument_id", "left")
        .join(covering_reports(filings, asof=asof, held_by=held_by), ["instrument_id", "period_end"], "left")
    )
    day = F.to_date(_at(asof))
    outcome = (
        F.when(F.col("value").isNotNull(), "FOUND")
        .when(F.col("coverage_start").isNull() | (day < F.col("coverage_start")), "SOURCE_COVERAGE_UNAVAILABLE")
        .when(F.col("register_start").isNull() | (day < F.col("register_start")), "NO_OBSERVATION_IN_SOURCE")
        .when(F.col("covering_form").isNotNull(), "NO_OBSERVATION_IN_SOURCE")
        .otherwise("NOT_YET_FILED")
    )
    return joined.withColumn("outcome", outcome)


# The concepts a snapshot reads, in the order absences are reported, and its anchors by priority.
SNAPSHOT_CONCEPTS = (
    "Revenues",
    "RevenueFromContractWithCustomerExcludingAssessedTax",
    "NetIncomeLoss",
    "OperatingIncomeLoss",
    "EarningsPerShareBasic",
    "EarningsPerShareDiluted",
    "Assets",
    "Liabilities",
    "StockholdersEquity",
    "CashAndCashEquivalentsAtCarryingValue",
)
ANCHORS = (
    "NetIncomeLoss",
    "RevenueFromContractWithCustomerExcludingAssessedTax",
    "Revenues",
    "EarningsPerShareBasic",
)


def snapshot(facts: DataFrame, *, asof=None, held_by=None, keys: Sequence[str] = ("instrument_id",)) -> DataFrame:
    """One row per instrument: every concept read at one anchor period, and the prior year's revenues.

    The anchor is the newest annual period of the first anchor concept that has one.  ``keys`` may
    carry more columns (an instant), giving snapshots for many instants in one plan.
    """
    keys = list(keys)
    ok = F.when(F.col("period_start").isNotNull(), duration_ok(12)).otherwise(True)
    current = value_as_of(facts.where(ok), asof=asof, held_by=held_by,
                          keys=[*keys, "concept", "unit", "period_start", "period_end"])
    priority = F.array_position(F.array(*[F.lit(a) for a in ANCHORS]), F.col("concept")).cast("int")
    anchors = current.where(F.col("concept").isin(*ANCHORS) & F.col("period_start").isNotNull())
    anchor = anchors.groupBy(*keys).agg(
        F.max_by(F.col("period_end"), F.struct(-priority, "period_end")).alias("anchor_end")
    )
    joined = current.join(anchor, keys)
    at_anchor = F.col("period_end") == F.col("anchor_end")
    gap = F.datediff("anchor_end", "period_end")
    before = F.col("period_start").isNotNull() & (gap > 0) & (gap <= ANNUAL_ADJACENCY_DAYS)
    cols = [
        F.max(F.when(at_anchor & (F.col("concept") == c), F.col("value"))).alias(c) for c in SNAPSHOT_CONCEPTS
    ]
    prior = [
        F.max_by(F.when(before & (F.col("concept") == c), F.col("value")),
                 F.when(before & (F.col("concept") == c), F.col("period_end"))).alias(f"prior_{c}")
        for c in SNAPSHOT_CONCEPTS[:2]
    ]
    return joined.groupBy(*keys, "anchor_end").agg(*cols, *prior)


# ------------------------------------------------------------------ instruments

def symbol_windows(first_seen: DataFrame) -> DataFrame:
    """Close each holder's symbol window the day before the next holder starts."""
    w = W.partitionBy("symbol").orderBy("valid_from", "holder")
    return first_seen.withColumn("valid_to", F.date_sub(F.lead("valid_from").over(w), 1))


def resolve_symbols(asked: DataFrame, windows: DataFrame) -> DataFrame:
    """Holder of (``symbol``, ``day``): closed interval, open end."""
    inside = (F.col("valid_from") <= F.col("day")) & (F.col("valid_to").isNull() | (F.col("valid_to") >= F.col("day")))
    return asked.join(windows, "symbol").where(inside)


def append_symbol(windows: DataFrame, claims: DataFrame) -> DataFrame:
    """Apply one observed symbol claim (``symbol, holder, earliest, observed_on``) per symbol.

    A newcomer starts on its ``earliest`` day when the symbol is free; otherwise not before the day it was
    observed nor inside a recorded window, and the open window of the old holder closes the day before.
    """
    joined = windows.join(
        claims.select("symbol", F.col("holder").alias("new_holder"), "earliest", "observed_on"), "symbol"
    )
    foreign = joined.where(F.col("holder") != F.col("new_holder"))
    bound = F.greatest(
        F.date_add("valid_from", 1), F.coalesce(F.date_add("valid_to", 1), F.date_add("valid_from", 1))
    )
    starts = foreign.groupBy("symbol", "new_holder").agg(
        F.greatest(F.max("earliest"), F.max("observed_on"), F.max(bound)).alias("start")
    )
    placed = claims.join(starts, (claims["symbol"] == starts["symbol"]) & (claims["holder"] == starts["new_holder"]), "left")
    fresh = placed.select(
        claims["symbol"], claims["holder"], F.coalesce("start", "earliest").alias("valid_from"),
        F.lit(None).cast("date").alias("valid_to"),
    )
    closing = windows.join(starts.select("symbol", "new_holder", "start"), "symbol", "left")
    ends = F.when(
        F.col("valid_to").isNull() & F.col("start").isNotNull() & (F.col("holder") != F.col("new_holder")),
        F.date_sub("start", 1),
    ).otherwise(F.col("valid_to"))
    kept = closing.select("symbol", "holder", "valid_from", ends.alias("valid_to"))
    known = windows.where(F.col("valid_to").isNull()).select("symbol", "holder")
    return kept.unionByName(fresh.join(known, ["symbol", "holder"], "left_anti"))


def active_on(instruments: DataFrame, day) -> DataFrame:
    """Listed by ``day`` (or undated) and not yet delisted on it."""
    day = F.lit(day).cast("date") if isinstance(day, str) else day
    return instruments.where(
        (F.col("listed_at").isNull() | (F.col("listed_at") <= day))
        & (F.col("delisted_at").isNull() | (F.col("delisted_at") > day))
    )


def match_entities(incoming: DataFrame, master: DataFrame) -> DataFrame:
    """Existing instrument for each incoming row, by priority.

    1. same external anchor; 2. same name, if the stored row has no anchor; 3. without an anchor, same
    (market, name).  ``matched_by`` is null for rows that will be created.
    """
    by_anchor = incoming.where(F.col("anchor").isNotNull()).join(
        master.where(F.col("m_anchor").isNotNull()), F.col("anchor") == F.col("m_anchor")
    ).select("row_id", "instrument_id", F.lit(1).alias("priority"))
    same_name = incoming.join(master, (F.col("market") == F.col("m_market")) & (F.col("name") == F.col("m_name")))
    by_name = same_name.where(F.col("anchor").isNotNull() & F.col("m_anchor").isNull()).select(
        "row_id", "instrument_id", F.lit(2).alias("priority")
    )
    bare = same_name.where(F.col("anchor").isNull()).select("row_id", "instrument_id", F.lit(3).alias("priority"))
    best = by_anchor.unionByName(by_name).unionByName(bare).groupBy("row_id").agg(
        F.min_by(F.struct("instrument_id", "priority"), F.struct("priority", "instrument_id")).alias("_b")
    ).select("row_id", "_b.*")
    rule = F.element_at(F.array(F.lit("ANCHOR"), F.lit("NAME_ADOPTED"), F.lit("NAME")), F.col("priority"))
    return incoming.select("row_id").join(best, "row_id", "left").select(
        "row_id", "instrument_id", F.when(F.col("priority").isNotNull(), rule).alias("matched_by")
    )


def promoted_by(tracked: DataFrame, promotions: DataFrame, asof) -> DataFrame:
    """The tracked set as it stood: without names promoted after ``asof``."""
    later = promotions.where(F.col("promoted_at") > _at(asof))
    return tracked.join(later, "instrument_id", "left_anti")


# ------------------------------------------------------------------ verdicts, coverage, small latest reads

def latest_verdicts(verdicts: DataFrame, *, asof=None) -> DataFrame:
    """Newest verdict per query hit, ties by id."""
    rows = verdicts if asof is None else verdicts.where(F.col("decided_at") <= _at(asof))
    return newest(rows, ["hit_id"], ["decided_at", "id"])


def append_verdicts(stored: DataFrame, incoming: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Incoming verdicts that change something; a rule never overrules a model."""
    now = latest_verdicts(stored).select("hit_id", *[F.col(f).alias(f"_{f}") for f in fields], F.lit(True).alias("_had"))
    joined = incoming.join(now, "hit_id", "left")
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"_{f}"))
    overruled = (F.col("_decided_by") == "MODEL") & (F.col("decided_by") == "RULE")
    keep = F.col("_had").isNull() | ~(same | F.coalesce(overruled, F.lit(False)))
    return joined.where(keep).select(*incoming.columns)


def sync_mentions(verdicts: DataFrame, mentions: DataFrame) -> DataFrame:
    """Changes that make ``mentions`` the projection of confirmed verdicts: ADD and REMOVE rows."""
    pair = ["news_item_id", "instrument_id"]
    confirmed = latest_verdicts(verdicts).where("decision = 'CONFIRMED'").select(*pair)
    add = confirmed.join(mentions, pair, "left_anti").withColumn("change", F.lit("ADD"))
    gone = mentions.select(*pair).join(confirmed, pair, "left_anti").withColumn("change", F.lit("REMOVE"))
    return add.unionByName(gone)


def clipped_coverage(coverage: DataFrame, *, asof, start, end) -> DataFrame:
    """Read intervals recorded by ``asof`` that overlap (start, end), cut to it."""
    lo, hi = _at(start), _at(end)
    rows = coverage.where(
        (F.col("recorded_at") <= _at(asof)) & (F.col("covered_to") > lo) & (F.col("covered_from") < hi)
    )
    return rows.select("instrument_id", F.greatest("covered_from", lo).alias("lo"), F.least("covered_to", hi).alias("hi"))


def top_open(rows: DataFrame, limit: int) -> DataFrame:
    """A work queue: newest first, ties by hit, cut to the caller's limit."""
    return rows.orderBy(F.col("available_at").desc(), "hit_id").limit(limit)
