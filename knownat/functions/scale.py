"""Aggregations that stay whole and balanced when one key holds most of the rows.

``newest``/``oldest`` pick one row per key by a partial aggregate, so a hot key is
reduced on the map side before it is shuffled.  ``spread``, ``numbered``,
``exact_quantile`` and ``rank_counts`` split every group at sketched value cuts: each
(group, slice) is ordered on its own and the slice totals (at most ``parts`` rows per
group) supply the offset.  The sketch only decides where to cut; the answers are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

SLICES = 32


def _by(order: Sequence[str | Column]) -> Column:
    return F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])


def newest(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], *, first: bool = False) -> DataFrame:
    """The row with the greatest (or, with ``first``, smallest) ``order`` per key."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.min_by if first else F.max_by
    return (
        df.groupBy(*keys).agg(pick(F.struct(*rest), _by(order)).alias("_row")).select(*keys, "_row.*")
    )


def oldest(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    return newest(df, keys, order, first=True)


def spread(df: DataFrame, keys: Sequence[str], value: str, parts: int = SLICES) -> DataFrame:
    """Add ``_slice``: rows of a group with smaller ``value`` get a smaller slice."""
    keys = list(keys)
    if not keys:
        raise ValueError("name at least one key column")
    probs = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    cuts = df.groupBy(*keys).agg(F.percentile_approx(F.col(value).cast("double"), probs, F.lit(1000)).alias("_cuts"))
    same = [df[k].eqNullSafe(cuts[k]) for k in keys]
    joined = df.join(cuts, same, "left")
    for k in keys:
        joined = joined.drop(cuts[k])
    slot = F.expr(f"size(filter(_cuts, x -> x < cast(`{value}` as double)))")
    return joined.withColumn("_slice", F.coalesce(slot, F.lit(0))).drop("_cuts")


def _offsets(sliced: DataFrame, keys: Sequence[str], total: Column) -> DataFrame:
    """Rows before each slice and in the whole group; at most ``parts`` rows per group."""
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys)
    return (
        sliced.groupBy(*keys, "_slice").agg(total.alias("_in_slice"))
        .withColumn("_before", F.coalesce(F.sum("_in_slice").over(before), F.lit(0)))
        .withColumn("_n", F.sum("_in_slice").over(whole))
        .drop("_in_slice")
    )


def _attach(sliced: DataFrame, offsets: DataFrame, keys: Sequence[str]) -> DataFrame:
    on = [sliced[k].eqNullSafe(offsets[k]) for k in [*keys, "_slice"]]
    joined = sliced.join(offsets, on)
    for k in [*keys, "_slice"]:
        joined = joined.drop(offsets[k])
    return joined


def numbered(
    df: DataFrame, keys: Sequence[str], lead: str, ties: Sequence[str | Column] = (), *, name: str = "rn",
    parts: int = SLICES,
) -> DataFrame:
    """Row number per group ordered by ``lead`` ascending, then ``ties``; also ``<name>_of``, the group size."""
    sliced = spread(df, keys, lead, parts)
    with_offset = _attach(sliced, _offsets(sliced, keys, F.count(F.lit(1))), keys)
    local = W.partitionBy(*keys, "_slice").orderBy(F.col(lead), *ties)
    return (
        with_offset.withColumn(name, (F.row_number().over(local) + F.col("_before")).cast("long"))
        .withColumnRenamed("_n", f"{name}_of")
        .drop("_before", "_slice")
    )


def rank_counts(df: DataFrame, keys: Sequence[str], value: str, parts: int = SLICES) -> DataFrame:
    """Per distinct value of a group: rows ``below`` it, ``equal`` to it, and ``of`` the group."""
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("equal"))
    sliced = spread(counted, keys, value, parts)
    with_offset = _attach(sliced, _offsets(sliced, keys, F.sum("equal")), keys)
    local = W.partitionBy(*keys, "_slice").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    return with_offset.select(
        *keys,
        value,
        (F.coalesce(F.sum("equal").over(local), F.lit(0)) + F.col("_before")).alias("below"),
        "equal",
        F.col("_n").alias("of"),
    )


def exact_quantile(df: DataFrame, keys: Sequence[str], value: str, p: float = 0.5, *, name: str = "median") -> DataFrame:
    """Linear-interpolated quantile per group (nulls ignored), with the group's ``n``."""
    ranked = rank_counts(df.where(F.col(value).isNotNull()), keys, value)
    position = (F.col("of") - 1) * F.lit(p)
    low, high = F.floor(position), F.ceil(position)

    def covers(at: Column) -> Column:
        return (F.col("below") <= at) & (at < F.col("below") + F.col("equal"))

    grouped = ranked.groupBy(*keys).agg(
        F.max(F.when(covers(low), F.col(value))).alias("_lo"),
        F.max(F.when(covers(high), F.col(value))).alias("_hi"),
        F.max(position - low).alias("_frac"),
        F.max("of").alias("n"),
    )
    return grouped.select(*keys, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_frac")).alias(name), "n")


def trimmed_mean(df: DataFrame, keys: Sequence[str], value: str, share: float = 0.1, *, name: str = "trimmed") -> DataFrame:
    """Mean after dropping ``int(n * share)`` rows at each end of a group."""
    ranked = rank_counts(df.where(F.col(value).isNotNull()), keys, value)
    cut = F.floor(F.col("of") * F.lit(share))
    kept = F.least(F.col("below") + F.col("equal"), F.col("of") - cut) - F.greatest(F.col("below"), cut)
    kept = F.greatest(kept, F.lit(0))
    return ranked.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col(value) * kept), F.sum(kept)).alias(name), F.max("of").alias("n")
    )


def ordered_digest(rows: DataFrame, keys: Sequence[str], place: str, text: Column | str, name: str, *, separator: str = ",") -> DataFrame:
    """Fingerprint of a group's texts in the order of an integer ``place``, and their number ``n``, without gathering the group.

    Texts are hashed in slices of 65,536 places, the slices' digests in slices of as many slices, and those digests in order.  The slices
    depend on the places alone, so the value is the same for every partitioning, and no array holds more than a slice of distinct places.
    """
    level = rows.select(*keys, F.col(place).cast("long").alias("_p"), (F.col(text) if isinstance(text, str) else text).cast("string").alias("_d"), F.lit(1).cast("long").alias("_n"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("_p", "_d"))), lambda x: x["_d"])
    digest = F.sha2(F.array_join(ordered, separator), 256)
    for _ in range(2):
        level = level.groupBy(*keys, F.shiftright("_p", 16).alias("_q")).agg(digest.alias("_d"), F.sum("_n").alias("_n")).withColumnRenamed("_q", "_p")
    return level.groupBy(*keys).agg(digest.alias(name), F.sum("_n").alias("n"))
