"""Technical indicators per (instrument, day).

Input is one row per instrument and session, so a window over an instrument holds at most as many
rows as there are trading days.  Anything seeded by where its series starts (EMA, RSI, MACD) looks at the last ``HISTORY`` bars of each
day, never at the whole past.  All of these are linear in the values (RSI in its gains and losses), so a full window is one sliding dot
product with fixed weights, for all days of an instrument at once; the first days, whose windows all begin with the series, are its plain
recurrence.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from knownat.functions.numeric import col

HISTORY = 250


def frame(rows: int, key: str = "instrument_id", order: str = "day"):
    return W.partitionBy(key).orderBy(order).rowsBetween(-(rows - 1), 0)


def enough(value: Column, period: int, over) -> Column:
    """``value`` only where the frame is full: a short window is null, never a partial figure."""
    return F.when(F.count(F.lit(1)).over(over) == period, value)


def sma(value: Column | str, period: int) -> Column:
    w = frame(period)
    return enough(F.avg(col(value)).over(w), period, w)


def zscore(value: Column | str, period: int) -> Column:
    """Population z-score of the newest value; 0 when nothing varied."""
    w = frame(period)
    spread = F.stddev_pop(col(value)).over(w)
    z = F.when(spread == 0, F.lit(0.0)).otherwise((col(value) - F.avg(col(value)).over(w)) / spread)
    return enough(z, period, w)


def bollinger(value: Column | str, period: int = 20, deviations: float = 2.0) -> tuple[Column, Column, Column]:
    """Upper, middle and lower band (population deviation)."""
    w = frame(period)
    middle = F.avg(col(value)).over(w)
    reach = F.stddev_pop(col(value)).over(w) * deviations
    return tuple(enough(band, period, w) for band in (middle + reach, middle, middle - reach))  # type: ignore[return-value]


def band_position(price: Column | str, upper: Column, lower: Column) -> Column:
    """Where a price sits between the bands; one half when they coincide."""
    span = upper - lower
    return F.when(span == 0, F.lit(0.5)).otherwise((col(price) - lower) / span)


def _smooth(values: np.ndarray, period: int, rate: float) -> np.ndarray:
    """The recurrence from the start: mean of the first ``period`` values, then steps of ``rate`` towards each; nan before."""
    out = np.full(len(values), np.nan)
    if len(values) >= period:
        state = out[period - 1] = values[:period].mean()
        for k in range(period, len(values)):
            state += (values[k] - state) * rate
            out[k] = state
    return out


def _weights(length: int, period: int, rate: float) -> np.ndarray:
    """Weights of a window of ``length`` values in the last value of the recurrence over it."""
    age = np.arange(length)[::-1]
    seed = np.full(length, (1 - rate) ** max(0, length - period) / period)
    return np.where(np.arange(length) < period, seed, rate * (1 - rate) ** age)


def _windows(values: np.ndarray, length: int, start: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Growing windows by their recurrence ``start``, then windows of ``length`` values by their weights."""
    out = np.full(len(values), np.nan)
    out[: length - 1] = start[: length - 1]
    if len(values) >= length:
        out[length - 1 :] = np.correlate(values, weights, "valid")
    return out


def ema(values: np.ndarray, period: int, rows: int = HISTORY) -> np.ndarray:
    """Exponential mean over the last ``rows`` values of each place, seeded with the plain mean of the first ``period`` of them."""
    rate = 2.0 / (period + 1)
    return _windows(values, rows, _smooth(values[: rows - 1], period, rate), _weights(rows, period, rate))


def rsi(values: np.ndarray, period: int = 14, rows: int = HISTORY) -> np.ndarray:
    """Wilder's index: smoothed gains against smoothed losses; 100 without a loss, 50 without any move."""
    out = np.full(len(values), np.nan)
    moves, rate = np.diff(values), 1.0 / period
    if len(moves) < period:
        return out
    up, down = (_windows(part, rows - 1, _smooth(part[: rows - 2], period, rate), _weights(rows - 1, period, rate)) for part in (np.maximum(moves, 0), np.maximum(-moves, 0)))
    with np.errstate(divide="ignore", invalid="ignore"):
        index = np.where(down == 0, np.where(up > 0, 100.0, 50.0), 100.0 - 100.0 / (1.0 + up / down))
    out[1:] = np.where(np.isnan(up), np.nan, index)
    return out


def macd(values: np.ndarray, fast: int = 12, slow: int = 26, signal: int = 9, rows: int = HISTORY) -> tuple[np.ndarray, np.ndarray]:
    """MACD and signal lines, nan under ``slow + signal`` values; the signal is seeded with the mean of the window's first ``signal`` differences."""
    line = ema(values, fast, rows) - ema(values, slow, rows)
    head = values[: rows - 1]
    start = _smooth(head, fast, 2.0 / (fast + 1)) - _smooth(head, slow, 2.0 / (slow + 1))
    begun = np.full(len(head), np.nan)
    begun[slow - 1 :] = _smooth(start[slow - 1 :], signal, 2.0 / (signal + 1))
    # the signal of a full window: its differences' weights, each spread over the values that difference is made of
    weights = np.zeros(rows)
    for k, w in enumerate(_weights(rows - slow + 1, signal, 2.0 / (signal + 1))):
        size = slow + k
        weights[:size] += w * (_weights(size, fast, 2.0 / (fast + 1)) - _weights(size, slow, 2.0 / (slow + 1)))
    lines = line, _windows(values, rows, begun, weights)
    for each in lines:
        each[: slow + signal - 1] = np.nan
    return lines


#: Columns that :func:`recursive` can add, each from the float values of an instrument in order.
RECURSIVE = {
    "ema20": lambda v: ema(v, 20), "rsi": rsi, "macd": lambda v: macd(v)[0], "signal": lambda v: macd(v)[1],
    "histogram": lambda v: np.subtract(*macd(v)),
}


def recursive(bars: DataFrame, names: Sequence[str], value: str = "close", key: str = "instrument_id", order: str = "day") -> DataFrame:
    """Adds the named indicators of ``RECURSIVE``: one grouped Arrow pass over an instrument's days, all other columns kept.

    Rows without a value are left out of the series and get null.  A group is one instrument's sessions, a few thousand rows however many
    ticks they come from; windows over the same key before this need no further shuffle.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in bars.schema.fields)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        series = table[value].cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float)
        held = ~np.isnan(series)
        for name in names:
            out = np.full(len(series), np.nan)
            out[held] = RECURSIVE[name](series[held])
            table = table.append_column(name, pa.array(out, pa.float64(), mask=np.isnan(out)))
        return table

    return bars.groupBy(key).applyInArrow(run, f"{kinds}, " + ", ".join(f"`{n}` double" for n in names))


def percentile_rank(population: DataFrame, keys: list[str], value: str, *, name: str = "pct_rank") -> DataFrame:
    """Midpoint rank of each distinct value in its group: (below + equal/2) / n * 100, itself included.

    Groups of any size: values are counted first, then ranked in slices (see ``functions.scale``).
    """
    from knownat.functions.scale import rank_counts

    ranked = rank_counts(population.where(F.col(value).isNotNull()), keys, value)
    return ranked.withColumn(name, (F.col("below") + 0.5 * F.col("equal")) / F.col("of") * 100.0)
