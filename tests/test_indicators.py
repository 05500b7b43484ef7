import math
import random
import statistics

import numpy as np

from pyspark.sql import functions as F

from knownat.functions import numeric as num
from knownat.operators import indicators as ind
from knownat.operators import market as mk

# the worked example of the index's author: 70.53 on the fifteenth close
WILDER = [44.34, 44.09, 44.15, 43.61, 44.33, 44.83, 45.10, 45.42, 45.84, 46.08, 45.89, 46.03, 45.61, 46.28, 46.28]


def last(function, values):
    """The newest figure of a series, None where there is none."""
    out = float(function(np.array(list(values), float))[-1])
    return None if math.isnan(out) else out


def brute_ema(values, n):
    if len(values) < n:
        return None
    e = sum(values[:n]) / n
    for v in values[n:]:
        e = (v - e) * 2 / (n + 1) + e
    return e


def brute_macd(values):
    line = [brute_ema(values[:k], 12) - brute_ema(values[:k], 26) for k in range(26, len(values) + 1)]
    return line[-1], brute_ema(line, 9)


def brute_rsi(values, n=14):
    moves = [b - a for a, b in zip(values, values[1:])]
    if len(moves) < n:
        return None
    up, down = (sum(max(s * m, 0) for m in moves[:n]) / n for s in (1, -1))
    for m in moves[n:]:
        up, down = (up * (n - 1) + max(m, 0)) / n, (down * (n - 1) + max(-m, 0)) / n
    return (100.0 if up > 0 else 50.0) if down == 0 else 100 - 100 / (1 + up / down)


def walk(n, seed=7):
    rng, out = random.Random(seed), [100.0]
    while len(out) < n:
        out.append(out[-1] * (1 + rng.gauss(0, 0.02)))
    return out


def test_rsi_matches_the_published_example():
    assert abs(last(ind.rsi, WILDER) - 70.53) < 0.1


def test_rsi_edges():
    assert last(ind.rsi, range(1, 20)) == 100.0 and last(ind.rsi, range(1, 400)) == 100.0
    assert last(ind.rsi, [5.0] * 20) == 50.0 and last(ind.rsi, [5.0] * 400) == 50.0
    assert last(ind.rsi, range(14)) is None


def test_every_window_equals_its_own_recurrence():
    values = walk(330)
    series = np.array(values)
    line, signal = ind.macd(series)
    ema, rsi = ind.ema(series, 20), ind.rsi(series)
    for k in [*range(1, 60), *range(245, 256), 300, 330]:
        window = values[max(0, k - 250) : k]
        for got, want in ((ema, brute_ema(window, 20)), (rsi, brute_rsi(window))):
            assert math.isnan(got[k - 1]) if want is None else math.isclose(got[k - 1], want, rel_tol=1e-9)
        if k >= 35:
            want_line, want_signal = brute_macd(window)
            assert math.isclose(line[k - 1], want_line, abs_tol=1e-9) and math.isclose(signal[k - 1], want_signal, abs_tol=1e-9)
        else:
            assert math.isnan(line[k - 1]) and math.isnan(signal[k - 1])


def test_recursive_columns_per_instrument(spark):
    rows = [(i, d, v, "x") for i, seed in ((1, 3), (2, 4)) for d, v in enumerate(walk(300, seed))] + [(1, 1000, None, "x"), (3, 0, 5.0, None)]
    df = spark.createDataFrame(rows, "instrument_id long, day int, close double, other string").repartition(7)
    got = {(r.instrument_id, r.day): r for r in ind.recursive(df, ["ema20", "histogram"]).collect()}
    assert len(got) == len(rows) and got[3, 0].ema20 is None and got[1, 1000].histogram is None and got[1, 0].other == "x"
    for i, seed in ((1, 3), (2, 4)):
        line, signal = brute_macd(walk(300, seed)[-250:])
        assert math.isclose(got[i, 299].histogram, line - signal, abs_tol=1e-9)
        assert math.isclose(got[i, 299].ema20, brute_ema(walk(300, seed)[-250:], 20), rel_tol=1e-9)
    assert ind.recursive(df.limit(0), ["rsi"]).collect() == []


def test_short_windows_are_null_and_flat_ones_are_zero(spark):
    rows = [(1, i, float(v)) for i, v in enumerate([5.0] * 20 + [7.0])]
    df = spark.createDataFrame(rows, "instrument_id long, day int, close double")
    out = df.select("day", ind.sma("close", 20).alias("m"), ind.zscore("close", 20).alias("z")).orderBy("day").collect()
    assert out[18]["m"] is None and out[18]["z"] is None
    assert out[19]["m"] == 5.0 and out[19]["z"] == 0.0
    tail = [5.0] * 19 + [7.0]
    assert math.isclose(out[20]["z"], (7 - statistics.fmean(tail)) / statistics.pstdev(tail))


def test_percentile_rank_uses_midpoint_ties(spark):
    df = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 2.0, 3.0)], "k string, v double")
    got = {r["v"]: r["pct_rank"] for r in ind.percentile_rank(df, ["k"], "v").collect()}
    assert got == {1.0: 12.5, 2.0: 50.0, 3.0: 87.5}


def test_price_limit_states(spark):
    rows = [(13000.0,) * 4 + (10000.0,), (10000.0, 13000.0, 10000.0, 13000.0, 10000.0), (10000.0, 13000.0, 10000.0, 12000.0, 10000.0), (1.0, 1.0, 1.0, 1.0, 10001.0)]
    df = spark.createDataFrame(rows, "open double, high double, low double, close double, base double")
    assert [r["s"] for r in df.select(mk.limit_state().alias("s")).collect()] == ["LOCKED", "CLOSED", "TOUCHED", None]


def test_tick_rounding(spark):
    df = spark.createDataFrame([(1999.5,), (10001.0,), (50000.0,)], "p double")
    got = [tuple(r) for r in df.select(num.tick("p"), num.round_up("p"), num.round_down("p"), num.sell_below("p")).collect()]
    assert got == [(1, 2000.0, 1999.0, 1998.0), (10, 10010.0, 10000.0, 9990.0), (100, 50000.0, 50000.0, 49900.0)]
