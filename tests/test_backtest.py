from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from knownat.operators import backtest as bt
from knownat.operators import calendar as cal


def sessions(spark, n):
    days = spark.range(n).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("day"))
    return cal.sessions_from_days(days)


def test_windows_tile_and_leave_the_holdout(spark):
    rows = bt.walk_forward_windows(sessions(spark, 50), train=20, evaluate=10, holdout=8).orderBy("window_index", "sample").collect()
    ev = [(r["start_day"], r["end_day"]) for r in rows if r["sample"] == "EVALUATE"]
    first = date(2024, 1, 1)
    assert ev == [(first + timedelta(20), first + timedelta(29)), (first + timedelta(30), first + timedelta(39))]
    assert [(r["start_day"], r["sessions"]) for r in rows if r["sample"] == "HOLDOUT"] == [(first + timedelta(42), 8)]


def test_fills_at_the_next_open_with_costs(spark):
    prices = [(10.0, 10.0), (10.0, 11.0), (12.0, 12.0), (13.0, 14.0), (15.0, 15.0), (16.0, 16.0)]
    signal = ["ENTER", "HOLD", "ENTER", "EXIT", "ENTER", "ENTER"]
    rows = [(1, "s", date(2024, 1, 1) + timedelta(i), o, c, signal[i]) for i, (o, c) in enumerate(prices) if i != 1]
    df = spark.createDataFrame(rows, "instrument_id long, strategy string, day date, open double, close double, signal string")
    sess = sessions(spark, 6)
    window = sess.agg(F.min("day").alias("start_day"), F.max("day").alias("end_day"), F.max("close_at").alias("window_end")).select(
        F.lit(0).cast("long").alias("window_index"), F.lit("EVALUATE").alias("sample"), "*")
    keys = ["instrument_id", "strategy"]
    out = bt.filled(bt.decisions(df, sess, window, keys), keys).orderBy("day").collect()
    events = [(r["day"].day, r["fill"], r["event"]) for r in out]
    # day 1: no bar on day 2 to fill at; day 2: no own bar; day 3 buys at 13; day 4 sells at 15; day 5 buys at 16; the last day cannot fill
    assert events == [(1, None, "UNFILLED"), (2, None, "NO_DATA"), (3, "BUY", None), (4, "SELL", None), (5, "BUY", None), (6, None, None)]
    paid, got = 13 * 1.0005 * 1.0005, 15 * 0.9995 * 0.9995
    assert abs(out[3]["trade_return"] - (got / paid - 1)) < 1e-12
    assert abs(out[3]["equity"] - 14 / paid) < 1e-12
    assert out[1]["equity"] == 1.0
    assert abs(out[5]["equity"] - got / paid * 16 / (16 * 1.0005 * 1.0005)) < 1e-12


def test_integrity_and_reproduction(spark):
    rows = [(1, 0, "TRAIN", date(2024, 1, 1), date(2024, 1, 10)), (1, 0, "EVALUATE", date(2024, 1, 10), date(2024, 1, 20)), (2, 0, "EVALUATE", date(2024, 1, 1), date(2024, 1, 5)), (2, -1, "HOLDOUT", date(2024, 2, 1), date(2024, 3, 1))]
    df = spark.createDataFrame(rows, "run_id long, window_index long, sample string, start_day date, end_day date")
    assert [tuple(r) for r in bt.integrity(df).collect()] == [(1, "training reaches into evaluation")]
    cols = ", ".join(f"{m} double" for m in bt.MEASURES)
    stored = spark.createDataFrame([(1, *[1.0] * 12), (2, *[2.0] * 11, None)], f"k long, {cols}")
    rerun = spark.createDataFrame([(1, *[1.0] * 12), (2, *[2.0] * 10, 3.0, None)], f"k long, {cols}")
    got = {r["k"]: r["differences"] for r in bt.reproduce(stored, rerun, ["k"]).collect()}
    assert got == {1: [], 2: ["without_data"]}


def test_bad_parameters(spark):
    with pytest.raises(ValueError):
        bt.moving_average_cross(None, 60, 20)
    with pytest.raises(ValueError):
        bt.build(None, "unknown", {})
