"""The stream over shuffled files gives the same bars as the batch plan."""

import os
import tempfile
from datetime import datetime

from pyspark.sql import functions as F

from knownat.plans.intraday import ticks
from knownat.streaming import ticks as live


COLS = ["code", "start", "open", "high", "low", "close", "volume", "ticks"]


def same(got, want):
    assert sorted(map(tuple, got.select(*COLS).collect())) == sorted(map(tuple, want.select(*COLS).collect()))


def test_stream_equals_batch(spark, sf):
    base = tempfile.mkdtemp(prefix="knownat-stream-")
    rows = ticks(spark, sf)
    # a month of ticks in random order: most of them are days late
    rows.orderBy(F.xxhash64("arrival")).repartition(7).write.parquet(f"{base}/in")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    for width, every in (("1 minute", 3), ("1 second", 60)):
        tag = width.replace(" ", "")
        live.start_bars(source, width, f"{base}/out-{tag}", f"{base}/cp-{tag}", available_now=True, compact_every=every).awaitTermination()
        same(live.BarStore(spark, f"{base}/out-{tag}").current(), live.bars(rows, width))


def test_a_restarted_stream_counts_late_ticks_and_nothing_twice(spark):
    base = tempfile.mkdtemp(prefix="knownat-stream-")
    kind = "code string, ts timestamp, price double, arrival long, volume long"
    day = lambda d, second, price, arrival: ("A", datetime(2024, 1, d, 9, 0, second), price, arrival, 5)
    parts = [[day(4, 0, 10.0, 1), day(4, 5, 12.0, 2)], [day(2, 30, 7.0, 3), day(4, 1, 9.0, 4)], [day(1, 0, 8.0, 5), day(2, 1, 6.0, 6), day(4, 2, 11.0, 0)]]
    everything = []
    for part in parts:
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(f"{base}/in")
        source = spark.readStream.schema(kind).parquet(f"{base}/in")
        live.start_bars(source, "1 minute", f"{base}/out", f"{base}/cp", available_now=True).awaitTermination()
        everything += part
        same(live.BarStore(spark, f"{base}/out").current(), live.bars(spark.createDataFrame(everything, kind), "1 minute"))
    got = {r["start"].day: (r["open"], r["close"], r["ticks"]) for r in live.BarStore(spark, f"{base}/out").current().collect()}
    assert got == {1: (8.0, 8.0, 1), 2: (7.0, 6.0, 2), 4: (11.0, 9.0, 4)}


def test_store_survives_replays_and_half_written_folders(spark):
    base = tempfile.mkdtemp(prefix="knownat-store-")
    store = live.BarStore(spark, base)
    assert store.current() is None
    store.compact()
    rows = spark.createDataFrame([("A", datetime(2024, 1, 1, 9, 0, k % 60), float(k % 7), k, 1) for k in range(300)], "code string, ts timestamp, price double, arrival long, volume long")
    for batch in (0, 1, 2, 1):  # batch 1 is replayed
        store.write(rows.where(F.col("arrival") % 3 == batch), batch, "1 second")
    want = live.bars(rows, "1 second")
    same(store.current(), want)
    store.compact()
    assert store.parts() == [("base", 2)]
    same(store.current(), want)
    os.makedirs(f"{base}/base=000000000009")  # a fold that its driver did not finish
    os.makedirs(f"{base}/batch=000000000003")
    same(store.current(), want)
    store.compact()
    same(store.current(), want)


def test_late_ticks_update_their_own_bar(spark):
    rows = [("A", "2024-01-01 09:00:05", 10.0, 1, 5), ("A", "2024-01-01 09:01:00", 11.0, 2, 5), ("A", "2024-01-01 09:00:59", 12.0, 3, 5)]
    df = spark.createDataFrame(rows, "code string, t string, price double, arrival long, volume long").withColumn("ts", F.to_timestamp("t"))
    got = {r["start"].minute: (r["open"], r["close"], r["volume"]) for r in live.bars(df, "1 minute").collect()}
    assert got == {0: (10.0, 12.0, 10), 1: (11.0, 11.0, 5)}


def test_frames(spark):
    record = ["0"] * live.WIDTH
    record[live.CODE], record[live.TIME], record[live.PRICE], record[live.VOLUME] = "005930", "090001", "100", "7"
    bad = list(record)
    bad[live.PRICE] = "x"
    raw = [f"0|{live.TRADE}|2|" + "^".join(record + bad), f"0|{live.TRADE}|2|" + "^".join(record), "0|OTHER|1|" + "^".join(record), "ping"]
    df = spark.createDataFrame([(r,) for r in raw], "raw string")
    assert [(r["code"], r["price"], r["volume"]) for r in live.parse_frames(df).collect()] == [("005930", 100.0, 7)] * 2
