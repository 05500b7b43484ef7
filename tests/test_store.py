"""Stored tables: known keys are ignored, half-written folders are not read, nothing is built twice."""

import os
import tempfile

from knownat.operators import backtest as bt
from knownat.sources.store import BuiltTable, StoredTable

KIND = "a long, b string, v double"


def rows_of(table):
    return sorted(map(str, map(tuple, table.collect())))


def test_known_keys_are_ignored(spark):
    store = StoredTable(spark, tempfile.mkdtemp(prefix="knownat-table-"), ["a", "b"])
    assert store.read() is None
    first = spark.createDataFrame([(1, "x", 1.0), (1, None, 2.0), (None, "x", 3.0), (1, "x", 0.5)], KIND)
    assert store.insert_new(first) == 1
    want = [(1, "x", 0.5), (1, None, 2.0), (None, "x", 3.0)]
    assert rows_of(store.read()) == sorted(map(str, want))
    assert store.insert_new(first) is None and store.versions() == [1]
    assert store.insert_new(spark.createDataFrame([(1, None, 9.0), (2, "y", 4.0)], KIND)) == 2
    assert rows_of(store.read()) == sorted(map(str, [*want, (2, "y", 4.0)]))
    assert rows_of(store.read(upto=1)) == sorted(map(str, want))
    assert store.insert_new(first.limit(0)) is None


def test_half_written_versions_are_not_read(spark):
    path = tempfile.mkdtemp(prefix="knownat-table-")
    store = StoredTable(spark, path, ["a"])
    one = spark.createDataFrame([(1, "x", 1.0)], KIND)
    store.insert_new(one)
    # a driver that was lost before it published
    one.selectExpr("a + 1 AS a", "b", "v").write.parquet(f"{path}/version=000000000002")
    os.remove(f"{path}/version=000000000002/_SUCCESS")
    assert rows_of(store.read()) == ["(1, 'x', 1.0)"]
    assert store.insert_new(spark.createDataFrame([(7, "z", 1.0)], KIND)) == 2
    assert rows_of(store.read()) == ["(1, 'x', 1.0)", "(7, 'z', 1.0)"]


def test_a_build_is_made_once(spark):
    store, made = BuiltTable(spark, tempfile.mkdtemp(prefix="knownat-built-")), []

    def rows(n):
        made.append(n)
        return spark.range(n)

    assert store.newest() is None
    assert [store.build(k, lambda k=k: rows(k)) for k in (3, 3, 5, 4)] == [True, False, True, True]
    assert made == [3, 5, 4] and store.newest().count() == 5


def test_runs_keep_one_hold_out_of_their_own_experiment(spark):
    store = bt.RunStore(spark, tempfile.mkdtemp(prefix="knownat-runs-"), ["strategy", "start"])
    kind = "run_id string, strategy string, start string"
    store.save_runs(spark.createDataFrame([("r", "ma", None), ("s", "ma", "1999"), ("t", "x", None)], kind))
    assert {tuple(r) for r in store.list_runs().select("run_id", "windows", "holdouts").collect()} == {("r", 0, 0), ("s", 0, 0), ("t", 0, 0)}
    window = "run_id string, window_index int, sample string, strategy string, start string, total_return double"
    sent = [("r", 1, "EVALUATE", "ma", None, 0.1), ("r", 3, "HOLDOUT", "ma", None, 0.3), ("r", 2, "HOLDOUT", "ma", None, 0.2), ("s", 1, "HOLDOUT", "ma", "2000", 0.1), ("nobody", 1, "EVALUATE", "ma", None, 0.1)]
    refused = store.save_windows(spark.createDataFrame(sent, window))
    assert {(r.run_id, r.window_index, r.refused) for r in refused.collect()} == {("r", 3, "hold-out already used"), ("s", 1, "hold-out of another experiment")}
    again = store.save_windows(spark.createDataFrame([*sent, ("s", 9, "HOLDOUT", "ma", "1999", 0.5)], window))
    assert {(r.run_id, r.window_index) for r in again.collect()} == {("r", 3), ("s", 1)}
    assert {tuple(r) for r in store.list_runs().select("run_id", "windows", "holdouts").collect()} == {("r", 2, 1), ("s", 1, 1), ("t", 0, 0)}
