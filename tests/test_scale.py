"""Hot groups: one key holds most of the rows and many ties."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from knownat.functions import scale
from knownat.functions.scale import ordered_digest


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    hot = np.round(rng.exponential(1.0, 4000), 2).tolist() + [0.5] * 1500
    rows = [("hot", float(v)) for v in hot] + [("cold", float(v)) for v in rng.normal(size=7)] + [("one", 4.0)]
    return spark.createDataFrame(rows, "k string, v double").repartition(8).cache()


def by_key(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["k"], []).append(r["v"])
    return out


def test_exact_quantile(skewed):
    groups = by_key(skewed)
    for p in (0.5, 0.25, 0.9):
        got = {r["k"]: (r["median"], r["n"]) for r in scale.exact_quantile(skewed, ["k"], "v", p).collect()}
        for k, values in groups.items():
            assert got[k][1] == len(values)
            assert abs(got[k][0] - np.quantile(values, p)) < 1e-12


def test_rank_counts_and_numbering(skewed):
    groups = by_key(skewed)
    for r in scale.rank_counts(skewed, ["k"], "v").collect():
        values = np.array(groups[r["k"]])
        assert (r["below"], r["equal"], r["of"]) == ((values < r["v"]).sum(), (values == r["v"]).sum(), len(values))
    numbered = scale.numbered(skewed, ["k"], "v").groupBy("k").agg(F.sort_array(F.collect_list(F.struct("rn", "v"))).alias("a"))
    for r in numbered.collect():
        assert [x["rn"] for x in r["a"]] == list(range(1, len(groups[r["k"]]) + 1))
        assert [x["v"] for x in r["a"]] == sorted(groups[r["k"]])


def test_trimmed_mean(skewed):
    for r in scale.trimmed_mean(skewed, ["k"], "v").collect():
        values = sorted(by_key(skewed.where(F.col("k") == r["k"]))[r["k"]])
        cut = int(len(values) * 0.1)
        assert abs(r["trimmed"] - np.mean(values[cut: len(values) - cut])) < 1e-9


def test_newest_is_a_map_side_aggregate(skewed):
    plan = scale.newest(skewed.withColumn("w", F.col("v")), ["k"], ["v"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan and "Window" not in plan


def test_ordered_digests_do_not_depend_on_partitions(spark):
    rng = random.Random(6)
    places = rng.sample(range(-(1 << 40), 1 << 40), 500) + list(range(70000))
    rows = [("k", p, f"t{p}") for p in places] + [("j", 1, "a"), ("j", 1, "b"), ("j", None, "c")]

    def digest(texts):
        return hashlib.sha256(",".join(texts).encode()).hexdigest()

    level = [(p, t) for k, p, t in rows if k == "k"]
    for _ in range(2):
        groups = {}
        for p, t in sorted(level):
            groups.setdefault(p >> 16, []).append(t)
        level = [(q, digest(g)) for q, g in groups.items()]
    want = digest([d for _, d in sorted(level)])
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "k string, place long, text string")
    for parts in (1, 7):
        got = {r.k: (r.hash, r.n) for r in ordered_digest(table.repartition(parts), ["k"], "place", "text", "hash").collect()}
        assert got["k"] == (want, len(places)) and got["j"][1] == 3
