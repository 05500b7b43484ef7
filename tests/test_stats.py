import math

import numpy as np
from pyspark.sql import functions as F

from knownat.operators import stats


def brute(y, x, clusters, j):
    inv = np.linalg.inv(x.T @ x)
    beta = inv @ x.T @ y
    e = y - x @ beta
    meat = np.zeros((x.shape[1],) * 2)
    for c in set(clusters):
        s = x[[k == c for k in clusters]].T @ e[[k == c for k in clusters]]
        meat += np.outer(s, s)
    g, n, k = len(set(clusters)), *x.shape
    cov = g / (g - 1) * (n - 1) / (n - k) * inv @ meat @ inv
    return beta[j], beta[j] / math.sqrt(cov[j, j])


def test_ols_with_fixed_effects_and_clusters(spark):
    rng = np.random.default_rng(1)
    n = 240
    signal, monday = rng.integers(0, 2, n), rng.integers(0, 2, n)
    month, week = np.arange(n) // 40, np.arange(n) // 5
    y = 0.5 * signal - 0.2 * monday + 0.3 * month + rng.normal(size=n)
    rows = [(float(y[i]), int(signal[i]), int(monday[i]), f"m{month[i]}", int(week[i]), 7) for i in range(n)]
    df = spark.createDataFrame(rows, "y double, signal int, monday int, month string, week int, flat int")
    fit = stats.ols_cluster(df, "y", ["signal", "monday", "flat"], "week", "signal", group="month")
    x = np.column_stack([np.ones(n), signal, *[(month == m).astype(float) for m in range(1, 6)], monday])
    b, t = brute(y, x, list(week), 1)
    assert fit["dropped"] == "flat" and fit["clusters"] == len(set(week)) and fit["n"] == n
    assert math.isclose(fit["b"], b, rel_tol=1e-9) and math.isclose(fit["t"], t, rel_tol=1e-9)


def test_sign_test(spark):
    rows = [(0, 0), (5, 0), (3, 4), (700, 600), (0, 9)]
    df = spark.createDataFrame(rows, "w int, l int")
    for r in df.select("w", "l", stats.sign_test("w", "l").alias("p")).collect():
        n = r["w"] + r["l"]
        want = None if n == 0 else sum(math.comb(n, k) for k in range(r["w"], n + 1)) / 2 ** n
        assert r["p"] == want if want is None else abs(r["p"] - want) < 1e-9


def test_verdict_gate(spark):
    days = spark.range(80).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("day"), F.col("id"))
    values = days.select("day", F.lit("up").alias("question"), (1.0 + (F.col("id") % 3) * 0.1).alias("value")).unionByName(
        days.select("day", F.lit("fades").alias("question"), F.when(F.col("id") < 40, 1.0).otherwise(-1.0 - (F.col("id") % 2)).alias("value"))).unionByName(
        days.where("id < 10").select("day", F.lit("short").alias("question"), F.lit(1.0).alias("value")))
    got = {r["question"]: r["state"] for r in stats.judge(values, stats.split_days(days, 15)).collect()}
    assert got == {"up": "established", "fades": "not established", "short": "not enough days"}
