"""Nearest neighbours by inner product with a permutation index.

Vectors get one more component that makes all of them equally long, so the largest inner product is the nearest by angle.  A vector is
represented by its ``PREFIX`` nearest pivots in order, and posted in the inverted files of the first ``POSTED`` of them.  A query reads the files
of its nearest ``PROBED`` pivots, ranks what stands there by footrule distance between the orders, and reranks the nearest ``KEPT`` share
of each file part, by exact inner products in double precision.  Files are split into parts of about ``PART`` postings, and a query goes
to every part of a file, so a crowded pivot is many tasks.  Pivots are a bounded sample; every vector is indexed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from knownat.llm.store import written

PIVOTS = 128
PREFIX = 16
POSTED = 2
PROBED = 64
#: Share of a file part that is reranked, and how many at least.
KEPT = 0.4
LEAST = 200
PART = 16384
#: Queries compared with a file part at a time.
BLOCK = 128


def permutations(vectors: np.ndarray, pivots: np.ndarray, longest: float, prefix: int, query: bool) -> np.ndarray:
    """The nearest pivots of each vector, nearest first; a query has no part in the added component."""
    near = vectors @ pivots[:, :-1].T
    if query:
        near = near / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
    else:
        lift = np.sqrt(np.maximum(1 - (vectors / longest) ** 2 @ np.ones(vectors.shape[1]), 0))
        near = near / longest + lift[:, None] * pivots[:, -1]
    return np.argsort(-near, axis=1, kind="stable")[:, :prefix]


def footrule(queries: np.ndarray, orders: np.ndarray, n_pivots: int) -> np.ndarray:
    """Footrule distances of queries to orders over prefixes; an absent pivot stands behind the last."""
    prefix = orders.shape[1]
    rank = np.full((len(queries), n_pivots), prefix, np.int32)
    np.put_along_axis(rank, queries, np.arange(queries.shape[1], dtype=np.int32)[None], 1)
    total = np.zeros((len(queries), len(orders)), np.int32)
    for k in range(prefix):
        moved = rank[:, orders[:, k]]
        total += np.abs(moved - k) - (prefix - moved)  # what the pair pays instead of both being absent
    return total


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), np.float64).reshape(len(flat), -1)


def _code(shared, n: int, query: bool):
    """Adds to each vector its ``n`` nearest pivots."""

    def code(batches):
        pivots, longest = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            order = permutations(_matrix(batch.column("vec")), pivots, longest, n, query)
            lists = pa.array(order.astype(np.int32).tolist(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("row"), batch.column("vec"), lists], ["vec_id", "row", "vec", "perm"])

    return code


def _search(k: int, n_pivots: int, kept: float, least: int):
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
    names = ["query_id", "query_row", "vec_id", "row", "score"]

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        """One part of a pivot's file and the queries that read it."""
        found: list[list[np.ndarray]] = [[] for _ in names]
        if left.num_rows and right.num_rows:
            orders, vectors = _matrix(left["perm"]).astype(np.int64), _matrix(left["vec"])
            ids, rows = left["vec_id"].to_numpy(), left["row"].to_numpy()
            budget = min(len(ids), max(least, int(kept * len(ids))))
            asked, wanted = _matrix(right["perm"]).astype(np.int64), _matrix(right["vec"])
            q_ids, q_rows = right["vec_id"].to_numpy(), right["row"].to_numpy()
            for lo in range(0, len(q_ids), BLOCK):
                part = slice(lo, lo + BLOCK)
                far = footrule(asked[part], orders, n_pivots)
                near = np.argpartition(far, budget - 1, axis=1)[:, :budget] if budget < len(ids) else np.broadcast_to(np.arange(len(ids)), far.shape)
                exact = wanted[part] @ vectors.T
                score = np.take_along_axis(exact, near, 1)
                score = np.where(rows[near] == q_rows[part][:, None], -np.inf, score)
                for i in range(len(near)):
                    order = np.lexsort((ids[near[i]], -score[i]))[: k + 1]
                    order = order[np.isfinite(score[i][order])][:k]
                    at = near[i][order]
                    products = (vectors[at] * wanted[lo + i]).sum(1)
                    for column, value in zip(found, (np.full(len(at), q_ids[lo + i]), np.full(len(at), q_rows[lo + i]), ids[at], rows[at], products)):
                        column.append(value)
        return pa.table([pa.array(np.concatenate(c) if c else [], kind) for c, kind in zip(found, kinds)], names=names)

    return search


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, n_pivots: int = PIVOTS, prefix: int = PREFIX, posted: int = POSTED, probed: int = PROBED, kept: float = KEPT, least: int = LEAST) -> DataFrame:
    """The ``k`` found vectors with the largest inner product: query_id, rank (from 1), vec_id, score.

    Takes ``(vec_id, vec)``; queries are (vec_id) of rows among them, a query is no neighbour of itself.  Vectors that are null, zero, or hold
    null or non-finite components, and rows of another dimension than most, take no part; ties go to the smaller vec_id; rows with equal
    vec_id are vectors of their own; with fewer than ``k`` found all of them return; other columns are ignored.
    """
    spark = vectors.sparkSession
    good = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    sound = vectors.select("vec_id", "vec").where("vec is not null and vec_id is not null").where(good)
    sizes = sound.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    width = sizes[0]["d"] if sizes else 1
    sound = written(sound.where(F.size("vec") == width).withColumn("row", F.monotonically_increasing_id()), "vectors")
    longest = sound.agg(F.max(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x)))).first()[0] or 1.0
    chosen = sound.orderBy(F.xxhash64("vec_id", "row"), "row").limit(n_pivots).collect()  # n_pivots rows
    pivots = np.array([r["vec"] for r in chosen]).reshape(-1, width) / longest
    pivots = np.concatenate([pivots, np.sqrt(np.maximum(1 - (pivots**2).sum(1, keepdims=True), 0))], 1)
    shared = spark.sparkContext.broadcast((pivots, longest))
    prefix = min(prefix, max(1, len(pivots)))
    kind = f"vec_id long, row long, vec {sound.schema['vec'].dataType.simpleString()}, perm array<int>"
    posts = sound.mapInArrow(_code(shared, prefix, False), kind).select("vec_id", "row", "vec", "perm", F.explode(F.slice("perm", 1, posted)).alias("pivot"))
    files = sound.count() * posted / max(1, len(pivots))
    parts = max(1, int(-(-files // PART)))
    posts = posts.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int"))
    asked = sound.join(queries.select("vec_id").distinct(), "vec_id", "left_semi").select("vec_id", "row", "vec")
    asked = asked.mapInArrow(_code(shared, max(prefix, probed), True), kind)
    asked = asked.select("vec_id", "row", "vec", F.slice("perm", 1, prefix).alias("perm"), F.explode(F.slice("perm", 1, probed)).alias("pivot"))
    asked = asked.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    found = posts.groupBy("pivot", "part").cogroup(asked.groupBy("pivot", "part")).applyInArrow(
        _search(k, max(1, len(pivots)), kept, least), "query_id long, query_row long, vec_id long, row long, score double"
    )
    found = found.groupBy("query_id", "query_row", "vec_id", "row").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
