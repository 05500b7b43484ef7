import math
import random

import numpy as np
from cases import ODD, SF, documents, frame

from knownat.llm.line_dedup import line_dedup, without_repeated_lines
from knownat.llm.neighbours import nearest
from knownat.llm.queries import QUERIES

VEC = "vec_id long, vec array<double>"


def test_recall(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    got = {}
    for r in QUERIES["op3_neighbours"](spark, SF).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        found = sorted(got[int(ids[q])])
        assert [f[0] for f in found] == list(range(1, 21)) and found == [(i + 1, *f) for i, f in enumerate(sorted((f[1:] for f in found), key=lambda f: (-f[1], f[0])))]
        assert all(abs(f[2] - s[ids == f[1]][0]) < 1e-9 for f in found)
        hits += len(set(ids[np.lexsort((ids, -s))[:20]].tolist()) & {f[1] for f in found})
    assert hits >= 0.9 * 20 * len(got)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 3.0]), (1, [2.0, 2.0]), (2, [2.0, 2.0]), (3, None), (4, [0.0, 0.0]), (5, [math.nan, 1.0]), (6, [None, 1.0]), (7, [math.inf, 1.0]), (None, [1.0, 1.0]), (40, []), (8, [1.0])]
    vectors = spark.createDataFrame(rows, VEC)
    got = nearest(vectors, vectors.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 2.0), (0, 2, 2, 2.0), (0, 3, 20, 0.0), (20, 1, 1, 6.0), (20, 2, 2, 6.0), (20, 3, 0, 0.0)]
    assert nearest(vectors.limit(0), vectors.limit(0)).collect() == []


def brute(rows, n_words):
    """A line goes if a run of lines around it with enough words stands at an earlier place."""
    rows = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    solid = [[(i, s) for i, s in enumerate(x.strip() for x in (t or "").split("\n")) if s] for _, t in rows]
    seen, gone = {}, {}
    for d, lines in enumerate(solid):
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                if sum(len(s.split()) for _, s in lines[a:b]) >= n_words:
                    run = tuple(s for _, s in lines[a:b])
                    if run in seen:
                        gone.setdefault(rows[d], set()).update(range(lines[a][0], lines[b - 1][0] + 1))
                    seen.setdefault(run, (d, a))
    return gone


def test_lines(spark):
    rng = random.Random(4)
    line = lambda: " ".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9)))
    shared = [[line() for _ in range(6)] for _ in range(4)]
    rows = [(k, "\n".join([line(), *rng.choice(shared)[rng.randint(0, 2) :], "", line(), *rng.choice(shared), line()])) for k in range(40)]
    rows += [(100, rows[3][1]), (100, rows[3][1]), *((d, t if not t or len(t) < 9999 else t[:9999]) for d, t in ODD)]
    want = brute(rows, 12)
    got = line_dedup(frame(spark, rows), 12).collect()
    assert len(got) == len(rows)
    for r in got:
        assert set(r.removed) == want.get((r.row.doc_id, r.row.text), set())
        assert r.kept == (r.row.text if not r.removed else "\n".join(x for i, x in enumerate(r.row.text.split("\n")) if i not in r.removed))


def test_columns_stay(spark):
    docs = frame(spark, documents()[:50]).selectExpr("doc_id", "text", "1 as row", "2 as ref", "3 as id", "4 as first")
    out = without_repeated_lines(docs)
    assert out.columns == docs.columns and out.count() == 50
    assert line_dedup(docs.limit(0)).collect() == []
