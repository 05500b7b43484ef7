import random

import duckdb
import numpy as np
import pyarrow as pa
from cases import ODD, SF, documents, frame
from pyspark.sql import functions as F

from knownat.llm import queries
from knownat.llm.fill_in_middle import UNITS, Units, WaveletMatrix, fill_in_middle, restored
from knownat.llm.text import utf8

TRICKY = [(920000, "<P>x"), (920001, "a <S> b"), (920002, "x<M>"), (920003, "<P" * 40), (920004, "S>M><" * 30), (920005, "é日\U0001F600\n x" * 9), (920006, "\n\n"), (920007, "<")]


def test_ranks():
    rng = np.random.default_rng(5)
    for size in (0, 1, 63, 64, 65, 1000):
        symbols = rng.integers(0, 8, size).astype(np.uint8)
        matrix, places = WaveletMatrix(symbols), np.arange(size + 1)
        for s in range(8):
            assert matrix.rank(s, places).tolist() == [int((symbols[:p] == s).sum()) for p in places]


def _ends(text, kind):
    """Characters after which a unit ends, by hand."""
    if kind == "char":
        return list(range(1, len(text) + 1))
    space = " \t\n\v\f\r"
    begins = [i for i, c in enumerate(text) if (i == 0 or text[i - 1] == "\n")] if kind == "line" else [i for i, c in enumerate(text) if c not in space and (i == 0 or text[i - 1] in space)]
    return [*begins[1:], len(text)] if begins else []


def test_units():
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab é日\U0001F600\n\t ") for _ in range(rng.randrange(0, 30))) for _ in range(200)] + ["", "\n", " "]
    raw, at = utf8(pa.array(texts))
    for kind in UNITS:
        units = Units(raw, at, kind)
        want = [_ends(t, kind) for t in texts]
        assert units.count.tolist() == [len(w) for w in want]
        for k in range(6):
            n = np.minimum(k, units.count)
            got = [raw[a:b].tobytes().decode() for a, b in zip(at[:-1], units.cut(n))]
            assert got == [t[: w[m - 1]] if m else "" for t, w, m in zip(texts, want, n.tolist())]


def test_registered_query(spark, tmp_path):
    rows = documents() + ODD + TRICKY
    docs = frame(spark, rows).selectExpr("doc_id", "text", "1 as n", "2 as form", "3 as output")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op11_fill_in_middle"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(queries.ORACLES["op11_fill_in_middle"])
    names = [c[0] for c in want.description]
    assert set(names) == set(got.columns)
    assert sorted(map(str, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(str, want.fetchall()))


def test_round_trip_of_words_and_lines(spark):
    docs = frame(spark, [r for r in documents() + ODD + TRICKY])
    for unit in ("word", "line"):
        cut = fill_in_middle(docs, unit, seed=3).withColumn("back", restored(F.col("output"), F.col("form")))
        got = cut.collect()
        assert sorted(map(str, ((r.doc_id, r.back) for r in got))) == sorted(map(str, ((d, t or "") for d, t in documents() + ODD + TRICKY)))
        assert {r.form for r in got} == {"plain", "psm", "spm"}
        assert all((r.prefix_units is None) == (r.form == "plain") for r in got)
        assert all(r.prefix_units + r.middle_units <= r.n for r in got if r.form != "plain")


def test_empty(spark):
    assert fill_in_middle(frame(spark, [])).collect() == []
