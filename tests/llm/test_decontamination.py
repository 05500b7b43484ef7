import hashlib
import re

import duckdb
from cases import ODD, SF, documents, frame
from pyspark.sql import functions as F

from knownat.llm.decontamination import PositionalIndex, contamination, windows, without_items
from knownat.llm.queries import ORACLES, QUERIES


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(rows, items, width=10):
    cut = {}
    for i, t in items:
        w = words(t)
        for s in range(max(1, len(w) - width + 1)) if w else ():
            cut.setdefault(tuple(w[s : s + width]), set()).add(i)
    out = []
    for d, t in rows:
        w, hit, named = words(t), set(), set()
        for n in {len(c) for c in cut}:
            for s in range(len(w) - n + 1):
                if (found := cut.get(tuple(w[s : s + n]))) is not None:
                    hit.update(range(s, s + n))
                    named |= found
        out.append((d, len(w), len(hit), sorted(str(x) for x in named if x is not None), bool(hit)))
    return sorted(out, key=str)


ITEMS = [(1, "the quick brown fox jumps over the lazy dog and then it sleeps"), (2, "Short Item"), (3, None), (4, "..."), (5, "été É naïve"), (6, "a a a a a a a a a a a a"), (None, "lone words here"), (2, "Short Item"), (7, "the quick brown fox jumps over the lazy dog and")]
TEXTS = [
    (1, "Well: THE quick, brown fox jumps over the lazy dog and then it slept."), (2, "a short-item; short item"), (3, "ÉTÉ é naïve. été É naïve!"), (4, "a " * 30), (5, "a a a a a a a a a"),
    (6, "the quick brown fox jumps over a lazy dog and then it sleeps"), (7, "x lone words here y"), (8, "dog lazy the over jumps"),
]


def test_against_brute_force(spark):
    rows = TEXTS + ODD
    got = contamination(frame(spark, rows), spark.createDataFrame(ITEMS, "item_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r.items), r.contaminated) for r in got), key=str) == brute(rows, ITEMS)


def test_documents(spark):
    items = [(r[0], r[1]) for r in duckdb.connect().execute(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()]
    want = {(d, n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), c) for d, n, h, i, c in brute(documents(), items)}
    got = QUERIES["op5_decontamination"](spark, SF).collect()
    assert {(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got} == want and any(w[2] for w in want)


def test_large_term_tables_shuffle(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = contamination(frame(spark, TEXTS), spark.createDataFrame(ITEMS, "item_id long, text string"))
        assert "BroadcastHashJoin" not in found._jdf.queryExecution().toString()
        got = found.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r.items), r.contaminated) for r in got), key=str) == brute(TEXTS, ITEMS)


def test_no_python(spark):
    plan = contamination(frame(spark, TEXTS), spark.createDataFrame(ITEMS, "item_id long, text string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_proximity(spark):
    items = spark.createDataFrame([(1, "over lazy dog"), (2, "fox missingword")], "item_id long, text string")
    index = PositionalIndex(frame(spark, TEXTS), windows(items))
    assert {r.doc_id for r in index.near(0).collect()} == set()
    assert {r.doc_id for r in index.near(1).collect()} == {1, 6, 8}


def test_without_items(spark):
    docs = frame(spark, TEXTS + ODD).select("doc_id", "text", F.lit(1).alias("id"), F.lit(2).alias("row"), F.lit(3).alias("ref"))
    kept = without_items(docs, spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == sorted(d or 0 for d, n, h, i, c in brute(TEXTS + ODD, ITEMS) if not c)


def test_empty(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert contamination(frame(spark, []), items).collect() == []
    assert contamination(frame(spark, TEXTS), items.limit(0)).where("contaminated").collect() == []


def test_sql(spark):
    assert "op5_decontamination" in ORACLES
