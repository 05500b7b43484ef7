import numpy as np
import pyarrow.parquet as pq
import pytest
from cases import ODD, documents, frame, held
from pyspark.sql import functions as F

from knownat.llm import quality, queries


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_held_out_rows_of_the_registered_query(spark, sf):
    folder = f"/root/testdata/{sf}"
    got = queries.QUERIES["op12_quality"](spark, folder).collect()
    labels = pq.read_table(f"{folder}/labels.parquet").to_pydict()
    label = dict(zip(labels["doc_id"], labels["quality"]))
    assert len(got) == pq.read_metadata(f"{folder}/documents.parquet").num_rows
    assert all(r.held_out == (held(r.doc_id, 4) == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    tried = [(label[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in label]
    good, bad = [p for y, p in tried if y == 1], [p for y, p in tried if y == 0]
    assert np.mean(good) >= 0.98 and np.mean(bad) <= 0.1


def test_features_do_not_depend_on_neighbours():
    texts = ["Oneaea Oneaea, x", "", "  \n", "日本 é", "a b a b", "x"]
    whole = quality.features(texts)
    for k, t in enumerate(texts):
        alone = quality.features([t])
        for bag, one in zip(whole, alone):
            for (codes, first), (codes1, _) in zip(bag, one):
                assert codes[first[k] : first[k + 1]].tolist() == codes1.tolist()
    pairs = quality.features(["oo oo"])[2][0][0].tolist()
    assert pairs == quality.features(["pp pp"])[2][0][0].tolist() != quality.features(["pp oo"])[2][0][0].tolist()


def test_long_texts_count_as_a_whole(monkeypatch):
    model = quality.train(["good one here", "BAD!! BAD!!"] * 20, [1, 0] * 20)
    text = "good one here and there\n" * 50 + "BAD!! "
    want = model.scores([text, None, "", text + "x"])
    monkeypatch.setattr(quality, "BLOCK", 120)
    got = model.scores([text, None, "", text + "x"])
    assert np.allclose(got, want, atol=0.05)
    assert len(quality.blocks(text)) > 5 and "".join(quality.blocks(text)) == text
    assert quality.blocks("y" * 500) == ["y" * 120] * 4 + ["y" * 20]


def test_odd_rows(spark):
    model = quality.train([t for _, t in documents()[:60]], [d % 2 for d, _ in documents()[:60]])
    docs = frame(spark, ODD).selectExpr("doc_id", "text", "1 as score", "2 as quality")
    got = quality.quality(docs, model).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(d) for d, _ in ODD)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.score)
    assert len(by[900002]) == 1 and by[900001] == by[900002] == by[900003] and len(by[900007]) == 1
    assert quality.quality(frame(spark, []), model).collect() == []


def test_fit_without_two_classes(spark):
    docs = frame(spark, documents()[:20] + ODD)
    labels = spark.createDataFrame([(1, 1, None), (2, 1, 0), (None, 0, 0), (3, None, 1), (4, 7, 1), (2, 1, 0), (900007, 1, 1)], "doc_id long, quality int, text int")
    model = quality.fit(docs, labels, F.lit(True))
    assert model.bias > 0 and not model.feature.any()
    assert quality.fit(docs, labels.limit(0), F.lit(True)).bias == 0.0
