from cases import SF

import corpus_pipeline


def test_stages(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    count = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF).cache()
        assert out.columns == docs.columns, name
        assert 0.5 * count < out.count() <= count, name
        docs, count = out, out.count()
    kept = {r.doc_id for r in docs.select("doc_id").collect()}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in last.select("doc_id").collect()} == kept
