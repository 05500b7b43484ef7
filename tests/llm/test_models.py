import math
import re
from collections import Counter

from cases import ODD, SF, documents, frame, held

from knownat.llm import suffix_tree
from knownat.llm.language_id import language, learn
from knownat.llm.queries import QUERIES
from knownat.llm.toxicity import ToxicityModel, subwords, toxicity, train, without_toxic


def test_language_held_out(spark):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    got = QUERIES["op4_language_id"](spark, SF).collect()
    tested = [r for r in got if r.held_out]
    assert len(got) == len(langs) and {r.doc_id for r in tested} == {d for d in langs if held(d, 3) == 1}
    assert sum(langs[r.doc_id] == r.lang_pred for r in tested) >= 0.9 * len(tested) and all(0 <= r.score <= 1 for r in got)


def test_language_odd_rows(spark):
    docs = frame(spark, ODD + [(1, "12 ²³ !?")])
    got = language(docs, [("xx", b"word " * 50), ("yy", b"other things " * 50)]).collect()
    assert len(got) == len(ODD) + 1 and [r.lang_pred for r in got if r.doc_id == 1] == ["und"]
    assert {r.lang_pred for r in language(docs, []).collect()} == {"und"} and language(frame(spark, []), []).collect() == []


def test_dictionary_holds_pieces_of_all_texts(spark):
    docs = frame(spark, [(i, " ".join(f"t{i}x{k}" for k in range(1000))) for i in range(20)]).selectExpr("doc_id", "text", "'xx' as lang")
    [(_, content)] = learn(docs, docs.doc_id >= 0, sample=20, size=4000)
    found = re.findall(r"\bt(\d+)x(\d+)\b", content.decode())
    assert len(content) <= 4000 and {int(i) for i, _ in found} == set(range(20)) and max(int(k) for _, k in found) > 500


def test_toxicity_misspelt():
    filler = [" ".join(f"word{(i * 7 + k * 3) % 50}" for k in range(60)) for i in range(200)]
    texts = [t + (" you scummy wretch" if i % 4 == 0 else "") for i, t in enumerate(filler)]
    model = train(texts, [int(i % 4 == 0) for i in range(200)])
    lean = lambda w: model.word(w)
    assert lean("scumy") > max(lean(f"word{i}") for i in range(50)) and lean("wretchh") > lean("word3")


def test_toxicity_rows(spark):
    docs = frame(spark, ODD)
    flat = ToxicityModel(train(["a"], [0]).bucket, -1.0)
    got = toxicity(docs, flat).collect()
    assert len(got) == len(ODD) and all(abs(r.score - 1 / (1 + math.e)) < 1e-6 for r in got)
    assert without_toxic(docs, flat, 0.1).where("doc_id is not null").count() == 0
    assert without_toxic(docs, flat).count() == len(ODD) and toxicity(frame(spark, []), flat).collect() == []


def test_toxicity_passages_begin_anywhere(spark):
    """A text scores the same wherever its insults stand, and one doubtful last word is read with the words before it."""
    model = ToxicityModel(train(["a"], [0]).bucket.copy(), 0.0)
    model.bucket[subwords("scum")] = 6.0
    rows = [(k, "the " * (20 + k) + "scum scum " + "the " * 20) for k in range(12)] + [(100, "the " * 24 + "scum")]
    got = {r.doc_id: r.score for r in toxicity(frame(spark, rows), model).collect()}
    both, one = ((t * model.word("scum") + (12 - t) * model.word("the")) / 12 for t in (2, 1))
    assert all(abs(got[k] - 1 / (1 + math.exp(-both))) < 1e-9 for k in range(12)) and abs(got[100] - 1 / (1 + math.exp(-one))) < 1e-9


def test_suffix_tree_base(spark):
    rows = documents()[:80] + ODD
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]
    learned = [r for r in rows if r[0] is not None and held(r[0], 7) != 2]
    counts = Counter(w for _, t in learned for w in words(t))
    n, v = sum(counts.values()), len(counts)
    model = suffix_tree.learn(frame(spark, learned), context_share=1e-3, next_share=1e-6)
    assert len(model.nodes) and len(model.pairs)
    got = suffix_tree.scored(frame(spark, rows), model).collect()
    key = lambda x: (str(x[0]), x[1], x[2], round(x[4], 5))
    want = [(d, len(w), sum(x in counts for x in w), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)) for d, w in ((d, words(t)) for d, t in rows)]
    assert [key(x) for x in sorted(want, key=key)] == [key(x) for x in sorted((tuple(r) for r in got), key=key)]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_suffix_tree_is_a_distribution(spark):
    """Over all words and the mass of unseen ones, each kept context's probabilities add up to one."""
    import numpy as np

    texts = [(i, " ".join(("a b c", "a b d", "b a c")[(i * k) % 3] for k in range(9))) for i in range(40)]
    model = suffix_tree.learn(frame(spark, texts), context_share=1e-3, next_share=1e-9, divergence=0.0)
    counts = {r.word: r.n for r in model.counts.collect()}
    bottom = model.tokens + model.distinct + 1
    every = np.array(list(counts), np.int64).view(np.uint64)
    for before in every[:3]:
        tokens = np.array([[before, w] for w in every], np.uint64).ravel()
        gains = model.gains(tokens, np.arange(0, len(tokens) + 1, 2))[1::2]
        known = sum((counts[int(w.view(np.int64))] + 1) / bottom * 10**g for w, g in zip(every, gains))
        assert 0.9 < known <= 1 + 1e-9


def test_suffix_tree_empty(spark):
    model = suffix_tree.learn(frame(spark, []))
    assert [r.score for r in suffix_tree.scored(frame(spark, [(1, "a b")]), model).collect()] == [0.0]
    assert suffix_tree.scored(frame(spark, []), model).collect() == []


def test_suffix_tree_grows_with_the_corpus(spark):
    """A rare context that foretells its next word is kept however much other text there is, and three words decide where two cannot."""
    import numpy as np

    rare = [(i, f"x{i % 8} y z q{i % 8}") for i in range(320)]
    sizes = []
    for more in (0, 6000):
        texts = rare + [(1000 + i, " ".join(f"w{(i * 31 + k * k * 7) % 97}" for k in range(20))) for i in range(more)]
        model = suffix_tree.learn(frame(spark, texts))
        got = suffix_tree.scored(frame(spark, [(1, "x3 y z q3"), (2, "x3 y z q4")]), model).collect()
        gain = {r.doc_id: r.score - r.base_score for r in got}
        assert gain[1] > gain[2] + 0.5
        sizes.append(len(model.nodes))
        tokens, first = suffix_tree.tokens_of(suffix_tree.pa.array(["x3 y z q3", "x3 y z q4"]))
        assert np.allclose([gain[1], gain[2]], np.add.reduceat(model.gains(tokens, first), first[:-1]))
    assert sizes[1] > sizes[0]


def test_suffix_tree_reads_texts_once_a_level(spark):
    """Counting takes one pass for words, one for each level, scoring one more; only their bytes are summed besides.  There were eleven passes."""
    from pyspark.sql import functions as F

    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text

    docs = frame(spark, [(i, f"a b c{i % 3} d") for i in range(30)]).select("doc_id", seen.asNondeterministic()("text").alias("text"))
    assert len(suffix_tree.scored(docs, suffix_tree.learn(docs)).collect()) == 30
    assert read.value <= 30 * (suffix_tree.DEPTH + 4)


def test_suffix_tree_by_other_ways(spark, monkeypatch):
    """Scores are the same whether terms are rare or contexts too large for one task; no kept context is seen less than the least size that can pass."""
    rows = [(i, " ".join(f"w{(i * i * 31 + k * k * (i % 5 + 1)) % 23}" for k in range(40))) for i in range(150)] + documents()[:40] + ODD
    docs = frame(spark, rows)
    key = lambda r: (str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6))
    model = suffix_tree.learn(docs)
    want = sorted(map(key, suffix_tree.scored(docs, model).collect()))
    sizes = [r.n for r in model.terms.where("kind = 'node'").collect()]
    assert sizes and min(sizes) >= suffix_tree.least_size(model.tokens, model.distinct) > suffix_tree.LEAST
    monkeypatch.setattr(suffix_tree, "least_size", lambda *_: suffix_tree.LEAST)
    monkeypatch.setattr(suffix_tree, "FREQUENT", 20)
    monkeypatch.setattr(suffix_tree, "HEAVY", 60)
    other = suffix_tree.learn(docs)
    assert sorted((r.kind, r.key, r.n) for r in other.terms.collect()) == sorted((r.kind, r.key, r.n) for r in model.terms.collect())
    assert sorted(map(key, suffix_tree.scored(docs, other).collect())) == want


def test_word_hashes():
    """Words have the same hash if they are the same words, A-Z lower-cased, however long."""
    import pyarrow as pa

    from knownat.llm.text import bounds, utf8, word_hashes

    texts = [f"{'x' * n} {'X' * n}\t{'x' * (n - 1)}y é{'é' * n}" for n in (1, 7, 8, 9, 16, 63, 64, 65, 300)] + ["a\x00 a", "", None]
    raw, at = utf8(pa.array(texts))
    start, end, _ = bounds(raw, at)
    words = [w.lower() for t in texts for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    hashes = word_hashes(raw, start, end).tolist()
    assert len(words) == len(hashes) and len(set(words)) == len(set(hashes)) == len(set(zip(words, hashes)))
