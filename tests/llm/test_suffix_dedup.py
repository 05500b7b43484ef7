import random
from collections import Counter

from cases import ODD, documents, frame

from knownat.llm.suffix_dedup import suffix_dedup


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (d, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs, prev = 0, 0
        for g in gone:
            runs += g and not prev
            prev = g
        out.append((d, len(t), sum(gone), runs, bytes(b for b, g in zip(t, gone) if not g)))
    return sorted(out, key=str)


def planted():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefé") for _ in range(rng.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, copy = prose(60), prose(300)
    rows = [(1, copy), (2, copy), (3, copy[:700] + "X" + copy[701:]), (4, copy[:250] + copy[252:]), (5, prose(30) + passage + prose(30) + passage + prose(9))]
    rows += [(10 + k, prose(20 + k) + passage[k : len(passage) - k] + prose(12)) for k in range(30)]
    rows += [(50, "ab" * 700), (51, "z" * 399), (52, "z" * 399), (53, "q" * 401), (54, passage[:100] + "!" + passage[101:])]
    return rows


def result(spark, rows, length=400, **options):
    got = suffix_dedup(frame(spark, rows, parts=4), length, **options).collect()
    return sorted(((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.removed), len(r.removed), bytes(r.kept)) for r in got), key=str)


def test_planted(spark):
    rows = planted() + [(d, t[:20000] if t else t) for d, t in ODD]
    assert result(spark, rows) == brute(rows, 400)


def test_short_windows_and_large_seeds(spark):
    # a small batch forces the counted path for seeds with many different spans
    rows = planted()
    assert result(spark, rows, 60, seed=20, batch_size=5) == brute(rows, 60)


def test_documents(spark):
    rows = [(d, t[:6000]) for d, t in documents()]
    assert result(spark, rows) == brute(rows, 400)


def test_empty(spark):
    assert result(spark, []) == []
