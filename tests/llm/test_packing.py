import random
import zlib

import numpy as np
import public_tokenizers
from cases import ODD, documents, frame
from tokenizers import Tokenizer

from knownat.llm import packing
from knownat.llm.packing import Coder, Tournament, first_fit_decreasing, packed, sequences
from knownat.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_first_fit():
    rng = random.Random(3)
    sizes = [rng.randint(1, 100) for _ in range(400)] + [100, 100, 1]
    bins, offsets = first_fit_decreasing(np.array(sizes), 100)
    rooms, want = [], []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        spot = next((b for b, room in enumerate(rooms) if room >= sizes[i]), len(rooms))
        if spot == len(rooms):
            rooms.append(100)
        want.append((i, spot, 100 - rooms[spot]))
        rooms[spot] -= sizes[i]
    assert sorted(want) == [(i, b, o) for i, (b, o) in enumerate(zip(bins.tolist(), offsets.tolist()))]
    assert Tournament(1, 5).take(5) == (0, 5)


def test_round_trip(spark):
    rows = [r for r in documents() if r[0] < 150] + ODD + [(910000, "a   b\n\n  c\t\tx <|endoftext|> 'll  "), (910001, "é  \U0001F600 z")]
    docs = frame(spark, rows).selectExpr("doc_id", "text", "1 as row", "2 as `group`", "3 as start")
    got = packed(docs, PATH, group=64).collect()
    coder = Tokenizer.from_file(PATH)
    coder.encode_special_tokens = True
    want = []
    for d, t in rows:
        ids = [*coder.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(d, s, len(ids[s : s + 2048]), zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes()), len(ids)) for s in range(0, len(ids), 2048)]
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:5]) for r in got)
    used = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used.get(r.sequence_id, 0)
        used[r.sequence_id] = r.offset + r.length
    assert max(used.values()) <= 2048


def test_sequences(spark):
    docs = frame(spark, documents()[:20])
    layout = packed(docs, PATH)
    assert all(len(r.ids) == 2048 or len(r.ids) & (len(r.ids) - 1) == 0 for r in sequences(docs, layout, PATH).collect())


def test_empty(spark):
    assert packed(frame(spark, []), PATH).collect() == []


def test_forgotten_chunks_are_encoded_again():
    texts = [t for _, t in documents()[:40]]
    few, many = Coder(PATH, 60), Coder(PATH)
    want = [ids.tolist() for ids in many.ids(texts)]
    for _ in range(2):
        assert [ids.tolist() for t in texts for ids in few.ids([t])] == want
    assert len(few.old) < len(many.young)


def test_white_space_is_cut_like_the_vocabulary_does():
    coder, own, rng = Tokenizer.from_file(PATH), Coder(PATH), random.Random(5)
    coder.encode_special_tokens = True
    parts = [" ", "  ", "   ", "\n", "\t", "a", "don't", "'s", "1", "22", ",", "!?", "é", "日本", "\0", "\u00a0", "\u3000", "\x1c", "\r\n", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 9))) for _ in range(6000)]
    assert [ids.tolist() for ids in own.ids(texts)] == [[*one.ids, 1] for one in coder.encode_batch(texts, add_special_tokens=False)]


def test_both_patterns_cut_alike():
    rng = random.Random(6)
    every = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(every), " ".join(every), *(t for _, t in documents())]
    texts += ["".join(rng.choice([" ", "  ", "'ll", "'s", "\n", rng.choice(every), "a", "1", "!"]) for _ in range(12)) for _ in range(4000)]
    for text in texts:
        assert packing.chunks_of(text) == packing._CHUNK.findall(text)
    assert packing.chunks_of("a \U0001d400 \U0001f600") == ["a", " \U0001d400", " \U0001f600"]


def test_registered_query_on_odd_rows(spark, tmp_path):
    frame(spark, ODD).selectExpr("doc_id", "text", "1 as start", "'x' as sequence_id").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op1_packing"](spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.doc_tokens) for r in got if r.doc_id in (900001, 900002)} == {(900001, 1), (900002, 1)}
    assert sum(r.length for r in got if r.doc_id == 900006) == next(r.doc_tokens for r in got if r.doc_id == 900006)
