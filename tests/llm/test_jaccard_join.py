import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from cases import ODD, documents, frame

from knownat.llm import jaccard_join
from knownat.llm.jaccard_join import JaccardJoin, one_of_each


def brute(rows, width=5):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    posted = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            posted[g].append(i)
    for i, s in enumerate(sets):
        for j in {j for g in s for j in posted[g] if j < i}:
            common = len(s & sets[j])
            if common * 100 >= (len(s) + len(sets[j]) - common) * 75:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(s), least.get(find(i), d)) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def near_copies():
    base = [f"w{i}" for i in range(120)]
    out = []
    for k in range(40):
        w = list(base)
        w[(7 * k) % 120] = f"edit{k}"
        if k % 3 == 0:
            w[(31 * k + 5) % 120] = f"more{k}"
        out.append((700000 + k, " ".join(w)))
    # a chain: neighbours link, the ends do not
    out += [(710000 + k, " ".join(f"c{i}" for i in range(8 * k, 8 * k + 100))) for k in range(12)]
    # a common passage in otherwise different texts links nothing
    out += [(720000 + k, " ".join(base[:40]) + " " + " ".join(f"u{k}x{i}" for i in range(60))) for k in range(20)]
    return out


def test_against_brute_force(spark):
    rows = documents() + near_copies() + ODD
    got = JaccardJoin(frame(spark, rows, parts=5)).members()
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_hot_lists_without_links(spark):
    # short texts that consist mostly of one shared passage: long posting lists with many components
    shared = " ".join(f"p{i}" for i in range(14))
    rows = [(k, shared + " " + " ".join(f"q{k % 9}x{i}" for i in range(6 + k % 3))) for k in range(60)]
    assert sorted(map(tuple, JaccardJoin(frame(spark, rows)).members().collect()), key=str) == brute(rows)


def test_sets_travel_only_for_pairs_that_signatures_allow(spark):
    shared = " ".join(f"p{i}" for i in range(30))
    rows = [(k, shared + " " + " ".join(f"q{k}x{i}" for i in range(60))) for k in range(20)] + [(100 + k, shared + " same" * 3 + f" end{k}") for k in range(5)]
    join = JaccardJoin(frame(spark, rows))
    ids = {r.doc_id: r.cid for r in join.classes.collect()}
    pairs = [(ids[a], ids[b]) for a in ids for b in ids if a < b]
    left = {tuple(r) for r in join._possible(spark.createDataFrame(pairs, "a long, b long")).collect()}
    near = {(ids[a], ids[b]) for a in ids for b in ids if 100 <= a < b}
    assert near <= left and len(left) < 40


def test_repeated_rows_send_their_set_once(spark):
    rows = [(1, "a b c d e f g h i j k l m n o p q r s t u v w x y z")] * 30 + [(2, "a b c d e f g h i j k l m n o p q r s t u v w x y zz")] * 30
    join = JaccardJoin(frame(spark, rows))
    assert [set(r) for r in join.links().collect()] == [{1, 2}]
    assert {tuple(r) for r in join.link_counts().collect()} == {(1, 1, 1), (2, 2, 1)}


def test_empty_table(spark):
    assert JaccardJoin(frame(spark, [])).members().collect() == []
    assert JaccardJoin(frame(spark, [])).links().collect() == []


def test_one_of_each(spark):
    rows = near_copies()[:40] + [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, None), (2, None), (None, "a b c d e f g")]
    docs = frame(spark, rows).selectExpr("doc_id", "text", "1 as id", "2 as of", "3 as row", "4 as spot")
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 2, 700000]


def test_links_are_all_there(spark, monkeypatch):
    """Every similar pair of different sets is a link, also inside one component and across the blocks of long lists and groups."""
    rows = near_copies() + [(1, near_copies()[5][1]), (2, None)]
    # texts of one size that share their whole prefix form groups of several classes
    rows += [(730000 + k, " ".join(f"g{i}" for i in range(90)) + f" tail{k}") for k in range(9)]
    sets = {}
    for d, text in sorted(rows):
        w = (text or "").split()
        if w:
            sets.setdefault(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))), []).append(d)
    pairs = [(x, y) for x in sets for y in sets if sets[x][0] < sets[y][0] and len(x & y) * 100 >= len(x | y) * 75]
    want = {frozenset((sets[x][0], sets[y][0])) for x, y in pairs}
    assert len(want) > 700
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    join = JaccardJoin(frame(spark, rows))
    got = [frozenset(r) for r in join.links().collect()]
    assert len(got) == len(set(got)) and set(got) == want
    counts = [(d, v[0], sum(v[0] in p for p in want)) for v in sets.values() for d in v] + [(2, 2, 0)]
    assert sorted(counts) == sorted(map(tuple, join.link_counts().collect()))


def test_signatures_of_all_sizes():
    """Sets differ in at least as many shingles as their signatures do in bits, whatever their sizes, and large sets are told apart."""
    rng = np.random.default_rng(1)
    whole = np.unique(rng.integers(0, 2**63, 20000).astype(np.uint64))
    sets = [whole[:k] for k in (1, 40, 300, 5000, 9000)] + [whole[3000:12000], whole[-40:]]
    column = pa.array([jaccard_join.signature(s) for s in sets], pa.list_(pa.int64()))
    x, y = np.divmod(np.arange(len(sets) ** 2), len(sets))
    differ = jaccard_join.Signatures(column).differ(x, y).reshape(len(sets), -1)
    true = np.array([[len(np.setxor1d(a, b)) for b in sets] for a in sets])
    assert (differ <= true).all() and (differ == differ.T).all() and not differ.diagonal().any()
    # two of 9,000 with 6,000 in common, Jaccard 0.5, cannot link
    assert not jaccard_join._may_link(np.array([9000]), np.array([9000]), differ[4, 5:6], 75)[0]


def test_cells_cut_by_batches():
    rng = np.random.default_rng(2)
    names = ["list", "lo", "hi", "own", "cid", "n", "comp"]
    rows = [(cell, 0, cell % 2, int(rng.integers(0, 1 + cell % 2)), 100 * cell + k, 60, k % 3) for cell in range(9) for k in range(1 + 3 * cell)]
    table = {n: [r[i] for r in rows] for i, n in enumerate(names)}
    base = rng.integers(0, 2**63, 60).astype(np.uint64)
    table["signature"] = [jaccard_join.signature(np.concatenate([base[: 60 - 5 * (i % 4)], rng.integers(0, 2**63, 5 * (i % 4)).astype(np.uint64)])) for i in range(len(rows))]
    whole = pa.RecordBatch.from_pydict(table)
    pairs = lambda size: sorted(
        (p["a"], p["b"]) for b in jaccard_join._allowed(75)(whole.slice(k, size) for k in range(0, len(rows), size)) for p in b.to_pylist()
    )
    want = [
        (x[4], y[4]) for i, x in enumerate(rows) for y in rows[i + 1 :]
        if x[:3] == y[:3] and x[6] != y[6] and (x[3] != y[3] or x[1] == x[2])
        and jaccard_join.Signatures(pa.array([table["signature"][rows.index(x)], table["signature"][rows.index(y)]])).differ(np.array([0]), np.array([1]))[0] * 175 <= 25 * 120
    ]
    assert len(want) > 50 and all(pairs(size) == sorted(want) for size in (1, 2, 7, 1000))


def test_unlinked_texts_with_a_common_passage_make_no_pairs(spark):
    """Tokens that stand on the same groups are one list, and of a list's classes only pairs that may link become rows."""
    shared = " ".join(f"p{i}" for i in range(68))
    rows = [(k, shared + " " + " ".join(f"q{k}x{i}" for i in range(20))) for k in range(60)] + [(100, shared + " r" * 9), (101, shared + " r" * 9 + " s")]
    join = JaccardJoin(frame(spark, rows))
    lists = defaultdict(set)
    for r in join.listed.collect():
        lists[r.list].add(r.gid)
    held_by = [frozenset(v) for v in lists.values()]
    assert len(held_by) == len(set(held_by)) and max(map(len, held_by)) >= 30
    candidates = join._candidates(join.classes.selectExpr("gid", "cid", "n", "cid as comp"))
    assert candidates.count() < 200  # of 1,891 pairs
    assert sorted(map(tuple, join.members().collect()), key=str) == brute(rows)


def test_forest_is_the_cheapest():
    rng = np.random.default_rng(3)
    for _ in range(100):
        n, m = int(rng.integers(2, 30)), int(rng.integers(0, 80))
        a, b, cost = rng.integers(0, n, m), rng.integers(0, n, m), rng.integers(0, 6, m)
        root, want = np.arange(n), []
        for e in np.argsort(cost, kind="stable").tolist():
            if root[a[e]] != root[b[e]]:
                root[root == root[a[e]]] = root[b[e]]
                want.append(e)
        assert sorted(jaccard_join._forest(a, b, cost).tolist()) == sorted(want)


def test_near_copies_of_one_passage_make_few_pairs(spark):
    """Classes that link with each other but not with their list's leader are joined by a forest: their pairs do not become rows."""
    rng = np.random.default_rng(4)
    rows = [(500, " ".join(f"v{i}" for i in range(14)) + " " + " ".join(f"x{i}" for i in range(90)))]
    for k in range(90):
        w = [f"v{i}" for i in range(100)]
        for at in rng.choice(np.arange(12, 100), 2, replace=False):
            w[at] = f"e{k}x{at}"
        rows.append((k, " ".join(w)))
    join = JaccardJoin(frame(spark, rows))
    classes = join.classes.selectExpr("gid", "cid", "n", "cid as comp")
    pairs = join._candidates(classes, forest=True).where("a is not null").count()
    assert 0 < pairs < join.listed.count() + join.classes.count() < join._candidates(classes).count()
    assert sorted(map(tuple, join.members().collect()), key=str) == brute(rows)
    # a class is on a list once for each leader
    assert join.listed.count() == join.listed.select("list", "gid").distinct().count()
    assert {r.list for r in join.listed.collect()} <= {r.gid for r in join.classes.collect()}
