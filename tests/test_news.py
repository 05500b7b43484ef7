import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from knownat.operators import names as nm
from knownat.operators import news as nw

T0 = datetime(2024, 1, 1)


REGISTRY = [
    (1, "삼성전자", [], None), (2, "삼성전자우", [], None), (3, "한섬", [], None), (4, "LG", [], "003550"), (5, "KT&G", ["케이티앤지"], None), (6, "SK하이닉스", [], "000660"),
    (7, "한화", [], None), (8, "대한화섬", None, None), (9, "Naver", ["네이버"], None), (10, "네이버웍스", [], None), (11, "원", [], ""), (12, "신라 젠", [], None),
]
#: title, summary, instrument, (decision, method, reason) or None where nothing counts
CASES = [
    ("삼성전자우 급등", "", 1, None), ("삼성전자우와 삼성전자 급등", "", 1, ("CONFIRMED", "NAME", "name")), ("삼성전자우 급등", "", 2, ("CONFIRMED", "NAME", "name")),
    ("패션 업계 한섬 소식", "", 3, ("PENDING", "NAME", "context:none")), ("패션 업계 한섬 매출 실적", "", 3, ("CONFIRMED", "NAME", "weak:실적+매출")),
    ("패션 업계 한섬 매출", "", 3, ("PENDING", "NAME", "context:매출")), ("한섬, 신제품", "", 3, ("CONFIRMED", "NAME", "strong:title_lead")),
    ("한섬 , 신제품", None, 3, ("CONFIRMED", "NAME", "strong:title_lead")), ("[속보] (종합) “한섬은 신제품", "", 3, ("CONFIRMED", "NAME", "strong:title_lead")),
    ("한섬 이야기", "", 3, ("PENDING", "NAME", "context:none")), ("한섬", ", 신제품", 3, ("PENDING", "NAME", "context:none")),
    ("업계 (주)한섬 소식", "", 3, ("CONFIRMED", "NAME", "strong:corporate_mark")), ("업계 한섬㈜ 소식", "", 3, ("CONFIRMED", "NAME", "strong:corporate_mark")),
    ("업계 ㈜한섬산업 한섬 소식", "", 3, ("PENDING", "NAME", "context:none")), ("지원 (주) 한섬 소식", "", 3, ("PENDING", "NAME", "context:none")),
    ("거대한섬 여행", "", 3, ("REJECTED", None, "absent:inside_word")), ("한섬마을 여행", "", 3, ("PENDING", "NAME", "context:compound")), ("한섬에서는 여행", "", 3, ("PENDING", "NAME", "context:compound")),
    ("업계 한섬에서 실적 공시", "", 3, ("CONFIRMED", "NAME", "weak:실적+공시")),
    ("LG 발표", "", 4, ("PENDING", "NAME", "context:none")), ("lg 발표", "", 4, None), ("LGU 발표", "", 4, None), ("대전LG 발표", "", 4, None), ("LG는 실적", "", 4, ("CONFIRMED", "NAME", "strong:title_lead")),
    ("발표 L G 주가", "", 4, ("PENDING", "NAME", "context:주가")), ("L G 발표 003550", "", 4, ("CONFIRMED", "NAME", "strong:symbol")),
    ("코드 003550 급등", "", 4, ("CONFIRMED", "SYMBOL", "strong:symbol")), ("번호 10035501", "", 4, None), ("주가 00 3550 원", "", 4, None), ("코드 003550", None, 4, ("CONFIRMED", "SYMBOL", "strong:symbol")),
    ("케이티앤지 배당", "", 5, ("CONFIRMED", "ALIAS", "alias")), ("KT & G 배당", "", 5, ("CONFIRMED", "NAME", "name")), ("kt&g", "", 5, ("CONFIRMED", "NAME", "name")),
    ("", "SK 하이닉스 호황", 6, ("CONFIRMED", "NAME", "name")), (None, "sk하이닉스", 6, ("CONFIRMED", "NAME", "name")), ("SK하이 닉스", "", 6, None),
    ("한 화면에", "", 7, None), ("대한화섬 실적 공시", "", 7, None), ("대한화섬 실적", "", 8, ("CONFIRMED", "NAME", "name")),
    ("네이버 실적", "", 9, ("CONFIRMED", "ALIAS", "alias")), ("네이버웍스 실적", "", 9, None), ("naver,", "", 9, ("CONFIRMED", "NAME", "name")),
    ("원 달러", "", 11, ("CONFIRMED", "NAME", "name")), ("신라젠 공시", "", 12, ("CONFIRMED", "NAME", "weak:공시")),
    (None, None, 1, None), ("", "x" * 300 + " 삼성전자 " + "가 나" * 20000 + " SK 하이닉스", 6, ("CONFIRMED", "NAME", "name")),
]


def names_registry(spark, rows=REGISTRY):
    return spark.createDataFrame(rows, "instrument_id long, name string, aliases array<string>, symbol string")


def test_verdicts_of_names(spark):
    articles = spark.createDataFrame([(k, t, s) for k, (t, s, *_) in enumerate(CASES)], "news_item_id long, title string, summary string")
    got = {(r.news_item_id, r.instrument_id): (r.decision, r.match_method, r.decision_reason) for r in nw.judge_articles(articles, names_registry(spark)).collect()}
    for k, (*_, instrument, want) in enumerate(CASES):
        found = got.get((k, instrument), ("REJECTED", None, "absent"))
        assert found == (want or ("REJECTED", None, "absent")), CASES[k][:3]


def test_a_shuffled_registry_gives_the_same_verdicts(spark, monkeypatch):
    rng = random.Random(3)
    words = [r[1] for r in REGISTRY] + ["실적", "주가", "003550", "은", "(주)", ",", "Naver", "네이버"]
    rows = [(k, "".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(4)), " ".join(rng.choice(words) for _ in range(40))) for k in range(60)]
    articles = spark.createDataFrame(rows, "news_item_id long, title string, summary string")
    one = sorted(map(str, nw.judge_articles(articles, names_registry(spark)).collect()))
    monkeypatch.setattr(nm, "_CUTS", (30, 7))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert one and one == sorted(map(str, nw.judge_articles(articles, names_registry(spark)).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_only_places_that_may_begin_a_name_become_rows(spark):
    articles = spark.createDataFrame([(1, "", "x" * 300 + " Naver " + "y" * 300)], "news_item_id long, title string, summary string")
    plan = nw.judge_articles(articles, names_registry(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan and "MapInArrow" in plan


def test_letters_are_the_same_in_both_places(spark):
    rng = random.Random(4)
    parts = ["가", "힣", "ᄀ", "ㄱ", "a", "É", "İ", "Σ", "😀", "\0", "\1", "\2", "\3", *"\t\n\v\f\r\x1c\x1f \x85\xa0\u1680\u180e\u2003\u200b\u2028\u202f\u205f\u3000\ufeff"]
    texts = ["", " "] + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 12))) for _ in range(3000)]
    letters, flags = nm._letters(F.col("text"))
    for text, want, flagged in spark.createDataFrame([(t,) for t in texts], "text string").select("text", letters, flags).collect():
        codes, before = nm._lettered(text)
        assert ("".join(map(chr, codes)), "".join("\3" if b else "0" for b in before)) == (want, flagged), repr(text)


def test_letters_that_are_not_lowered_one_by_one(spark):
    registry = names_registry(spark, [(1, "ΟΔΟΣ", [], None), (3, "𐐀𐐁𐐂𐐃", [], None), (4, "KELVIN", [], None), (5, "Éclat", [], None)])
    rows = [(1, "", "a ΟΔΟΣ b"), (3, "", "a 𐐨𐐩𐐪𐐫 b"), (4, "", "a \u212aelvin b"), (5, "", "a éCLAT b")]
    articles = spark.createDataFrame(rows, "news_item_id long, title string, summary string")
    assert {(r.news_item_id, r.instrument_id) for r in nw.judge_articles(articles, registry).collect()} == {(k, k) for k in (1, 3, 4, 5)}


def test_conflicts_know_names_and_aliases(spark):
    got = {(r.instrument_id, r.name, r.other) for r in nm.conflicts(names_registry(spark)).collect()}
    assert got == {(1, "삼성전자", "삼성전자우"), (7, "한화", "대한화섬"), (9, "네이버", "네이버웍스")}
    assert nm.conflicts(names_registry(spark).limit(0)).collect() == []


def test_conflicts_are_distinct_before_they_meet(spark):
    rows = [(1, "ab", ["a b", "AB"], None), (1, "ab", None, None), (None, "ab", [], None), (None, "ab", [], None), (2, "xaby", ["İab", "i̇ab"], None), (3, None, ["abab"], None)]
    out = nm.conflicts(names_registry(spark, rows))
    plan = out._jdf.queryExecution().optimizedPlan()
    assert plan.toString().index("Join") < plan.toString().index("Aggregate")
    want = {(i, n, o) for i, n in ((1, "ab"), (1, "a b"), (1, "AB"), (None, "ab")) for o in ("xaby", "İab", "i̇ab", "abab")}
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(want) and set(got) == want


def test_every_stale_hit_is_judged_again(spark):
    hits = [
        (1, 3, "한섬, 신제품", "실적", "PENDING", 1, "RULE"), (2, 3, "다른 글", "없음", "CONFIRMED", 1, "RULE"), (3, 3, "한섬", None, "PENDING", 1, "RULE"),
        (4, 99, "한섬", "한섬", "PENDING", 2, "RULE"), (5, 3, "한섬", "x", "PENDING", 1, "MODEL"), (6, 3, "한섬", "x", "PENDING", 5, "RULE"), (7, 6, "", "SK하이닉스 한섬", "CONFIRMED", 2, "RULE"),
    ]
    table = spark.createDataFrame(hits, "hit_id long, instrument_id long, title string, snippet string, decision string, rule_version int, decided_by string")
    got = {r.hit_id: (r.outcome, r.decision, r.decision_reason, r.changed) for r in nm.rejudged(table, names_registry(spark), 5).collect()}
    assert got == {
        1: ("JUDGED", "CONFIRMED", "strong:title_lead", True), 2: ("JUDGED", "REJECTED", "absent", True), 3: ("UNREAD", None, None, False),
        4: ("SKIPPED", None, None, False), 7: ("JUDGED", "CONFIRMED", "name", False)}


def test_theme_days_count_an_address_once(spark):
    rows = [("A", "http://x/1", 1, 1, "SK하이닉스", ""), ("A", "http://x/1", 2, 2, "SK하이닉스", ""), ("A", "javascript:1", 3, 3, "SK하이닉스 대한화섬", ""), ("B", "http://x/1", 1, 1, "SK하이닉스", ""), ("B", None, 1, 9, "x", "")]
    found = spark.createDataFrame(rows, "theme string, url string, published_at int, news_item_id long, title string, summary string")
    got = {tuple(r) for r in nw.theme_days(found, names_registry(spark)).collect()}
    assert got == {("A", 2, "HEADLINE", 1, "http://x/1", None), ("A", 2, "MENTION", 1, "6", 2), ("A", 2, "MENTION", 2, "8", 1), ("B", 1, "HEADLINE", 1, "http://x/1", None), ("B", 1, "MENTION", 1, "6", 1)}


def brute_clusters(times, hours):
    anchors = []
    for t in sorted(times):
        if not anchors or t - anchors[-1] > timedelta(hours=hours):
            anchors.append(t)
    return anchors


def test_clusters_anchor_on_their_first_reading(spark):
    rng = random.Random(5)
    rows = [(i, k, T0 + timedelta(seconds=rng.randrange(20 * 86400))) for i in range(3) for k in ("A", "B") for _ in range(120)]
    df = spark.createDataFrame(rows, "instrument_id long, event_type string, at timestamp").select("instrument_id", "event_type", F.unix_seconds("at").alias("_t")).distinct()
    for r in nw.cluster_anchors(df, ["instrument_id", "event_type"]).collect():
        want = brute_clusters([t for i, k, t in rows if (i, k) == (r["instrument_id"], r["event_type"])], 24)
        assert r["anchors"] == [int((t - datetime(1970, 1, 1)).total_seconds()) for t in want]


def test_clusters_of_a_key_with_every_second(spark):
    # 20 days of every second, in bounded bitmaps: a start a day and a second, and the same from nowhere near the epoch
    for first in (0, -86400 * 400, 1_700_000_000):
        df = spark.range(first, first + 20 * 86400).select(F.lit("k").alias("k"), F.col("id").alias("_t"))
        got = nw.cluster_anchors(df.union(df.limit(1000)), ["k"]).collect()
        assert [r["anchors"] for r in got] == [[first + i * 86401 for i in range(20)]]
    assert nw.cluster_anchors(df.limit(0), ["k"]).collect() == []


def test_merged_intervals_of_a_hot_key(spark):
    rng = random.Random(12)
    rows = [(1 if rng.random() < 0.6 else rng.randrange(2, 5), T0 + timedelta(minutes=rng.randrange(40000)), rng.choice([0, 5, 60, 600, 4000])) for _ in range(900)]
    rows += [(9, T0 + timedelta(days=d), 1440) for d in (0, 1, 2, 5)] + [(9, T0 + timedelta(days=8), 0), (9, T0 + timedelta(days=9, hours=1), -5)]
    spans = [(i, a, a + timedelta(minutes=m)) for i, a, m in rows]
    df = spark.createDataFrame(spans, "instrument_id long, lo timestamp, hi timestamp")
    want = set()
    for key in {i for i, *_ in spans}:
        merged = []
        for a, b in sorted((a, b) for i, a, b in spans if i == key and b >= a):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        want |= {(key, a, b) for a, b in merged}
    got = [tuple(r) for r in nw.merged_intervals(df).collect()]
    assert set(got) == want and len(got) == len(want)
    assert nw.merged_intervals(df.limit(0)).collect() == []


def brute_union(intervals, lo, hi):
    total, reach = 0.0, None
    for a, b in sorted((max(a, lo), min(b, hi)) for a, b in intervals if b > lo and a < hi):
        start = a if reach is None else max(a, reach)
        total += max(0.0, (b - start).total_seconds())
        reach = b if reach is None else max(reach, b)
    return total / 86400


def test_covered_days_and_inside(spark):
    rng = random.Random(11)
    spans = [(1 if rng.random() < 0.8 else 2, T0 + timedelta(minutes=rng.randrange(20000)), rng.randrange(1, 900)) for _ in range(200)]
    rows = [(i, a, a + timedelta(minutes=m)) for i, a, m in spans]
    df = spark.createDataFrame(rows, "instrument_id long, lo timestamp, hi timestamp")
    lo, hi = T0 + timedelta(days=2), T0 + timedelta(days=9)
    got = {r["instrument_id"]: r["days"] for r in nw.covered_days(df, {"w": (F.lit(lo), F.lit(hi))}).collect()}
    for i in (1, 2):
        assert abs(got[i] - brute_union([(a, b) for k, a, b in rows if k == i], lo, hi)) < 1e-9
    moments = [(k % 2 + 1, T0 + timedelta(minutes=rng.randrange(22000))) for k in range(300)]
    asked = spark.createDataFrame(moments, "instrument_id long, at timestamp")
    for r in nw.inside_any(asked, df, "at").collect():
        assert r["inside"] == any(a <= r["at"] <= b for k, a, b in rows if k == r["instrument_id"])


def test_corrections_are_no_events(spark):
    df = spark.createDataFrame([(1, "[기재정정]유상증자결정"), (2, "유상증자결정(자회사의 주요경영사항)"), (3, "유무상증자결정")], "id long, report_nm string")
    got = {r["id"]: (r["event_type"], r["intensity"]) for r in nw.classify_titles(df).collect()}
    assert got == {1: (None, None), 2: ("CAPITAL_RAISE", 0.3), 3: ("CAPITAL_RAISE", 0.5)}
