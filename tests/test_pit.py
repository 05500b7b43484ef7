from datetime import date, datetime

import pytest

from knownat.operators import pit

BARS = "instrument_id long, bar_key int, available_at timestamp, ingested_at timestamp, close double, open double"


def day(d, h=0):
    return datetime(2024, 1, d, h)


def bars(spark, rows):
    return spark.createDataFrame(rows, BARS)


def test_a_newer_revision_not_yet_public_hides_the_bar(spark):
    df = bars(spark, [(1, 1, day(2), day(2), 10.0, 9.0), (1, 1, day(9), day(3), 11.0, 9.5)])
    assert pit.current_bars(df, held_by=day(4), known_by=day(5)).count() == 0
    assert pit.current_bars(df, held_by=day(2), known_by=day(5)).first()["close"] == 10.0


def test_unfinished_prices_fall_back_to_the_last_good_revision(spark):
    df = bars(spark, [(1, 1, day(2), day(2), 10.0, 9.0), (1, 1, day(2), day(3), float("nan"), 9.0)])
    assert pit.current_bars(df).first()["close"] == 10.0


def test_later_rows_never_change_an_earlier_answer(spark):
    early = [(i, k, day(1 + k), day(1 + k), float(i + k), 1.0) for i in range(3) for k in range(5)]
    late = [(i, k, day(1 + k), day(20), 99.0, 1.0) for i in range(3) for k in range(5)] + [(1, 9, day(25), day(3), 5.0, 1.0)]

    def answer(rows):
        got = pit.current_bars(bars(spark, rows), held_by=day(10), known_by=day(10))
        return sorted(map(tuple, got.collect()))

    assert answer(early) == answer(early + late)


def test_windows_only_tighten(spark):
    view = pit.PitView(bars(spark, [(1, 1, day(2), day(2), 1.0, 1.0)]), day(10), day(10))
    tight = view.windowed(not_after=day(12)).windowed(not_after=day(20), not_before=day(3))
    assert tight.not_after == day(12) and tight.not_before == day(3)
    with pytest.raises(pit.PitViolation):
        tight.at(day(13))
    with pytest.raises(pit.PitViolation):
        tight.at(day(2))


def test_symbols_resolve_by_validity(spark):
    seen = spark.createDataFrame([(7, 1, date(2020, 1, 1)), (7, 2, date(2021, 6, 1))], "symbol long, holder long, valid_from date")
    asked = spark.createDataFrame([(7, date(2021, 5, 31)), (7, date(2021, 6, 1)), (7, date(2019, 1, 1))], "symbol long, day date")
    got = {(r["day"], r["holder"]) for r in pit.resolve_symbols(asked, pit.symbol_windows(seen)).collect()}
    assert got == {(date(2021, 5, 31), 1), (date(2021, 6, 1), 2)}


def test_form_family(spark):
    df = spark.createDataFrame([("[기재정정]사업보고서 (2023.12)",), ("10-K/A",), ("분기보고서",)], "form string")
    assert [r[0] for r in df.select(pit.form_family("form")).collect()] == ["사업보고서", "10-K", "분기보고서"]


def test_a_rule_never_overrules_a_model(spark):
    cols = "hit_id long, decision string, decided_by string, decided_at timestamp, id long"
    stored = spark.createDataFrame([(1, "REJECTED", "MODEL", day(1), 1), (2, "PENDING", "RULE", day(1), 2), (3, "CONFIRMED", "RULE", day(1), 3)], cols)
    new = spark.createDataFrame([(1, "CONFIRMED", "RULE", day(2), 4), (2, "CONFIRMED", "RULE", day(2), 5), (3, "CONFIRMED", "RULE", day(2), 6), (4, "PENDING", "RULE", day(2), 7)], cols)
    assert sorted(r["hit_id"] for r in pit.append_verdicts(stored, new, ["decision", "decided_by"]).collect()) == [2, 4]
