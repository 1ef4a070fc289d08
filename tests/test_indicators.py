"""Indicators, gaps, drift, fading news and phrase history on small tables."""

import math
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from phrasecast.operators import history, indicators as ind


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def test_zscores_defined_for_flat_and_single_windows(spark):
    rows = [("a", date(2020, 1, 1), 1.0), ("a", date(2020, 1, 2), 3.0), ("a", date(2020, 6, 1), 9.0), ("b", date(2020, 1, 1), 2.0),
            ("b", date(2020, 1, 1), 2.0), (None, date(2020, 1, 1), 2.0), ("a", None, 2.0), ("a", date(2020, 1, 2), None)]
    df = spark.createDataFrame(rows, "key string, day date, v double")
    got = ind.trailing_zscores(df, ["key"], "day", "v", 90)
    assert len(got.collect()) == len(rows)
    assert rows_of(got.filter("v = 3"), "zscore") == [(pytest.approx(1 / math.sqrt(2)),)]
    assert rows_of(got.filter("key = 'b'"), "zscore") == [(0.0,), (0.0,)]
    assert rows_of(got.filter("v = 9 OR v IS NULL OR key IS NULL OR day IS NULL"), "zscore") == [(None,)] * 4


@pytest.mark.parametrize("error", [None, 0.001])
def test_winsorise(spark, error):
    rows = [("a", float(i)) for i in range(101)] + [("one", 7.0), ("same", 3.0), ("same", 3.0), ("a", None), ("a", float("nan")), (None, 5.0), ("void", None)]
    df = spark.createDataFrame(rows, "key string, v double")
    bounds = ind.fit_bounds(df, ["key"], "v", 0.05, 0.95, error)
    got = ind.winsorise(df, ["key"], "v", bounds, "w")
    numbers = [r[0] for r in rows_of(got.filter("key = 'a' AND w IS NOT NULL"), "w")]
    assert (min(numbers), max(numbers), len(numbers)) == (5.0, 95.0, 101)
    assert rows_of(got.filter("key = 'one' OR key = 'same'"), "w") == [(3.0,), (3.0,), (7.0,)]
    assert rows_of(got.filter("key IS NULL"), "w") == [(5.0,)] and rows_of(got.filter("key = 'void'"), "w") == [(None,)]
    flags = ind.missing_flags(df, ["key", "v"])
    assert (flags.filter("v_missing").count(), flags.filter("key_missing").count()) == (3, 1)
    with pytest.raises(ValueError):
        ind.fit_bounds(df, ["key"], "v", 0.9, 0.1)


def test_fills_are_fitted_on_one_table_and_used_on_another(spark):
    kinds = "x double, y int, c string, z double"
    train = spark.createDataFrame([(1.0, 4, "b", None), (None, 6, "a", None), (float("nan"), None, "a", None), (2.0, 6, "b", None), (9.0, 1, None, None)], kinds)
    other = spark.createDataFrame([(None, None, None, None), (5.0, 8, "new", 1.0), (float("nan"), 2, "b", None)], kinds)
    fills = ind.fit_fills(train, ["x", "y", "z"], ["c"])
    assert rows_of(fills, "column", "number", "category") == [("c", None, "a"), ("x", 2.0, None), ("y", 5.0, None)]  # a and b tie
    got = ind.fill_gaps(other, fills, ["x", "y", "z"], ["c"])
    assert rows_of(got, "x", "y", "c", "z") == [(2.0, 2.0, "b", None), (2.0, 5.0, "a", None), (5.0, 8.0, "new", 1.0)]
    with pytest.raises(ValueError):
        ind.fit_fills(train)


def psi_of(train, recent, borders):
    shares = lambda x: [max(sum((lo is None or v > lo) and (hi is None or v <= hi) for v in x) / len(x), 1e-4)
                        for lo, hi in zip([None, *borders], [*borders, None])]
    return sum((a - e) * math.log(a / e) for e, a in zip(shares(train), shares(recent)))


def test_drift(spark):
    train = [("same", float(i % 50)) for i in range(200)] + [("moved", float(i)) for i in range(100)] + [("gone", 1.0), ("gone", 2.0), ("flat", 3.0)]
    recent = [("same", float(i % 50)) for i in range(100)] + [("moved", float(i + 60)) for i in range(50)] + [("new", 1.0), ("flat", 3.0), ("gone", None)]
    a, b = (spark.createDataFrame(x, "key string, v double") for x in (train, recent))
    got = {r["key"]: r for r in ind.drift(a, b, ["key"], "v").collect()}
    assert set(got) == {"same", "moved", "gone", "flat"}
    borders = [9.9 * i for i in range(1, 10)]
    want = psi_of([v for k, v in train if k == "moved"], [v for k, v in recent if k == "moved"], borders)
    assert got["moved"]["psi"] == pytest.approx(want) and got["moved"]["drifted"] and got["moved"]["ks"] == pytest.approx(0.6)
    assert got["same"]["psi"] == pytest.approx(0, abs=1e-9) and not got["same"]["drifted"] and got["same"]["ks"] == 0
    assert (got["gone"]["psi"], got["gone"]["drifted"], got["gone"]["ks"]) == (None, None, None)
    assert (got["flat"]["psi"], got["flat"]["ks"]) == (0.0, 0.0)


def test_decayed_event_features(spark):
    at = lambda h: datetime(2024, 1, 1, h)
    copies = spark.createDataFrame(
        [("a1", "E1", at(0), 4), ("a2", "E1", at(12), 1), ("a3", "E1", at(13), 9), ("a4", "E2", None, 1), ("a5", "lost", at(0), 1)],
        "article_id string, event_id string, published_time timestamp, news_target__tax_count bigint",
    )
    starts = spark.createDataFrame([("E1", at(12)), ("E2", at(12)), ("E3", at(1))], "event_id string, starts_at timestamp")
    got = rows_of(history.decayed_event_features(copies, starts, ["tax"], 12 * 3600), "event_id", "decayed_articles", "mean_weight", "max_weight", "decayed_news_target__tax_count")
    assert got == [("E1", 1.5, 0.75, 1.0, 3.0), ("E2", 0.0, None, None, 0.0), ("E3", 0.0, None, None, 0.0)]


def test_rolling_frequency(spark):
    rows = [(f"E{i}", date(2020, 1, 1 + i), "A", i % 2 == 0) for i in range(6)] + [("E0", date(2020, 1, 1), "B", None), ("X", None, "A", True)]
    segments = spark.createDataFrame(rows, "event_id string, event_date date, speaker string, target__t boolean")
    got = history.rolling_frequency(segments, ["target__t"], 4, block=2).orderBy("event_date").collect()
    assert [(r["was_said"], r["past_events"], r["past_rate"], r["trend"]) for r in got] == [
        (1, 0, None, None), (0, 1, 1.0, None), (1, 2, 0.5, None), (0, 3, pytest.approx(2 / 3), -0.5), (1, 4, 0.5, 0.0), (0, 4, 0.5, 0.0)
    ]
    assert got[4]["surprise"] == 0.5
    by = history.rolling_frequency(segments, ["target__t"], 4, by=["speaker"])
    assert rows_of(by.filter("speaker = 'B'"), "was_said", "past_events") == [(0, 0)]
    with pytest.raises(ValueError):
        history.rolling_frequency(segments, ["target__t"], 1)


def test_report_values(spark):
    df = spark.createDataFrame([(1.23456,)], "x double")
    assert ind.report_values(df, {"x": 2}).first()["x"] == 1.23
    assert df.select(F.round("x", 2)).first()[0] == 1.23
