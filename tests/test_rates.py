import datetime as dt
import hashlib

import pytest

from phrasecast.operators import label, rates
from phrasecast.plans import edge

T = ["target__a", "target__b"]
ROWS = [
    ("E1", dt.date(2024, 1, 1), True, False), ("E1", dt.date(2024, 1, 1), True, False),
    ("E2", dt.date(2024, 1, 1), False, False), ("E3", dt.date(2024, 2, 1), False, True),
    ("E4", dt.date(2023, 1, 1), True, None),
]


@pytest.fixture
def segments(spark):
    return spark.createDataFrame(ROWS, "event_id string, event_date date, target__a boolean, target__b boolean").repartition(3)


def test_rates(segments):
    got = {r["target"]: r for r in rates.rate_intervals(segments, T).collect()}
    assert (got["a"]["k"], got["a"]["n"], got["a"]["prob"]) == (2, 4, 0.5)
    assert got["a"]["ci_lo"] < 0.5 < got["a"]["ci_hi"]
    assert [r["target"] for r in rates.base_rates(segments, T).collect()] == ["a", "b"]
    counts = {r["event_id"]: r["target__a"] for r in rates.event_counts(segments, T).collect()}
    assert counts == {"E1": 2, "E2": 0, "E3": 0, "E4": 1}
    assert [tuple(r) for r in rates.mean_hits(segments, T).collect()] == [("a", 0.75), ("b", 0.25)]
    assert rates.top_phrases(rates.rate_intervals(segments, T), 1).count() == 1


def test_series_and_matrix(segments):
    flags = rates.event_series(segments, "target__a").collect()
    assert [(r["event_id"], r["was_said"]) for r in flags] == [("E4", True), ("E1", True), ("E2", False), ("E3", False)]
    counts = rates.event_series(segments, "target__a", counts=True).collect()
    assert [r["hit_count"] for r in counts] == [1, 2, 0, 0]
    matrix = rates.hit_matrix(segments, T).collect()
    assert [tuple(r)[2:] for r in matrix] == [(1, None), (1, 0), (0, 0), (0, 1)]
    assert [r["event_id"] for r in rates.events_in_order(segments).collect()] == ["E4", "E1", "E2", "E3"]
    assert rates.hit_matrix(segments, T, counts=True).first()["target__a"] == 1


def test_cumulative_share(segments):
    got = [r for r in rates.cumulative_share(segments, T).collect() if r["target"] == "a"]
    order = sorted(
        {(r[1], hashlib.md5(r[0].encode()).hexdigest(), r[0], r[0] in ("E1", "E4")) for r in ROWS}
    )
    running = 0
    for i, (_, _, event, said) in enumerate(order, 1):
        running += said
        row = next(r for r in got if r["event_id"] == event)
        assert (row["event_index"], row["cum_share"]) == (i, running / i)
    undated = {r["event_id"]: r["cum_share"] for r in rates.cumulative_share_undated(segments, "target__a").collect()}
    assert undated == {"E1": 1.0, "E2": 0.5, "E3": pytest.approx(1 / 3), "E4": 0.5}


def test_event_probability(spark):
    df = spark.createDataFrame([("E1", 0.5), ("E1", 0.2), ("E2", 1.0), ("E2", 0.1), ("E3", 0.0)], "event_id string, probability double")
    got = {r["event_id"]: tuple(r)[1:] for r in rates.event_probability(df).collect()}
    assert got["E1"] == pytest.approx((0.6, 0.35, 0.5))
    assert got["E2"][0] == 1.0 and got["E3"][0] == 0.0


def test_long_form(segments):
    assert label.long_targets(segments, T, ["event_id"]).count() == 2 * len(ROWS)


def test_edge_report(spark, segments):
    markets = spark.createDataFrame(
        [("M-a", "a", "80", None, None, None), ("M-b", "b", "bad", None, None, None)],
        "ticker string, target string, last_price string, last_trade_price string, yes_bid string, yes_ask string",
    )
    rows = edge.phrase_edges(segments, T, markets).collect()
    assert len(rows) == 1 and rows[0]["phrase"] == "a"
    assert rows[0]["edge_prob_based"] == pytest.approx((0.5 - 0.8) / 0.2)


def test_edges_of_a_repeated_ticker_grow_with_its_rows(spark, segments):
    markets = spark.createDataFrame(
        [("M-a", "a", price, None, None, None) for price in ("80", "70", "60")],
        "ticker string, target string, last_price string, last_trade_price string, yes_bid string, yes_ask string",
    )
    assert edge.phrase_edges(segments, T, markets).count() == 3
