import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from phrasecast.functions import numbers as nb
from phrasecast.operators import market


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "text,expected",
    [
        ("2024-01-31", dt.date(2024, 1, 31)),
        ("01/31/2024", dt.date(2024, 1, 31)),
        ("1/5/2024", dt.date(2024, 1, 5)),
        ("20240131", dt.date(2024, 1, 31)),
        ("2024-02-30", None),
        ("31/01/2024", None),
        ("soon", None),
        (None, None),
    ],
)
def test_event_date(spark, text, expected):
    assert one(spark, text, nb.event_date) == expected


@pytest.mark.parametrize(
    "text,expected",
    [
        ("1614816000", 1614816000), ("1614816000.0", 1614816000), ("1614816000.9", 1614816000),
        (" 1614816000 ", 1614816000), ("-5.9", -5), ("2021-03-04T00:00:00Z", 1614816000),
        ("2021-03-04t00:00:00z", 1614816000), ("2021-03-04", 1614816000), ("2021-03-04 02:00:00+02:00", 1614816000),
        ("not-a-timestamp", None), ("", None), ("nan", None), ("2020-10", None),
    ],
)
def test_unix_seconds(spark, text, expected):
    assert one(spark, text, nb.unix_seconds) == expected


@pytest.mark.parametrize(
    "text,expected",
    [("2024-03-15T12:00:00Z", 1710504000), ("1710504000", 1710504000), ("1710504000.5", 1710504000), ("soon", None), (None, None)],
)
def test_publication_time(spark, text, expected):
    assert one(spark, text, lambda c: F.unix_timestamp(nb.publication_time(c))) == expected


def wilson(k, n, z=1.96):
    if n == 0:
        return 0.0, 1.0
    p = k / n
    mid, half = p + z * z / (2 * n), z * math.sqrt((p * (1 - p) + z * z / (4 * n)) / n)
    return max(0, (mid - half) / (1 + z * z / n)), min(1, (mid + half) / (1 + z * z / n))


@pytest.mark.parametrize("k,n", [(0, 0), (0, 18), (18, 18), (7, 31), (1, 1)])
def test_wilson(spark, k, n):
    df = spark.createDataFrame([(k, n)], "k bigint, n bigint")
    got = df.select(nb.wilson_low(F.col("k"), F.col("n")), nb.wilson_high(F.col("k"), F.col("n"))).first()
    assert tuple(got) == pytest.approx(wilson(k, n), abs=1e-12)


def test_odds_and_kelly(spark):
    df = spark.createDataFrame([(1.8, 0.9, 0.8), (0.0, 0.5, 1.0)], "o double, p double, m double")
    got = df.select(nb.implied_probability(F.col("o")), nb.kelly_edge(F.col("p"), F.col("m"))).collect()
    assert got[0][0] == pytest.approx(1 / 1.8) and got[0][1] == pytest.approx(0.5)
    assert tuple(got[1]) == (None, None)


PRICES = [
    ("BUOY-1", "42", None, None, None, 0.42, None),
    ("BUOY-2", None, "0.63", None, None, 0.63, None),
    ("BUOY-3", None, None, None, None, None, "no_price"),
    ("BUOY-4", "", None, "55", "99", 0.55, None),
    ("BUOY-5", "abc", None, None, "55", None, "not_numeric"),
    ("BUOY-6", "-1", None, None, None, None, "negative"),
    ("BUOY-7", "101", None, None, None, None, "above_one"),
    ("BUOY-8", "1", None, None, None, 1.0, None),
    ("BUOY-9", " 1e2 ", None, None, None, 1.0, None),
    ("BUOY-10", "5f", None, None, None, None, "not_numeric"),
]


def test_prices(spark):
    df = spark.createDataFrame(
        [p[:5] for p in PRICES],
        "ticker string, last_price string, last_trade_price string, yes_bid string, yes_ask string",
    )
    good = {r[0]: r[1] for r in market.market_probabilities(df).collect()}
    bad = {r["ticker"]: r["error"] for r in market.price_failures(df).collect()}
    assert good == pytest.approx({p[0]: p[5] for p in PRICES if p[5] is not None})
    assert bad == {p[0]: p[6] for p in PRICES if p[6]}
    model = spark.createDataFrame([("BUOY-4", 0.62), ("BUOY-3", 0.5)], "ticker string, model_probability double")
    edges = market.compare_to_market(model, market.market_probabilities(df)).collect()
    assert len(edges) == 1 and edges[0]["edge"] == pytest.approx(0.07)


REFERENCES = [
    ("https://m.example.com/markets/game/sunday-night/game-25oct20", None, "game", "game-25oct20", None),
    ("https://m.example.com/markets/game/game-25oct20", None, None, None, "bad_url"),
    ("https://m.example.com/other/a/b/c", None, None, None, "bad_url"),
    ("https://m.example.com/markets/a/b/c;x=1?q#f", None, "a", "c", None),
    ("speech-2023", None, "speech", "speech-2023", None),
    ("speech-2023", " other ", "other", "speech-2023", None),
    ("LONETICKER", None, None, None, "no_series"),
    ("  ", None, None, None, "empty"),
]


def test_references(spark):
    df = spark.createDataFrame([(i, r[0], r[1]) for i, r in enumerate(REFERENCES)], "i int, value string, series string")
    got = market.parse_references(df, "value", "series").orderBy("i").collect()
    assert [(r["series_ticker"], r["market_ticker"], r["error"]) for r in got] == [r[2:] for r in REFERENCES]


def test_periods_and_candle_filter(spark):
    candles = spark.createDataFrame([(100, 5), (200, 7), (300, 9)], "end_period_ts bigint, volume bigint")
    assert market.filter_candles(candles, 100, 200, 60).count() == 2
    for period in (30, 5):
        with pytest.raises(ValueError):
            market.check_period(period)


def test_candle_documents(spark):
    rows = [
        (1, '{"candlesticks": [{"end_period_ts": 100, "volume": 5, "price": {"close": 4}}, 7, null]}'),
        (2, '{"candlesticks": null}'),
        (3, '{"candlesticks": ""}'),
        (4, "{}"),
    ]
    df = spark.createDataFrame(rows, "id int, payload string")
    good = market.read_candles(df).collect()
    assert [(r["id"], r["end_period_ts"], r["volume"], r["price"]["close"]) for r in good] == [(1, 100, 5, 4)]
    assert {(r["id"], r["position"]) for r in market.bad_candles(df).collect()} == {(1, 1), (1, 2)}


def test_candles_and_payload_parts(spark):
    base = 1_700_000_000 // 3600 * 3600
    trades = [("M-1", base + s, price, 1, s) for s, price in ((0, 10), (5, 30), (5, 20), (3599, 15), (3600, 50), (9000, 5))]
    trades = [(t, at, p, c, i) for i, (t, at, p, c, _) in enumerate(trades)]
    df = spark.createDataFrame(trades, "ticker string, s bigint, yes_price bigint, count bigint, trade_id bigint")
    df = df.withColumn("created_time", F.timestamp_seconds("s")).drop("s")
    bars = market.candlesticks(df, 60).orderBy("end_period_ts").collect()
    assert [(b["open"], b["high"], b["low"], b["close"], b["previous"], b["volume"]) for b in bars] == [
        (10, 30, 10, 15, None, 4), (50, 50, 50, 50, 15, 1), (5, 5, 5, 5, 50, 1),
    ]
    whole = market.candle_payloads(market.candlesticks(df, 60), base, base + 36000, 60).collect()
    assert len(whole) == 1 and [c["close"] for c in whole[0]["candlesticks"]] == [15, 50, 5]
    parts = market.candle_payloads(market.candlesticks(df, 60), base, base + 36000, 60, part_size=2)
    assert sorted((p["part"], len(p["candlesticks"])) for p in parts.collect()) == [(0, 1), (1, 2)]


def test_metric_cleaning_and_format(spark):
    df = spark.createDataFrame([("0.9876",), ("NaN",), ("x",), (None,), ("0.8125",)], "v string")
    metric = nb.clean_metric(F.col("v"))
    got = df.select(nb.format_percent(metric), nb.format_score(metric)).collect()
    assert [tuple(r) for r in got] == [("98.8%", "0.988"), ("—", "—"), ("—", "—"), ("—", "—"), ("81.2%", "0.812")]
