"""Market references, prices, comparisons and candlesticks, all from tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from phrasecast.functions.numbers import (
    CANDLE_MINUTES, PRICE_FIELDS, first_price, price_error, price_probability, to_number,
)
from phrasecast.functions.text import strip

_OHLC = "struct<open:bigint,high:bigint,low:bigint,close:bigint,mean:bigint,previous:bigint>"
CANDLE_SCHEMA = (
    "struct<end_period_ts:bigint,volume:bigint,open_interest:bigint,"
    f"price:{_OHLC},yes_bid:{_OHLC},yes_ask:{_OHLC}>"
)


def market_reference(value: Column, series: Column | None = None) -> Column:
    """Struct ``(series_ticker, market_ticker, error)`` of a market URL or a bare ticker."""
    text = strip(value)
    is_url = text.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+")
    path = F.regexp_replace(F.regexp_extract(text, r"^[^:]+://[^/?#]*([^?#]*)", 1), ";[^/]*$", "")
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    good_url = (F.size(parts) >= 4) & (F.get(parts, 0) == "markets")
    given = F.lit("") if series is None else strip(F.coalesce(series, F.lit("")))
    own = F.when(given != "", given).when(F.contains(text, F.lit("-")), F.substring_index(text, "-", 1))
    error = (
        F.when(value.isNull() | (text == ""), "empty")
        .when(is_url & ~good_url, "bad_url")
        .when(~is_url & own.isNull(), "no_series")
    )
    return F.struct(
        F.when(error.isNull(), F.when(is_url, F.get(parts, 1)).otherwise(own)).alias("series_ticker"),
        F.when(error.isNull(), F.when(is_url, F.element_at(parts, -1)).otherwise(text)).alias("market_ticker"),
        error.alias("error"),
    )


def parse_references(df: DataFrame, value: str, series: str | None = None) -> DataFrame:
    """Add ``series_ticker``, ``market_ticker`` and ``error`` (NULL when both tickers are known)."""
    ref = market_reference(F.col(value), None if series is None else F.col(series))
    return df.withColumn("__ref", ref).select(*df.columns, "__ref.*")


def _priced(markets: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Step by step, so that every value is computed once."""
    out = markets.withColumn("price", first_price(fields))
    out = out.withColumn("price_value", to_number(F.col("price")))
    return out.withColumn("error", price_error(F.col("price"), F.col("price_value")))


def market_probabilities(
    markets: DataFrame, fields: Sequence[str] = PRICE_FIELDS, keep: Sequence[str] = ()
) -> DataFrame:
    """``(ticker, <keep>, market_probability)`` of the markets with a usable price, one row per row that has one."""
    good = _priced(markets, fields).filter(F.col("error").isNull())
    return good.select("ticker", *keep, price_probability(F.col("price_value")).alias("market_probability"))


def price_failures(markets: DataFrame, fields: Sequence[str] = PRICE_FIELDS) -> DataFrame:
    """The markets left out of ``market_probabilities`` and why."""
    return _priced(markets, fields).filter(F.col("error").isNotNull()).drop("price_value")


def compare_to_market(model: DataFrame, market: DataFrame) -> DataFrame:
    """``(ticker, model_probability)`` against market probabilities; edge = model - market."""
    joined = model.join(market, "ticker")
    return joined.select(
        "ticker",
        F.col("model_probability").cast("double").alias("model_probability"),
        "market_probability",
        (F.col("model_probability") - F.col("market_probability")).alias("edge"),
    )


def check_period(minutes: int) -> int:
    if minutes not in CANDLE_MINUTES:
        raise ValueError(f"candle period must be one of {CANDLE_MINUTES}, not {minutes}")
    return minutes


def candlesticks(trades: DataFrame, minutes: int) -> DataFrame:
    """OHLC, mean, volume and previous close per ticker and period.

    ``trades(ticker, created_time, yes_price, count, trade_id)``; trades at the same time are ordered by
    ``trade_id``. The aggregates combine on the map side, so a hot ticker shuffles one row per task and
    period. The window for ``previous`` sees candles, whose number the clock bounds, not trades.
    """
    seconds = check_period(minutes) * 60
    end = (F.floor(F.unix_timestamp("created_time") / seconds) * seconds + seconds).cast("bigint")
    at = F.struct("created_time", "trade_id")
    bars = (
        trades.withColumn("end_period_ts", end)
        .groupBy("ticker", "end_period_ts")
        .agg(
            F.min_by("yes_price", at).alias("open"),
            F.max("yes_price").alias("high"),
            F.min("yes_price").alias("low"),
            F.max_by("yes_price", at).alias("close"),
            F.avg("yes_price").alias("mean"),
            F.sum("count").alias("volume"),
        )
    )
    by_time = Window.partitionBy("ticker").orderBy("end_period_ts")
    return bars.withColumn("previous", F.lag("close").over(by_time))


def filter_candles(candles: DataFrame, start_ts: int, end_ts: int, minutes: int) -> DataFrame:
    """Candles whose period ends within [start, end], both inclusive."""
    check_period(minutes)
    return candles.filter(F.col("end_period_ts").between(int(start_ts), int(end_ts)))


def _entries(payloads: DataFrame, payload: str) -> DataFrame:
    listed = F.from_json(F.col(payload), "struct<candlesticks:array<string>>")["candlesticks"]
    others = [c for c in payloads.columns if c != payload]
    return payloads.select(*others, F.posexplode(listed).alias("position", "entry"))


def read_candles(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per candle of JSON payloads; a missing or blank list gives no rows."""
    rows = _entries(payloads, payload).filter(F.col("entry").startswith("{"))
    others = [c for c in rows.columns if c != "entry"]
    return rows.withColumn("c", F.from_json("entry", CANDLE_SCHEMA)).select(*others, "c.*")


def bad_candles(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """List entries that are no JSON object."""
    return _entries(payloads, payload).filter(
        F.col("entry").isNull() | ~F.col("entry").startswith("{")
    )


def candle_payloads(
    candles: DataFrame, start_ts: int, end_ts: int, minutes: int, part_size: int = 10000
) -> DataFrame:
    """Payload rows ``(series, market, window, period, part, candlesticks)``, candles in time order.

    A part spans ``part_size`` periods, so its list is bounded whatever the window; a window of that
    length or less gives one part per market.
    """
    step = check_period(minutes) * 60 * part_size
    kept = filter_candles(candles, start_ts, end_ts, minutes)
    bar = F.struct("end_period_ts", "open", "high", "low", "close", "mean", "previous", "volume")
    part = F.floor((F.col("end_period_ts") - int(start_ts)) / step).alias("part")
    return (
        kept.groupBy(F.substring_index("ticker", "-", 1).alias("series_ticker"), F.col("ticker").alias("market_ticker"), part)
        .agg(F.array_sort(F.collect_list(bar)).alias("candlesticks"))
        .select(
            "series_ticker",
            "market_ticker",
            F.lit(int(start_ts)).cast("bigint").alias("start_ts"),
            F.lit(int(end_ts)).cast("bigint").alias("end_ts"),
            F.lit(minutes).alias("period_minutes"),
            "part",
            "candlesticks",
        )
    )
