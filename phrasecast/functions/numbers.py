"""Scalar statistics, prices, dates and times as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from phrasecast.functions.text import SPACE, strip

# Price fields of a market in order of preference, and the allowed candle periods.
PRICE_FIELDS = ["last_price", "last_trade_price", "yes_bid", "yes_ask"]
CANDLE_MINUTES = [1, 60, 1440]

_NUMBER = rf"(?i)^{SPACE}*[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?|inf|infinity|nan){SPACE}*$"
_ISO_TIME = (
    r"^\d{4}-\d{2}-\d{2}"
    r"(?:[T ]\d{2}(?::\d{2}(?::\d{2}(?:\.\d{1,6})?)?)?(?:Z|[+-]\d{2}(?::?\d{2})?)?)?$"
)


def wilson_low(k: Column, n: Column, z: float = 1.96) -> Column:
    return F.when(n == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), _wilson(k, n, z, -1)))


def wilson_high(k: Column, n: Column, z: float = 1.96) -> Column:
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), _wilson(k, n, z, 1)))


def _wilson(k: Column, n: Column, z: float, sign: int) -> Column:
    size = F.when(n != 0, n.cast("double"))
    share = k / size
    middle = share + z * z / (2 * size)
    half = z * F.sqrt((share * (1 - share) + z * z / (4 * size)) / size)
    return (middle + sign * half) / (1 + z * z / size)


def implied_probability(decimal_odds: Column) -> Column:
    """``1 / odds``; NULL for zero odds."""
    return F.lit(1.0) / F.when(decimal_odds != 0, decimal_odds)


def kelly_edge(mine: Column, market: Column) -> Column:
    """``(mine - market) / (1 - market)``; NULL when the market is certain."""
    return (mine - market) / F.when(market != 1, 1 - market)


def to_number(text: Column) -> Column:
    """DOUBLE of a plain decimal, infinity or NaN spelling, else NULL."""
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def first_price(fields: Sequence[str] = PRICE_FIELDS) -> Column:
    """The first price field that is neither NULL nor empty, as text."""
    return F.coalesce(*[F.nullif(F.col(f).cast("string"), F.lit("")) for f in fields])


def price_error(price: Column, value: Column) -> Column:
    """Why a price gives no probability, or NULL when it does; ``value`` is its number."""
    return (
        F.when(price.isNull(), "no_price")
        .when(value.isNull(), "not_numeric")
        .when(value < 0, "negative")
        .when((value > 100) & ~F.isnan(value), "above_one")
    )


def price_probability(value: Column) -> Column:
    """Fractions stay, cents are divided by 100."""
    return F.when((value > 1) & ~F.isnan(value), value / 100).otherwise(value)


def event_date(text: Column) -> Column:
    """``2024-01-31``, ``01/31/2024`` or ``20240131`` as DATE, else NULL."""
    t = text.cast("string")
    return F.coalesce(
        F.when(t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.to_date(F.try_to_timestamp(t, F.lit("yyyy-M-d")))),
        F.when(t.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.to_date(F.try_to_timestamp(t, F.lit("M/d/yyyy")))),
        F.when(t.rlike(r"^\d{8}$"), F.to_date(F.try_to_timestamp(t, F.lit("yyyyMMdd")))),
    )


def iso_timestamp(text: Column) -> Column:
    """ISO-8601 text as TIMESTAMP (no offset means UTC), else NULL."""
    t = strip(text.cast("string"))
    return F.when(t.rlike(_ISO_TIME), F.try_to_timestamp(t))


def unix_seconds(text: Column) -> Column:
    """Unix seconds of an integer, a decimal (cut off) or ISO-8601 text, else NULL."""
    t = strip(text.cast("string"))
    number = to_number(t)
    whole = F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast("bigint"))
    finite = ~F.isnan(number) & (F.abs(number) < F.lit(9.2e18))
    return F.coalesce(whole, F.when(finite, number.cast("bigint")), F.unix_timestamp(iso_timestamp(F.upper(t))))


def publication_time(text: Column) -> Column:
    """Publication time: Unix seconds when numeric, else ISO-8601; NULL when neither."""
    t = strip(text.cast("string"))
    number = to_number(t)
    numeric = F.when(~F.isnan(number) & (F.abs(number) < F.lit(1e11)), F.timestamp_micros((number * 1e6).cast("bigint")))
    return F.coalesce(numeric, iso_timestamp(t))


def clean_metric(value: Column) -> Column:
    """A stored metric as DOUBLE; text that is no number and NaN become NULL."""
    number = to_number(value.cast("string"))
    return F.when(~F.isnan(number), number)


def format_percent(value: Column) -> Column:
    return F.when(value.isNotNull(), F.format_string("%.1f%%", F.bround(value * 100, 1))).otherwise("—")


def format_score(value: Column) -> Column:
    return F.when(value.isNotNull(), F.format_string("%.3f", F.bround(value, 3))).otherwise("—")
