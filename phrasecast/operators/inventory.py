"""Event inventory: projection, overrides, checks, summaries and the explorer filter."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from phrasecast.functions.numbers import event_date
from phrasecast.functions.text import speaker_list, strip

CORE_COLUMNS = ["event_id", "event_type", "event_date", "speakers", "source_url", "provenance"]
DATE_CANDIDATES = ["event_date", "date", "timestamp", "datetime"]


def project_inventory(raw: DataFrame) -> DataFrame:
    """Core columns first, every other column kept (except ``pdf_file``).

    ``event_date`` becomes a DATE and is NULL where no format fits (see ``bad_dates``);
    ``speakers`` becomes an array; a missing ``event_type`` column means ``unknown``.
    """

    def text(name: str) -> Column:
        return F.col(name).cast("string") if name in raw.columns else F.lit(None).cast("string")

    if "speakers" in raw.columns and raw.schema["speakers"].dataType.typeName() == "array":
        trimmed = F.transform(F.col("speakers"), lambda s: strip(s.cast("string")))
        speakers = F.filter(F.coalesce(trimmed, F.array().cast("array<string>")), lambda s: s != "")
    else:
        speakers = speaker_list(text("speakers"))
    event_type = text("event_type") if "event_type" in raw.columns else F.lit("unknown")
    extras = [c for c in raw.columns if c not in {*CORE_COLUMNS, "pdf_file"}]
    return raw.select(
        text("event_id").alias("event_id"),
        event_type.alias("event_type"),
        event_date(text("event_date")).alias("event_date"),
        speakers.alias("speakers"),
        text("source_url").alias("source_url"),
        text("provenance").alias("provenance"),
        *extras,
    )


def inventory_rows(inventory: DataFrame) -> DataFrame:
    """The flat text form: ISO dates and speakers joined by ``, ``."""
    return inventory.withColumns(
        {
            "event_date": F.date_format("event_date", "yyyy-MM-dd"),
            "speakers": F.array_join("speakers", ", "),
        }
    )


def bad_dates(raw: DataFrame) -> DataFrame:
    """Quarantine: inventory rows whose ``event_date`` has no known format."""
    return raw.filter(event_date(F.col("event_date")).isNull())


def apply_overrides(raw: DataFrame, overrides: DataFrame) -> DataFrame:
    """Override values win per event and column; a NULL override leaves the value alone.

    Both tables hold one row per event, so no key is hot and the join needs no salt.
    """
    shared = [c for c in overrides.columns if c != "event_id" and c in raw.columns]
    added = [c for c in overrides.columns if c != "event_id" and c not in raw.columns]
    right = overrides.select("event_id", *[F.col(c).alias(f"__o_{c}") for c in shared], *added)
    joined = raw.join(right, "event_id", "left")
    return joined.select(
        *[F.coalesce(F.col(f"__o_{c}"), F.col(c)).alias(c) if c in shared else F.col(c) for c in raw.columns],
        *added,
    )


def duplicate_ids(inventory: DataFrame) -> DataFrame:
    """Event ids that occur more than once, with their count."""
    return inventory.groupBy("event_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def require_unique_ids(inventory: DataFrame) -> DataFrame:
    """Return ``inventory`` or fail with a few of its duplicate ids."""
    sample = [r["event_id"] for r in duplicate_ids(inventory).orderBy("event_id").limit(5).collect()]
    if sample:
        raise ValueError(f"duplicate event_id in the inventory: {', '.join(map(str, sample))}")
    return inventory


def events_without_document(inventory: DataFrame, documents: DataFrame) -> DataFrame:
    """Inventory rows whose ``event_id`` has no row in ``documents``."""
    return inventory.join(documents.select("event_id").distinct(), "event_id", "left_anti")


def date_column(columns: Sequence[str]) -> str | None:
    """The column to read as the event date, by preferred name, ignoring case."""
    lowered = {c.lower(): c for c in columns}
    return next((lowered[c] for c in DATE_CANDIDATES if c in lowered), None)


def with_event_day(df: DataFrame, name: str = "event_day") -> DataFrame:
    """Add the chosen date column as a DATE; values that do not parse are NULL."""
    chosen = date_column(df.columns)
    if chosen is None:
        return df.withColumn(name, F.lit(None).cast("date"))
    if df.schema[chosen].dataType.typeName() in ("date", "timestamp", "timestamp_ntz"):
        return df.withColumn(name, F.col(chosen).cast("date"))
    text = F.col(chosen).cast("string")
    return df.withColumn(name, F.coalesce(event_date(text), F.to_date(F.try_to_timestamp(text))))


def inventory_summary(inventory: DataFrame) -> DataFrame:
    """One row: number of events, first and last day, number of event types."""
    types = F.countDistinct("event_type") if "event_type" in inventory.columns else F.lit(0)
    return with_event_day(inventory).agg(
        F.count(F.lit(1)).alias("events"),
        F.min("event_day").alias("date_min"),
        F.max("event_day").alias("date_max"),
        types.cast("bigint").alias("event_types"),
    )


def event_types(inventory: DataFrame) -> DataFrame:
    """Sorted distinct event types."""
    kept = inventory.filter(F.col("event_type").isNotNull())
    return kept.select(F.col("event_type").cast("string").alias("event_type")).distinct().orderBy("event_type")


def filter_events(
    inventory: DataFrame,
    types: Sequence[str] | None = None,
    start: date | str | None = None,
    end: date | str | None = None,
) -> DataFrame:
    """Event types in a set, day within [start, end]; rows without a day are dropped."""
    chosen = date_column(inventory.columns)
    out = with_event_day(inventory)
    if chosen is not None:
        out = out.filter(F.col("event_day").isNotNull())
        if start:
            out = out.filter(F.col("event_day") >= F.lit(str(start)).cast("date"))
        if end:
            out = out.filter(F.col("event_day") <= F.lit(str(end)).cast("date"))
    if types:
        out = out.filter(F.col("event_type").isin(list(types)))
    return out.drop("event_day")


def events_over_time(inventory: DataFrame) -> DataFrame:
    """Events per day, in date order."""
    days = with_event_day(inventory).filter(F.col("event_day").isNotNull())
    return days.groupBy("event_day").agg(F.count(F.lit(1)).alias("count")).orderBy("event_day")
