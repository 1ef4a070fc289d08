"""Label segments with tracked phrases, attach the inventory, check the result."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, functions as F

from phrasecast.functions.phrases import speaker_allowed, vocabulary
from phrasecast.functions.scan import skew_join
from phrasecast.functions.text import is_blank
from phrasecast.operators.inventory import CORE_COLUMNS

SEGMENT_COLUMNS = [
    "event_id", "segment_id", "event_type", "event_date", "speaker", "text", "start_char", "end_char",
    "source_url", "provenance",
]
OWN_COLUMNS = ["event_id", "segment_id", "speaker", "text", "start_char", "end_char"]


def label_segments(segments: DataFrame, terms: Iterable[str], prefilter: bool = True) -> DataFrame:
    """One BOOLEAN column per term; the patterns are literals, so each is compiled once per task."""
    phrases = vocabulary(terms)
    return segments.withColumns({p.column: p.hit(F.col("text"), prefilter) for p in phrases})


def target_columns(terms: Iterable[str]) -> list[str]:
    return [p.column for p in vocabulary(terms)]


def target_map(terms: Iterable[str]) -> dict[str, str]:
    """Phrase -> column, as published in the manifest."""
    return {p.term: p.column for p in vocabulary(terms)}


def filter_speakers(
    segments: DataFrame, include: Iterable[str] | None = None, exclude: Iterable[str] | None = None
) -> DataFrame:
    return segments.filter(speaker_allowed(F.col("speaker"), include, exclude))


def attach_inventory(segments: DataFrame, inventory: DataFrame) -> DataFrame:
    """Segments with the inventory columns of their event, core columns first, extras after.

    One event may own most segments, so the join spreads hot events.
    """
    extras = [c for c in inventory.columns if c not in CORE_COLUMNS]
    clash = sorted(set(extras) & set(SEGMENT_COLUMNS))
    if clash:
        raise ValueError(f"inventory columns clash with segment columns: {clash}")
    wanted = ["event_id", "event_type", "event_date", "source_url", "provenance", *extras]
    joined = skew_join(segments.select(*OWN_COLUMNS), inventory.select(*wanted), "event_id", spread=["segment_id"])
    return joined.select(*SEGMENT_COLUMNS, *extras)


def build_rows(
    segments: DataFrame,
    inventory: DataFrame,
    terms: Sequence[str],
    include: Iterable[str] | None = None,
    exclude: Iterable[str] | None = None,
    prefilter: bool = True,
) -> DataFrame:
    """The labelled segment table: speaker filter, inventory columns, one column per phrase."""
    kept = filter_speakers(segments, include, exclude)
    return label_segments(attach_inventory(kept, inventory), terms, prefilter)


def validate_segments(rows: DataFrame) -> DataFrame:
    """One row: ``checks`` (map) and ``notes`` (array). ``non_empty`` appears only when it fails."""
    totals = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("segment_id").alias("ids"),
        F.count("segment_id").alias("named"),
        F.max(F.when(F.col("segment_id").isNull(), 1).otherwise(0)).alias("unnamed"),
        F.count_if(is_blank(F.col("text"))).alias("blank"),
    )
    distinct = F.col("ids") + F.coalesce(F.col("unnamed"), F.lit(0))
    return totals.select(
        F.when(F.col("n") == 0, F.create_map(F.lit("non_empty"), F.lit(False)))
        .otherwise(
            F.create_map(
                F.lit("unique_segment_ids"), distinct == F.col("n"), F.lit("non_empty_text"), F.col("blank") == 0
            )
        )
        .alias("checks"),
        F.when(F.col("n") == 0, F.array(F.lit("No rows produced from segmentation")))
        .otherwise(F.array().cast("array<string>"))
        .alias("notes"),
    )


def long_targets(df: DataFrame, targets: Sequence[str], ids: Sequence[str], value: str = "hit") -> DataFrame:
    """Wide phrase columns to rows ``(ids, target, value)``."""
    return df.unpivot(list(ids), list(targets), "target", value)


def target_table(spark, terms: Iterable[str]) -> DataFrame:
    """The vocabulary as a table: term, column, pattern, first words of its alternatives."""
    rows = [(p.term, p.column, p.pattern, list(p.first_words)) for p in vocabulary(terms)]
    return spark.createDataFrame(rows, "term string, column string, pattern string, first_words array<string>")

