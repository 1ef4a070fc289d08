"""Cleaning, speaker filter and phrase labels on a stream of segment files.

These steps look at one row at a time, so they need no state and no watermark.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from phrasecast.operators.label import filter_speakers, label_segments


def read_segments(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def label_stream(
    segments: DataFrame,
    terms: Sequence[str],
    output: str,
    checkpoint: str,
    include: Iterable[str] | None = None,
    exclude: Iterable[str] | None = None,
) -> StreamingQuery:
    """Label what has arrived and stop; run it again for what comes later."""
    labelled = label_segments(filter_speakers(segments, include, exclude), terms)
    return (
        labelled.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(output)
    )
