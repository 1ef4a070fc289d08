"""Phrase features of an event while it runs: repeated segments leave, windows of time are counted, late rows are bounded.

State is what the watermark leaves open: the segment ids of the last ``delay`` and the windows that have not ended before
it. A segment that comes later than ``delay`` behind the newest one is dropped; ``late_segments`` finds such rows in a table.
The checkpoint folder carries state and progress over a restart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from phrasecast.functions.phrases import vocabulary

ID, TIME = "segment_id", "spoken_at"


def live_features(segments: DataFrame, terms: Sequence[str], window: str = "10 minutes", delay: str = "5 minutes") -> DataFrame:
    """``(event_id, window_start, window_end, segments, <target> ...)``: segments and hits per event and window of time.

    ``segments`` (a stream or a table) has event_id, segment_id, spoken_at and text. The first copy of a segment id within
    the watermark counts; rows without a time are left out. On a table every window is given, on a stream in append mode those
    that ended before the watermark.
    """
    kept = segments.filter(F.col(TIME).isNotNull()).select("event_id", ID, TIME, "text")
    if segments.isStreaming:
        kept = kept.withWatermark(TIME, delay).dropDuplicatesWithinWatermark([ID])
    else:
        kept = kept.dropDuplicates([ID])
    phrases = vocabulary(terms)
    hits = kept.select("event_id", TIME, *[p.hit(F.col("text")).cast("bigint").alias(p.column) for p in phrases])
    counted = hits.groupBy(F.window(TIME, window).alias("w"), "event_id").agg(
        F.count(F.lit(1)).alias("segments"), *[F.coalesce(F.sum(p.column), F.lit(0)).alias(p.column) for p in phrases]
    )
    return counted.select(
        "event_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "segments", *[p.column for p in phrases]
    )


def write_live(features: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    """Append the windows that have closed; stops when all that has arrived is read, and goes on from there when run again."""
    return (
        features.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(output)
    )


def live_shares(windows: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Per event and phrase: share of segments with a hit over the closed windows, the live estimate of an event's base rate."""
    sums = windows.groupBy("event_id").agg(F.sum("segments").alias("segments"), *[F.sum(t).alias(t) for t in targets])
    long = sums.unpivot(["event_id", "segments"], list(targets), "target", "hits")
    return long.withColumn("share", F.col("hits") / F.col("segments"))


def alerts(windows: DataFrame, targets: Sequence[str], threshold: float) -> DataFrame:
    """``(event_id, target, window_start, share)`` of windows in which at least ``threshold`` of the segments hold a phrase; also on a stream."""
    pairs = F.explode(F.array(*[F.struct(F.lit(t).alias("target"), (F.col(t) / F.col("segments")).alias("share")) for t in targets]))
    return windows.select("event_id", "window_start", pairs.alias("p")).select("event_id", "p.target", "window_start", "p.share").filter(
        F.col("share") >= threshold
    )


def late_segments(segments: DataFrame, watermark: str) -> DataFrame:
    """Rows of a table that a stream with this watermark (a timestamp) drops."""
    return segments.filter(F.col(TIME) < F.lit(watermark).cast("timestamp"))
