"""Live features of a stream of files: repeats, late rows, a restart."""

from datetime import datetime, timedelta

import pytest

from phrasecast.streaming import live
from phrasecast.streaming.labels import read_segments

SCHEMA = "event_id string, segment_id string, spoken_at timestamp, text string"
START = datetime(2024, 1, 1, 12)


def at(minutes):
    return START + timedelta(minutes=minutes)


@pytest.fixture
def places(spark, tmp_path):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield tmp_path
    spark.conf.set("spark.sql.shuffle.partitions", before)


def arrive(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))


def run(spark, tmp_path):
    stream = read_segments(spark, str(tmp_path / "in"), SCHEMA, files_per_trigger=1)
    query = live.write_live(live.live_features(stream, ["tax", "rate"], "10 minutes", "5 minutes"), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    dropped = sum(int(op.numRowsDroppedByWatermark) for p in query.recentProgress for op in p.stateOperators)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    return sorted((r["event_id"], (r["window_start"] - START).seconds // 60, r["segments"], r["target__tax"], r["target__rate"]) for r in rows), dropped


def test_stream_with_repeats_late_rows_and_restart(spark, places):
    arrive(spark, places, [("E", "s1", at(1), "the tax"), ("E", "s2", at(2), "no"), ("E", "s2", at(2), "no"), ("F", "s3", at(3), "tax rates"), ("E", "s0", None, "tax")])
    assert run(spark, places) == ([], 0)  # no window has ended before the watermark, 11:58
    # A copy of s1 within the watermark, and a row that is late, but not too late.
    arrive(spark, places, [("E", "s1", at(4), "the tax"), ("E", "s4", at(0), "rate"), ("E", "s5", at(16), "tax")])
    closed = [("E", 0, 3, 1, 1), ("F", 0, 1, 1, 1)]
    assert run(spark, places) == (closed, 0)  # the watermark is 12:11
    # After a restart: too late for its window; the copy of s5 still counts as one.
    arrive(spark, places, [("E", "s6", at(5), "tax"), ("E", "s5", at(17), "tax"), ("E", "s7", at(40), "end")])
    got, dropped = run(spark, places)
    assert got == [*closed[:1], ("E", 10, 1, 1, 0), closed[1]] and dropped == 1
    assert run(spark, places)[0] == got  # nothing new


def test_table_gives_every_window(spark):
    df = spark.createDataFrame([("E", "s1", at(1), "tax"), ("E", "s1", at(1), "tax"), ("E", "s2", at(12), None), ("F", "s3", None, "tax")], SCHEMA)
    got = live.live_features(df, ["tax"])
    assert sorted((r["event_id"], r["segments"], r["target__tax"]) for r in got.collect()) == [("E", 1, 0), ("E", 1, 1)]
    shares = live.live_shares(got, ["target__tax"]).collect()
    assert [(r["target"], r["hits"], r["share"]) for r in shares] == [("target__tax", 1, 0.5)]
    assert [(r["target"], r["share"]) for r in live.alerts(got, ["target__tax"], 0.9).collect()] == [("target__tax", 1.0)]
    assert live.late_segments(df, "2024-01-01 12:05:00").count() == 2
