"""End-to-end flows, streaming and the shape of plans."""

import pytest
from pyspark.sql import functions as F

from phrasecast.operators import label, news, rates, segment
from phrasecast.plans import transcripts
from phrasecast.session import materialize, shared_folder
from phrasecast.streaming import labels as stream


def test_publish_flow(spark, tmp_path):
    pages = spark.createDataFrame(
        [("E1", 0, "Page 1\nDr. Vantorp: taxes rise"), ("E1", 1, "and policies\nReporter: why?"), ("E2", 0, "none"), ("E3", 0, "x")],
        "event_id string, page_no int, text string",
    )
    inventory = spark.createDataFrame(
        [("E1", "press", "2024-01-31"), ("E2", "call", "2024-02-01")], "event_id string, event_type string, event_date string"
    )
    out = transcripts.publish(pages, inventory, ["tax", "policy"], str(tmp_path), "v1", "now")
    rows = {r["segment_id"]: r for r in out.rows.collect()}
    assert set(rows) == {"E1_S0001", "E1_S0002", "E2_W0001"}
    first = rows["E1_S0001"]
    assert first["text"] == "taxes rise\n\nand policies" and first["speaker"] == "DR VANTORP"
    assert (first["target__tax"], first["target__policy"]) == (True, False)
    duplicated = inventory.union(inventory)
    with pytest.raises(ValueError):
        transcripts.publish(pages, duplicated, ["tax"], str(tmp_path), "v2", "now")


def test_label_stream(spark, tmp_path):
    schema = "event_id string, speaker string, text string"
    batch = spark.createDataFrame([("E1", "CHAIR", "tax"), ("E2", "OTHER", "tax")], schema)
    batch.write.parquet(str(tmp_path / "in"))
    source = stream.read_segments(spark, str(tmp_path / "in"), schema)
    query = stream.label_stream(source, ["tax"], str(tmp_path / "out"), str(tmp_path / "ck"), include=["chair"])
    query.awaitTermination(120)
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("event_id", "target__tax").collect()] == [("E1", True)]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def segments(spark):
    df = spark.range(1000).select(
        F.concat(F.lit("E"), (F.col("id") % 30).cast("string")).alias("event_id"),
        F.col("id").cast("string").alias("segment_id"),
        F.lit("tax and growth").alias("text"), F.lit("CHAIR").alias("speaker"),
        F.lit("2024-01-01").cast("date").alias("event_date"), F.lit("wide").alias("unused"),
    )
    return materialize(df, "plan-segments")


def test_plans_stay_in_the_jvm_and_read_few_columns(segments):
    flagged = rates.rate_intervals(label.label_segments(segments, ["tax", "growth"]), ["target__tax", "target__growth"])
    plan = plan_of(flagged)
    assert "Python" not in plan and "ReadSchema: struct<event_id:string,text:string>" in plan
    assert plan.count("hashpartitioning(event_id") == 1


def test_filters_reach_the_scan(segments):
    plan = plan_of(segments.filter("event_id = 'E1'").select("text"))
    assert "PushedFilters: [IsNotNull(event_id), EqualTo(event_id,E1)]" in plan


def test_deduplication_combines_before_the_shuffle(spark):
    schema = "article_id string, event_id string, source string, published_at string, headline string, url string, body_text string, file string, split_start bigint, line_no bigint"
    plan = plan_of(news.first_copies(news.measure_articles(spark.createDataFrame([], schema), ["tax"])))
    assert "partial_min_by" in plan and "body_text" not in plan.split("Exchange")[0]


def test_cleaning_has_no_shuffle(spark):
    pages = spark.createDataFrame([("E", 0, "x")], "event_id string, page_no int, text string")
    plan = plan_of(segment.clean_pages(pages))
    assert "Exchange" not in plan and "Python" not in plan


def test_shared_folder_comes_from_the_session(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
