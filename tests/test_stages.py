"""Feature blocks as pipeline stages, the ingest flow and what an experiment writes."""

import json

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from phrasecast.operators import features as fx, news
from phrasecast.operators.stages import CategoryBlock, NumberBlock, TextBlock, TextBlockModel
from phrasecast.plans import experiment as ex, newsflow
from phrasecast.sources import articles as dumps, tables

WORDS = ["tariff", "calm", "growth", "water", "harbour"]


@pytest.fixture(scope="module")
def rows(spark):
    data = []
    for i in range(60):
        words = [WORDS[(i * k) % 5] for k in range(1, 6)]
        data.append((f"s{i:02d}", f"E{i // 10}", " ".join(words), ["A", "B", None][i % 3], float(i) if i % 4 else None, int("tariff" in words[:2])))
    return spark.createDataFrame(data, "segment_id string, event_id string, text string, speaker string, size double, label int").repartition(3)


def arrays(df, column="features"):
    return {r["segment_id"]: r[column].toArray() for r in df.select("segment_id", column).collect()}


def test_same_vectors_as_the_functions(rows):
    keyed = rows.withColumnRenamed("segment_id", "row_id")
    counts = fx.term_counts(keyed, "row_id", "text")
    vocabulary = fx.fit_tfidf(counts, F.lit(60))
    index = fx.feature_index(fx.text_names(vocabulary))
    want = fx.feature_vectors(keyed.select("row_id"), fx.tfidf(counts, vocabulary), index, index.count())
    want = {r["row_id"]: r["features"].toArray() for r in want.collect()}
    model = TextBlock(inputCols=["text"]).fit(rows)
    got = arrays(model.transform(rows))
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    assert model.names() == [r["feature"] for r in index.orderBy("index").collect()]


def test_pipeline_is_saved_and_loaded(spark, rows, tmp_path):
    stages = [
        TextBlock(inputCols=["text"], outputCol="t", high=1, maxFeatures=4), CategoryBlock(inputCols=["speaker"], outputCol="c", drop="first"),
        NumberBlock(inputCols=["size"], outputCol="n"), VectorAssembler(inputCols=["t", "c", "n"], outputCol="features"), LogisticRegression(maxIter=20),
    ]
    pipeline = Pipeline(stages=stages)
    pipeline.write().save(str(tmp_path / "unfitted"))
    assert [type(s).__name__ for s in Pipeline.load(str(tmp_path / "unfitted")).getStages()][:3] == ["TextBlock", "CategoryBlock", "NumberBlock"]
    model = pipeline.fit(rows)
    model.write().save(str(tmp_path / "fitted"))
    again = PipelineModel.load(str(tmp_path / "fitted"))
    new = spark.createDataFrame([("x", "E", "tariff tariff unknown", "C", None, 0), ("y", "E", None, None, 4.0, 0)], rows.schema)
    for table in (rows, new):
        a, b = arrays(model.transform(table), "probability"), arrays(again.transform(table), "probability")
        assert a.keys() == b.keys() and all(np.allclose(a[k], b[k]) for k in a)
    assert isinstance(again.stages[0], TextBlockModel) and again.stages[0].getOrDefault("maxFeatures") == 4
    filled = arrays(again.stages[2].transform(new), "n")
    median = float(np.median([i for i in range(60) if i % 4]))
    assert filled["x"].tolist() == [median] and filled["y"].tolist() == [4.0]
    assert set(model.transform(rows).columns) == {*rows.columns, "t", "c", "n", "features", "rawPrediction", "probability", "prediction"}


def test_blocks_refuse_what_they_cannot_do(rows):
    with pytest.raises(ValueError, match="no features"):
        TextBlock(inputCols=["text"], minDf=1000).fit(rows)
    model = NumberBlock(inputCols=["size"], outputCol="n").fit(rows)
    with pytest.raises(ValueError, match="rename"):
        model.transform(rows.withColumn("features", F.lit(1)))


def article(i, **more):
    return {"article_id": f"a{i}", "event_id": "E", "source": "S", "published_at": f"2024-01-0{i}T00:00:00Z", "headline": "h", "url": "u", "body_text": "b", **more}


@pytest.fixture
def sources(tmp_path):
    for name, items in (("one", [article(1), article(2), article(3, headline="")]), ("two", [article(1)]), ("late", [article(9)])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.jsonl").write_text("\n".join(map(json.dumps, items)))
    made = [dumps.Source(n, "jsonl", {"path": str(tmp_path / n)}) for n in ("one", "two", "late")]
    return [*made, dumps.Source("off", "jsonl", {"path": str(tmp_path / "one")}, enabled=False), dumps.Source("none", "jsonl", {"path": str(tmp_path / "none")})]


def test_ingest_writes_articles_and_manifest(spark, sources, tmp_path):
    out = str(tmp_path / "store")
    run = newsflow.run_ingest(spark, sources, out, "r1", "2024-02-01T00:00:00Z", until="2024-01-05")
    row = run.manifest.first()
    assert (row["run_id"], row["dry_run"], row["window"]["until"], row["window"]["since"]) == ("r1", False, "2024-01-05", None)
    assert row["totals"] == {"one": 2, "two": 1, "late": 0, "none": 0}
    assert row["outputs"] == [f"{out}/raw/r1/ingest_source=one", f"{out}/raw/r1/ingest_source=two"]
    back = dumps.read_articles(spark, run.articles_path)
    assert sorted(r["article_id"] for r in back.collect()) == ["a1", "a1", "a2"]
    with pytest.raises(Exception, match="(?i)exist"):
        newsflow.run_ingest(spark, sources, out, "r1", "2024-02-01T00:00:00Z")


def test_dry_run_writes_nothing(spark, sources, tmp_path):
    out = tmp_path / "store"
    run = newsflow.run_ingest(spark, sources, str(out), "r1", "2024-02-01T00:00:00Z", limit=1, dry_run=True)
    row = run.manifest.first()
    assert row["dry_run"] and row["totals"] == {"one": 1, "two": 1, "late": 1, "none": 0} and row["outputs"] == []
    assert run.articles_path is None and run.manifest_path is None and not out.exists()


def test_experiment_leaves_its_results(spark, rows, tmp_path):
    days = rows.withColumn("event_date", F.date_add(F.lit("2024-01-01").cast("date"), F.substring("event_id", 2, 1).cast("int")))
    s = ex.Settings(target="label", categorical=["speaker"], n_splits=2, calibration="sigmoid", cv=2, max_features=20)
    result = ex.run_experiment(days.withColumn("label", F.col("label").cast("boolean")), s)
    copies = spark.createDataFrame([("E0", "hash", '[{"article_id":"a"}]')], "event_id string, news_snapshot_hash string, news_provenance string")
    folder = str(tmp_path / "runs" / "first")
    paths = ex.save_result(result, s, folder, "data/v1/segments.parquet", copies)
    want = {r["metric"]: r["value"] for r in result.metrics.collect()}
    read = tables.read_metric_files(spark, f"{folder}/aggregate_metrics.json").first()
    assert read["experiment"] == "first" and all(read[m] == pytest.approx(want[m], nan_ok=True) for m in want)
    config = tables.read_run_configs(spark, f"{folder}/config.yaml").first()
    assert tuple(config) == ("first", "label", "v1/segments")
    assert spark.read.json(paths["calibration"]).first()["method"] == "sigmoid"
    folds = spark.read.option("allowNonNumericNumbers", True).json(paths["fold_metrics"])
    assert folds.count() == result.fold_metrics.count()
    assert spark.read.parquet(paths["feature_importances"]).count() == result.fitted.size
    assert spark.read.parquet(paths["predictions"]).count() == result.predictions.count()
    assert spark.read.parquet(paths["news_snapshot_hash"]).first()[0] == "hash" and spark.read.parquet(paths["news_provenance"]).count() == 1
    model, fitted = ex.load_model(spark, paths["model"])
    assert ex.score_segments(days, fitted, model, s).count() == 60
    assert news.META_COLUMNS == ["news_snapshot_hash", "news_provenance"]
    with pytest.raises(Exception, match="(?i)exist"):
        ex.save_result(result, s, folder)
