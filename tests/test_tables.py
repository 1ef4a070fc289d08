import json
import math

import pytest

from phrasecast.operators import label, metrics as mt, profile
from phrasecast.sources import tables

MANIFEST = {
    "version": "v1", "generated_at": "20240101T000000Z", "num_rows": 700,
    "validation": {"checks": {"unique_segment_ids": True}, "notes": []}, "target_columns": {"balance sheet": "target__balance_sheet"},
}


@pytest.fixture
def runs(tmp_path):
    data = tmp_path / "data"
    data.mkdir()
    (data / "segments_v0.json").write_text(json.dumps({**MANIFEST, "target_columns": {}}, indent=2))
    (data / "segments_v1.json").write_text(json.dumps(MANIFEST, indent=2))
    for name, stem, column, metrics in (
        ("p_baseline", "segments_v1", "target__balance_sheet", '{\n "log_loss": 0.25,\n "roc_auc": NaN,\n "accuracy": 0.9\n}'),
        ("p_baseline2", "segments_v9", "target__soft_landing", '{"log_loss": 0.5}'),
    ):
        folder = tmp_path / "runs" / name
        folder.mkdir(parents=True)
        (folder / "config.yaml").write_text(f"dataset_path: ../data/{stem}.parquet\ntarget_column: '{column}'\nfeature:\n  target_column: no\n")
        (folder / "aggregate_metrics.json").write_text(metrics)
        (folder / "fold_0_metrics.json").write_text('{"roc_auc": NaN, "f1": 0.5}')
        (folder / "fold_1_metrics.json").write_text('{"roc_auc": 0.5, "f1": 1.0}')
    (tmp_path / "runs" / "no_metrics").mkdir()
    (tmp_path / "runs" / "no_metrics" / "config.yaml").write_text("target_column: target__x\n")
    return tmp_path


def test_runs(spark, runs):
    found = profile.run_table(
        tables.read_run_configs(spark, f"{runs}/runs/*/config.yaml"),
        tables.read_metric_files(spark, f"{runs}/runs/*/aggregate_metrics.json"),
        tables.read_manifests(spark, f"{runs}/data/segments_*.json"),
    ).collect()
    assert [(r["phrase"], r["experiment"], r["num_rows"], r["accuracy"]) for r in found] == [
        ("balance sheet", "p_baseline", 700, 0.9), ("soft landing", "p_baseline2", None, None),
    ]
    table = profile.run_table(
        tables.read_run_configs(spark, f"{runs}/runs/*/config.yaml"),
        tables.read_metric_files(spark, f"{runs}/runs/*/aggregate_metrics.json"),
        tables.read_manifests(spark, f"{runs}/data/segments_*.json"),
    )
    shown = profile.comparison_table(profile.runs_with_accuracy(table)).collect()
    assert [r.asDict() for r in shown] == [
        {"phrase": "balance sheet", "experiment": "p_baseline", "dataset_version": "v1", "generated_at": "20240101T000000Z",
         "num_rows": "700", "accuracy": "90.0%", "average_precision": "—", "log_loss": "0.250", "brier": "—"}
    ]


def test_equal_stems_in_other_folders_do_not_mix(spark, runs):
    other = runs / "other"
    other.mkdir()
    (other / "segments_v1.json").write_text(json.dumps({**MANIFEST, "num_rows": 1}))
    found = profile.run_table(
        tables.read_run_configs(spark, f"{runs}/runs/*/config.yaml"),
        tables.read_metric_files(spark, f"{runs}/runs/*/aggregate_metrics.json"),
        tables.read_manifests(spark, f"{runs}/*/segments_*.json"),
    ).collect()
    assert [(r["experiment"], r["num_rows"]) for r in found] == [("p_baseline", 700), ("p_baseline2", None)]


def test_fold_files(spark, runs):
    read = tables.read_metric_files(spark, f"{runs}/runs/p_baseline/fold_*_metrics.json")
    rows = {r["file"]: r for r in read.collect()}
    assert math.isnan(rows["fold_0_metrics.json"]["roc_auc"]) and rows["fold_0_metrics.json"]["brier"] is None
    long = read.unpivot(["file"], mt.METRICS, "metric", "value")
    summary = {r["metric"]: tuple(r)[1:] for r in mt.fold_summary(long).collect()}
    assert summary["roc_auc"] == (0.5, 0.5, 0.5) and summary["f1"] == (0.75, 0.5, 1.0)
    assert tables.read_metric_files(spark, f"{runs}/nowhere/*.json").count() == 0


def test_target_terms(spark, runs):
    manifests = tables.read_manifests(spark, f"{runs}/data/segments_*.json")
    assert [r["term"] for r in tables.target_terms(manifests).collect()] == ["balance sheet"]


def test_publish(spark, tmp_path):
    rows = spark.createDataFrame([("S1", "press", "x", True)], "segment_id string, event_type string, text string, target__a boolean")
    path = tables.write_segments(rows, str(tmp_path), "v1", by_type=True)
    assert path.endswith("segments_v1.parquet") and spark.read.parquet(path).count() == 1
    with pytest.raises(Exception):
        tables.write_segments(rows, str(tmp_path), "v1")
    manifest = tables.segment_manifest(rows, label.validate_segments(rows), "v1", "now", {"a": "target__a"})
    where = tables.write_one_json(manifest, f"{tmp_path}/segments_v1.json")
    back = tables.read_manifests(spark, where).first()
    assert back["num_rows"] == 1 and back["dataset_stem"] == "segments_v1" and back["target_columns"] == {"a": "target__a"}
    assert back["validation"]["checks"] == {"unique_segment_ids": True, "non_empty_text": True}


def test_results(spark, tmp_path):
    paths = tables.write_results({"curve": spark.range(2), "folds": spark.range(3)}, str(tmp_path / "r"))
    assert spark.read.parquet(paths["folds"]).count() == 3


def test_profile(spark):
    df = spark.createDataFrame([(1, None, 1.0), (2, "x", float("nan"))], "a int, b string, c double")
    got = [tuple(r) for r in profile.dataset_profile(df).collect()]
    assert got == [(2, 0, "a", "int", 0), (2, 1, "b", "string", 1), (2, 2, "c", "double", 1)]
