import datetime as dt
import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from phrasecast.operators import folds as fl, metrics as mt


def timeline(spark, n=10, days=4):
    rows = [(f"S{i}", f"E{i % days}", dt.date(2024, 1, 1 + i % days)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "segment_id string, event_id string, event_date date").repartition(3)


def in_order(rows):
    return [r[0] for r in sorted(rows, key=lambda r: (r[2], hashlib.md5(r[0].encode()).hexdigest()))]


def rolling(rows, k, minimum):
    ids, out, n = in_order(rows), set(), len(rows)
    size, number = max(1, n // (k + 1)), 0
    for i in range(k):
        start = n - (k - i) * size
        if start < minimum or start <= 0:
            continue
        out |= {(s, number, "train") for s in ids[:start]} | {(s, number, "validate") for s in ids[start:start + size]}
        number += 1
    return out


@pytest.mark.parametrize("n,days,k,minimum", [(10, 4, 3, 0), (10, 4, 3, 5), (97, 1, 4, 5), (60, 25, 5, 30), (3, 2, 2, 1)])
def test_rolling(spark, n, days, k, minimum):
    rows, df = timeline(spark, n, days)
    got = {(r["segment_id"], r["fold"], r["role"]) for r in fl.rolling_folds(df, k, minimum).collect()}
    assert got == rolling(rows, k, minimum)


def test_fixture_borders(spark):
    rows, df = timeline(spark)
    assert sorted(r["n_train"] for r in fl.rolling_borders(df, 3).collect()) == [4, 6, 8]
    assert [r["segment_id"] for r in fl.date_positions(df).orderBy("position").collect()] == in_order(rows)


def test_rows_without_date_come_last(spark):
    rows = [(f"S{i}", f"E{i}", dt.date(2024, 1, 1 + i) if i < 6 else None) for i in range(8)]
    df = spark.createDataFrame(rows, "segment_id string, event_id string, event_date date")
    placed = {r["segment_id"]: r["position"] for r in fl.date_positions(df).collect()}
    assert [placed[f"S{i}"] for i in range(6)] == list(range(6)) and {placed["S6"], placed["S7"]} == {6, 7}
    last = fl.rolling_folds(df, 3, 1).filter("fold = 2 AND role = 'validate'")
    assert {r["segment_id"] for r in last.collect()} == {"S6", "S7"}


def test_times_of_day(spark):
    pick = random.Random(2)
    at = [dt.datetime(2024, 1, 1 + i % 3, pick.randrange(24), pick.randrange(3)) for i in range(60)]
    rows = [(f"S{i}", f"E{i}", t) for i, t in enumerate(at)]
    df = spark.createDataFrame(rows, "segment_id string, event_id string, event_date timestamp").repartition(3)
    assert [r["segment_id"] for r in fl.date_positions(df).orderBy("position").collect()] == in_order(rows)
    got = {(r["segment_id"], r["fold"], r["role"]) for r in fl.rolling_folds(df, 4, 5).collect()}
    assert got == rolling(rows, 4, 5)


def test_leave_one_event_out(spark):
    rows = [(f"S{i}", e) for i, e in enumerate("AAAAAABBC")]
    df = spark.createDataFrame(rows, "segment_id string, event_id string")
    table = fl.leave_one_event_out(df, 5).orderBy("fold").collect()
    assert [tuple(r) for r in table] == [(0, "B", 2, 7), (1, "C", 1, 8)]
    held = fl.held_out_rows(df, fl.leave_one_event_out(df, 0)).collect()
    assert {r["segment_id"]: r["fold"] for r in held} == {s: "ABC".index(e) for s, e in rows}


def test_labels(spark):
    df = spark.createDataFrame([(1.0, "first"), (None, "second"), (0.0, "third")], "t double, text string")
    assert sorted((r["label"], r["text"]) for r in fl.require_labels(df, "t").collect()) == [(0, "third"), (1, "first")]
    with pytest.raises(ValueError):
        fl.require_labels(df.withColumn("t", F.lit(None).cast("double")), "t")


def test_stratified_parts(spark):
    df = spark.createDataFrame([(f"S{i}", int(i % 5 == 0)) for i in range(47)], "segment_id string, label int")
    sizes = fl.stratified_parts(df, 3).groupBy("label", "part").count().collect()
    for label in (0, 1):
        counts = [r["count"] for r in sizes if r["label"] == label]
        assert len(counts) == 3 and max(counts) - min(counts) <= 1


def brute(rows):
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
    auc = wins / (len(pos) * len(neg)) if pos and neg else math.nan
    area, recall = 0.0, 0.0
    for t in sorted({p for _, p in rows}, reverse=True):
        said = [y for y, p in rows if p >= t]
        r = sum(said) / len(pos) if pos else 0
        area, recall = area + (r - recall) * sum(said) / len(said), r
    clip = [(y, min(max(p, mt.EPSILON), 1 - mt.EPSILON)) for y, p in rows]
    loss = -sum(math.log(p if y else 1 - p) for y, p in clip) / len(rows)
    tp = sum(1 for y, p in rows if p >= 0.5 and y)
    fp = sum(1 for y, p in rows if p >= 0.5 and not y)
    fn = sum(1 for y, p in rows if p < 0.5 and y)
    ratio = lambda a, b: a / b if b else 0.0
    return {
        "log_loss": loss, "brier": sum((p - y) ** 2 for y, p in rows) / len(rows), "roc_auc": auc,
        "average_precision": area, "f1": ratio(2 * tp, 2 * tp + fp + fn), "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn), "accuracy": 1 - (fp + fn) / len(rows),
    }


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(3)
    rows = []
    for fold in range(5):
        for i in range(120):
            p = rng.choice([0.0, 1.0, round(rng.random(), 2), rng.random(), rng.random() * 1e-7])
            y = {3: 1, 4: 0}.get(fold, int(rng.random() < 0.3 + 0.4 * p))
            rows.append((fold, f"{fold}-{i}", y, p))
    return rows, spark.createDataFrame(rows, "fold int, id string, y int, p double").repartition(5)


def test_metrics_match_brute_force(scored):
    rows, df = scored
    for r in mt.classification_metrics(df).collect():
        want = brute([(y, p) for f, _, y, p in rows if f == r["fold"]])
        for name, value in want.items():
            assert r[name] == pytest.approx(value, nan_ok=True), (r["fold"], name)


def test_means(scored):
    _, df = scored
    long = mt.long_metrics(mt.classification_metrics(df))
    means = {r["metric"]: r["value"] for r in mt.mean_over_folds(long).collect()}
    assert math.isnan(means["roc_auc"]) and not math.isnan(means["f1"])
    summary = {r["metric"]: r for r in mt.fold_summary(long).collect()}
    assert summary["roc_auc"]["min"] <= summary["roc_auc"]["mean"] <= summary["roc_auc"]["max"] <= 1


def test_calibration_curve(spark):
    values = [0.0, 0.1, 0.3, 0.7, 0.95, 1.0, 0.100001]
    df = spark.createDataFrame([(0, 1, p) for p in values], "fold int, y int, p double")
    bins = {r["bin"]: r["rows"] for r in mt.calibration_curve(df).collect()}
    assert bins == {0: 2, 1: 1, 2: 1, 6: 1, 9: 2}
