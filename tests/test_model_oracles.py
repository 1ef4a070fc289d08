"""Fitted models against small fits in numpy: coefficients, trees, calibration, folds, scores."""

import math

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from phrasecast.operators import models as md
from phrasecast.plans import experiment as ex
from phrasecast.session import materialize


def logistic(x, y, w, penalty):
    """Newton's method for weighted log loss plus ``penalty / 2`` times the squared coefficients; the intercept is free."""
    a = np.hstack([x, np.ones((len(x), 1))])
    shrink = np.diag([penalty] * x.shape[1] + [0.0])
    b = np.zeros(a.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-a @ b))
        step = np.linalg.solve((a * (w * p * (1 - p))[:, None]).T @ a + shrink, a.T @ (w * (p - y)) + shrink @ b)
        b -= step
        if np.abs(step).max() < 1e-12:
            break
    return b


def balanced(y):
    return np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))


def isotonic(margin, y):
    """Pooled adjacent violators over distinct margins; linear between them, constant outside."""
    at = np.unique(margin)
    blocks = []
    for m in at:
        blocks.append([y[margin == m].sum(), (margin == m).sum(), 1])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, n, k = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2] + k]
    level = np.concatenate([[s / n] * k for s, n, k in blocks])
    return lambda new: np.interp(new, at, level)


def sigmoid(margin, y):
    high, low = (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2)
    b = logistic(margin[:, None], np.where(y == 1, high, low), np.ones(len(y)), 0.0)
    return lambda new: 1 / (1 + np.exp(-(b[0] * new + b[1])))


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(7)
    words = ["tariff", "calm", "growth", "water", "harbour", "north", "south"]
    rows = []
    for i in range(150):
        said = [w for w in words if rng.random() < 0.4] or ["quiet"]
        y = rng.random() < 1 / (1 + math.exp(-(2.0 * ("tariff" in said) - 1.5 * ("calm" in said) - 0.3)))
        rows.append((f"s{i:03d}", f"E{i // 15}", " ".join(said), ["A", "B"][i % 2], bool(y)))
    df = spark.createDataFrame(rows, "segment_id string, event_id string, text string, speaker string, target boolean")
    return df.withColumn("event_date", F.date_add(F.lit("2024-01-01").cast("date"), F.substring("event_id", 2, 2).cast("int"))).repartition(3)


def settings(**changes):
    return ex.Settings(**{"target": "target", "categorical": ["speaker"], "ngram_range": (1, 1), "n_splits": 2, **changes})


def matrix(vectors):
    rows = sorted(vectors.select("row_id", vector_to_array("features").alias("x"), "label").collect(), key=lambda r: r["row_id"])
    return [r["row_id"] for r in rows], np.array([r["x"] for r in rows]), np.array([r["label"] for r in rows], float)


@pytest.fixture(scope="module")
def fitted(frame):
    s = settings()
    rows, counts = ex.prepare(frame, s)
    state, vectors = ex.fit_features(rows, counts, s)
    return s, rows, counts, state, vectors, *matrix(vectors)


@pytest.mark.parametrize(("c", "weights"), [(1.0, "balanced"), (0.1, "balanced"), (5.0, None)])
def test_logistic_coefficients(fitted, c, weights):
    *_, vectors, ids, x, y = fitted
    w = balanced(y) if weights else np.ones(len(y))
    want = logistic(x, y, w, 1 / c)
    model = md.fit_model(vectors, C=c, class_weight=weights)
    assert np.allclose(model.coefficients.toArray(), want[:-1], atol=2e-4) and model.intercept == pytest.approx(want[-1], abs=2e-4)
    p = {r["row_id"]: r["p"] for r in md.score(model, vectors).collect()}
    assert np.allclose([p[i] for i in ids], 1 / (1 + np.exp(-(x @ want[:-1] + want[-1]))), atol=1e-4)


def test_importances_are_the_coefficients(fitted):
    _, _, _, state, vectors, _, x, y = fitted
    names = {r["index"]: r["feature"] for r in state.index.collect()}
    want = logistic(x, y, balanced(y), 1.0)
    got = {r["feature"]: r["importance"] for r in md.feature_importances(md.fit_model(vectors), state.index).collect()}
    assert got == pytest.approx({names[i]: v for i, v in enumerate(want[:-1])}, abs=2e-4)


def test_first_tree_of_boosting(spark):
    """One tree of depth 1: the split with the least squared error on labels of -1 and 1; leaves are their means."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2, (200, 4)).astype(float)
    y = (rng.random(200) < 0.2 + 0.6 * x[:, 2]).astype(int)
    from pyspark.ml.linalg import Vectors

    rows = spark.createDataFrame([(i, Vectors.dense(v.tolist()), int(t)) for i, (v, t) in enumerate(zip(x, y))], ["row_id", "features", "label"])
    model = md.fit_model(rows, "gradient_boosting", n_estimators=1, max_depth=1, subsample=1.0, learning_rate=0.1)
    z = 2.0 * y - 1
    error = [sum(((z[x[:, k] == v] - z[x[:, k] == v].mean()) ** 2).sum() for v in (0, 1)) for k in range(4)]
    best = int(np.argmin(error))
    assert model.featureImportances.toArray().tolist() == [float(k == best) for k in range(4)]
    leaf = np.array([z[x[:, best] == v].mean() for v in (0, 1)])[x[:, best].astype(int)]
    got = np.array([r["p"] for r in md.score(model, rows).orderBy("row_id").collect()])
    assert np.allclose(got, 1 / (1 + np.exp(-2 * leaf)), atol=1e-9)
    index = spark.createDataFrame([(i, f"f{i}") for i in range(4)], "index bigint, feature string")
    top = md.feature_importances(model, index).orderBy(F.desc("importance")).first()
    assert tuple(top) == (f"f{best}", 1.0)


@pytest.mark.parametrize(("method", "fit"), [("sigmoid", sigmoid), ("isotonic", isotonic)])
def test_calibration_is_the_mean_of_its_parts(fitted, method, fit):
    from phrasecast.operators.folds import stratified_parts

    *_, vectors, ids, x, y = fitted
    parts = {r["row_id"]: r["part"] for r in stratified_parts(vectors.select("row_id", "label"), 3, "label", "row_id").collect()}
    part = np.array([parts[i] for i in ids])
    want = np.zeros(len(y))
    for k in range(3):
        b = logistic(x[part != k], y[part != k], balanced(y[part != k]), 1.0)
        margin = x @ b[:-1] + b[-1]
        want += fit(margin[part == k], y[part == k])(margin) / 3
    out = md.calibrate(vectors, "logistic_regression", method, 3).predict(vectors)
    got = {r["row_id"]: r["p"] for r in out.collect()}
    near = np.abs(np.array([got[i] for i in ids]) - want)
    # A step of the isotonic fit between two almost equal margins may fall on either side.
    assert np.quantile(near, 0.9) < 1e-3 and (method == "isotonic" or near.max() < 1e-3)


def test_fitting_of_each_fold(frame):
    s = settings(calibration="none")
    out = ex.run_experiment(frame, s)
    rows, counts = ex.prepare(frame, s)
    for fold, train, valid in ex._folds(rows, s):
        state, vectors = ex.fit_features(train, counts, s)
        _, x, y = matrix(vectors)
        b = logistic(x, y, balanced(y), 1.0)
        ids, new, _ = matrix(ex.transform(valid, counts, state, s))
        got = {r["row_id"]: r["p"] for r in out.predictions.filter(F.col("fold") == fold).collect()}
        assert sorted(got) == ids and np.allclose([got[i] for i in ids], 1 / (1 + np.exp(-(new @ b[:-1] + b[-1]))), atol=1e-3)


def test_scores_of_new_segments(spark, frame, fitted, tmp_path):
    s, _, _, state, vectors, _, x, y = fitted
    model = md.calibrate(vectors, s.model, "none")
    ex.save_model(model, state, str(tmp_path / "m"))
    again, loaded = ex.load_model(spark, str(tmp_path / "m"))
    scored = materialize(ex.score_segments(frame, loaded, again, s), "scores")
    b = logistic(x, y, balanced(y), 1.0)
    got = {r["row_id"]: r["probability"] for r in scored.collect()}
    assert np.allclose([got[i] for i in sorted(got)], 1 / (1 + np.exp(-(x @ b[:-1] + b[-1]))), atol=1e-3)
    assert {r["event_id"] for r in scored.collect()} == {f"E{i}" for i in range(10)}
