import datetime as dt
import math
import random
import re
from collections import Counter

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from phrasecast.operators import features as fx, metrics as mt, models as md
from phrasecast.plans import experiment as ex

WORDS = ["growth", "credit", "rates", "été", "data", "x", "soft", "landing"]


def corpus(n=60, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        label = i % 3 == 0
        words = [rng.choice(WORDS) for _ in range(rng.randint(1, 12))] + (["tariff"] * 2 if label else ["calm"])
        rows.append((f"S{i:03d}", f"E{i % 6}", dt.date(2024, 1, 1 + i % 20), " ".join(words), "AB"[i % 2], label if i % 10 else None))
    return rows


SCHEMA = "segment_id string, event_id string, event_date date, text string, speaker string, target__tariff boolean"


def brute_tfidf(docs, low, high, min_df, max_df):
    def grams(text):
        words = re.findall(r"\b\w\w+\b", text.lower())
        return [" ".join(words[i:i + n]) for n in range(low, high + 1) for i in range(len(words) - n + 1)]

    counts = {k: Counter(grams(t)) for k, t in docs.items()}
    df = Counter(t for c in counts.values() for t in c)
    idf = {t: math.log((1 + len(docs)) / (1 + d)) + 1 for t, d in df.items() if min_df <= d <= max_df * len(docs)}
    out = {}
    for k, c in counts.items():
        w = {t: (1 + math.log(f)) * idf[t] for t, f in c.items() if t in idf}
        norm = math.sqrt(sum(x * x for x in w.values()))
        out.update({(k, t): x / norm for t, x in w.items()})
    return out


@pytest.mark.parametrize("cap", [None, 5])
def test_tfidf(spark, cap):
    docs = {r[0]: r[3] for r in corpus()} | {"empty": "", "short": "a b"}
    df = spark.createDataFrame(list(docs.items()), "id string, text string").repartition(3)
    counts = fx.term_counts(df, "id", "text")
    n = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    got = {(r["row_id"], r["feature"]): r["value"] for r in fx.tfidf(counts, fx.fit_tfidf(counts, n, 2, 0.9, cap), cap).collect()}
    want = brute_tfidf(docs, 1, 2, 2, 0.9)
    if cap is None:
        assert got == pytest.approx(want)
    else:
        total = Counter()
        for text in docs.values():
            words = re.findall(r"\b\w\w+\b", text)
            total.update(words + [f"{a} {b}" for a, b in zip(words, words[1:])])
        allowed = {t for _, t in want}
        top = sorted(allowed, key=lambda t: (-total[t], t))[:cap]
        assert {t for _, t in got} == set(top)


def test_one_hot(spark):
    df = spark.createDataFrame([("1", "a", "x"), ("2", "b", "x"), ("3", None, "y")], "id string, c string, d string")
    new = spark.createDataFrame([("9", "zzz", "y")], "id string, c string, d string")
    names = lambda rows: sorted((r["row_id"], r["feature"]) for r in rows.collect())
    levels = fx.fit_one_hot(df, "id", ["c", "d"])
    assert names(fx.one_hot(df, "id", ["c", "d"], levels)) == [("1", "c_a"), ("1", "d_x"), ("2", "c_b"), ("2", "d_x"), ("3", "c_None"), ("3", "d_y")]
    assert names(fx.one_hot(new, "id", ["c", "d"], levels)) == [("9", "d_y")]
    with pytest.raises(Exception, match="unknown level zzz"):
        fx.one_hot(new, "id", ["c", "d"], levels, "error").collect()
    assert names(fx.one_hot(df, "id", ["c", "d"], fx.fit_one_hot(df, "id", ["c", "d"], "if_binary")))[-1] == ("3", "d_y")
    assert ("1", "d_x") not in names(fx.one_hot(df, "id", ["c", "d"], fx.fit_one_hot(df, "id", ["c", "d"], "first")))


def test_scales_embeddings_vectors(spark):
    df = spark.createDataFrame([("1", 2.0, 5.0), ("2", None, 5.0), ("3", 4.0, 5.0)], "id string, a double, b double")
    cells = fx.numeric_features(df, "id", ["a", "b"])
    scales = {r[0]: r[1] for r in fx.fit_scales(cells, F.lit(3)).collect()}
    assert scales == pytest.approx({"a": math.sqrt(20 / 3 - 4), "b": 1.0})
    scaled = fx.scale_features(cells, fx.fit_scales(cells, F.lit(3)))
    assert scaled.filter("row_id = '3' AND feature = 'b'").first()["value"] == 5.0
    emb = spark.createDataFrame([("1", [3.0, 4.0]), ("3", [0.0, 0.0])], "k string, embedding array<float>")
    dense = fx.embedding_features(df, "id", emb, "k")
    assert sorted(tuple(r) for r in dense.collect())[:2] == [("1", "embedding_00000", 0.6), ("1", "embedding_00001", 0.8)]
    union = fx.union_features({"n": cells, "e": dense})
    index = fx.feature_index(union)
    rows = df.select(F.col("id").alias("row_id"), "a")
    vectors = fx.feature_vectors(rows, union, index, index.count())
    names = {r["index"]: r["feature"] for r in index.collect()}
    assert names == {0: "e__embedding_00000", 1: "e__embedding_00001", 2: "n__a", 3: "n__b"}
    got = {r["row_id"]: r["v"] for r in vectors.select("row_id", vector_to_array("features").alias("v")).collect()}
    assert got == {"1": [0.6, 0.8, 2.0, 5.0], "2": [0.0, 0.0, 0.0, 5.0], "3": [0.0, 0.0, 4.0, 5.0]}


def settings(**changes):
    return ex.Settings(**{"target": "target__tariff", "categorical": ["speaker"], "n_splits": 2, "parallel_fits": 2, **changes})


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def trained(frame):
    s = settings()
    rows, counts = ex.prepare(frame, s)
    return s, rows, counts, *ex.fit_features(rows, counts, s)


def test_balanced_weights():
    assert md.class_weights({0: 30, 1: 10}) == {0: 40 / 60, 1: 2.0}


def test_logistic_and_importances(trained):
    s, _, _, fitted, vectors = trained
    model = md.fit_model(vectors)
    found = md.feature_importances(model, fitted.index).orderBy(F.desc("importance")).first()
    assert "tariff" in found["feature"]
    scored = md.score(model, vectors).select(F.lit(0).alias("fold"), F.col("label").alias("y"), "p")
    assert mt.classification_metrics(scored).first()["roc_auc"] > 0.99
    # A weaker penalty gives larger coefficients.
    free = md.fit_model(vectors, C=100.0)
    assert abs(free.coefficients.toArray()).max() > abs(model.coefficients.toArray()).max()


@pytest.mark.parametrize("method", ["none", "sigmoid", "isotonic"])
def test_calibration(trained, method):
    _, _, _, _, vectors = trained
    model = md.calibrate(vectors, "logistic_regression", method, 3)
    assert len(model.pairs) == (1 if method == "none" else 3)
    out = model.predict(vectors)
    values = [r["p"] for r in out.collect()]
    assert len(values) == vectors.count() and all(0 <= p <= 1 for p in values)
    final = out.select(F.lit(0).alias("fold"), F.col("label").alias("y"), "p")
    assert mt.calibration_result(final, method).first()["brier"] < 0.15


def test_boosting(trained):
    _, _, _, fitted, vectors = trained
    model = md.fit_model(vectors, "gradient_boosting", n_estimators=5)
    top = md.feature_importances(model, fitted.index).orderBy(F.desc("importance")).first()
    assert "tariff" in top["feature"] or "calm" in top["feature"]
    with pytest.raises(ValueError):
        md.fit_model(vectors, "forest")


def test_save_load_score(spark, frame, trained, tmp_path):
    s, _, _, fitted, vectors = trained
    model = md.calibrate(vectors, s.model, "isotonic", 3)
    ex.save_model(model, fitted, str(tmp_path / "m"))
    again, state = ex.load_model(spark, str(tmp_path / "m"))
    new = frame.limit(20)
    rows = lambda m, f: {r["row_id"]: r["probability"] for r in ex.score_segments(new, f, m, s).collect()}
    assert rows(again, state) == pytest.approx(rows(model, fitted))


def test_experiment_rolling(frame):
    out = ex.run_experiment(frame, settings())
    assert sorted(r["fold"] for r in out.fold_metrics.collect()) == [0, 1]
    assert {r["metric"] for r in out.metrics.collect()} == set(mt.METRICS)
    assert out.predictions.filter("p < 0 OR p > 1").count() == 0
    assert out.calibration.first()["method"] == "isotonic"
    assert out.importances.count() == out.fitted.size


def test_experiment_leave_one_event_out(frame):
    out = ex.run_experiment(frame, settings(strategy="leave_one_event_out", calibration="none", minimum_train=1))
    assert out.fold_metrics.count() == 6
    assert out.predictions.count() == frame.filter("target__tariff IS NOT NULL").count()


def test_training_folds_fit_their_own_vocabulary(frame):
    s = settings()
    rows, counts = ex.prepare(frame, s)
    few, _ = ex.fit_features(rows.limit(5), counts, s)
    allof, _ = ex.fit_features(rows, counts, s)
    assert few.size < allof.size


def test_embedding_block_in_the_experiment(spark, frame):
    vectors = frame.select("segment_id", F.array(F.length("text").cast("float"), F.lit(1.0).cast("float")).alias("embedding"))
    s = settings(embeddings=vectors)
    rows, counts = ex.prepare(frame, s)
    fitted, _ = ex.fit_features(rows, counts, s)
    assert fitted.index.filter("feature LIKE 'dense__embedding_%'").count() == 2


def test_salted_vocabulary_join_gives_the_same_weights(frame, monkeypatch):
    s = settings(max_features=10)
    rows, counts = ex.prepare(frame, s)
    vocabulary = fx.fit_tfidf(counts, F.lit(rows.count()), 2, 0.9, 10)
    key = lambda r: (r["row_id"], r["feature"])
    small = {key(r): r["value"] for r in fx.tfidf(counts, vocabulary, 10).collect()}
    monkeypatch.setattr(fx, "BROADCAST_ROWS", 1)
    assert {key(r): r["value"] for r in fx.tfidf(counts, vocabulary, 10).collect()} == pytest.approx(small)


def test_bad_settings(frame):
    with pytest.raises(ValueError):
        ex.run_experiment(frame, settings(strategy="random"))
    with pytest.raises(ValueError):
        ex.run_experiment(frame, settings(minimum_train=10_000))


def test_texts_of_a_task_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(fx, "TEXT_BYTES", 100)
    df = spark.createDataFrame([(i, f"some words {i} here") for i in range(100)], "id int, text string").coalesce(1)
    counts = fx.term_counts(df, "id", "text")
    # About 1800 bytes: more partitions than the 4 of the session, and adaptive execution keeps them.
    assert counts.rdd.getNumPartitions() >= 15
    # "some words 7 here" has three words of two characters, "some words 17 here" four.
    assert counts.agg(F.sum("tf")).first()[0] == 10 * (3 + 2) + 90 * (4 + 3)


def test_rolling_folds_never_join_the_counts(spark, frame):
    """Rows and counts of a fold are filters of written tables; repeated ids count once, as with a join."""
    s = settings()
    twice = frame.unionByName(frame.limit(7))
    rows, plain = ex.prepare(twice, s)
    counts, jobs = ex._rolling_jobs(rows, s)
    key = lambda df: sorted(map(str, df.select("row_id", "term", "tf").collect()))
    assert key(counts) == key(plain)
    want = ex._folds(rows, s)
    assert [j[0] for j in jobs] == [f for f, _, _ in want]
    for (_, train, valid, train_counts, valid_counts), (_, a, b) in zip(jobs, want):
        for got, own, old in ((train, train_counts, a), (valid, valid_counts, b)):
            assert sorted(r[0] for r in got.select("row_id").collect()) == sorted(r[0] for r in old.select("row_id").collect())
            assert key(own) == key(plain.join(old.select("row_id"), "row_id", "left_semi"))
            assert "Join" not in own._jdf.queryExecution().optimizedPlan().toString()


def test_vectors_scale_one_block(spark):
    rows = spark.createDataFrame([("1",), ("2",)], "row_id string")
    cells = spark.createDataFrame([("1", "text__a", 3.0), ("1", "text__b", 4.0), ("1", "x__c", 2.0), ("2", "x__c", 7.0)], "row_id string, feature string, value double")
    index = spark.createDataFrame([("text__a", 0), ("text__b", 1), ("x__c", 2)], "feature string, index bigint")
    got = fx.feature_vectors(rows, cells, index, 3, "text__").select("row_id", vector_to_array("features").alias("v")).collect()
    assert {r["row_id"]: r["v"] for r in got} == {"1": pytest.approx([0.6, 0.8, 2.0]), "2": [0.0, 0.0, 7.0]}
