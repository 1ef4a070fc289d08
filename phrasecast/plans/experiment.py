"""Labelled rows to folds, models, metrics, calibration and importances."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassificationModel, LogisticRegressionModel
from pyspark.sql import DataFrame, functions as F

from phrasecast.operators import features as fx, folds as fl, metrics as mt, models as md, news as op_news
from phrasecast.session import materialize
from phrasecast.sources import tables


@dataclass
class Settings:
    target: str
    row_id: str = "segment_id"
    text: str = "text"
    ngram_range: tuple[int, int] = (1, 2)
    min_df: int | float = 2
    max_df: int | float = 0.9
    max_features: int | None = None
    sublinear_tf: bool = True
    lowercase: bool = True
    categorical: Sequence[str] = ()
    drop: str | None = None
    unknown: str = "ignore"
    numeric: Sequence[str] = ()
    embeddings: DataFrame | None = None  # (embedding_key, embedding_vector), off by default
    embedding_key: str = "segment_id"
    embedding_vector: str = "embedding"
    model: str = "logistic_regression"
    model_params: dict = field(default_factory=dict)
    strategy: str = "rolling"
    n_splits: int = 3
    minimum_train: int = 5
    date: str = "event_date"
    event: str = "event_id"
    calibration: str = "isotonic"
    cv: int = 3
    parallel_fits: int = 4


@dataclass
class FittedFeatures:
    """State of the feature blocks: tables only."""

    vocabulary: DataFrame
    levels: DataFrame | None
    index: DataFrame
    size: int


@dataclass
class Result:
    predictions: DataFrame
    fold_metrics: DataFrame
    metrics: DataFrame
    calibration: DataFrame
    calibration_curve: DataFrame
    importances: DataFrame
    model: md.Calibrated
    fitted: FittedFeatures


def _blocks(rows: DataFrame, counts: DataFrame, vocabulary: DataFrame, levels: DataFrame | None, s: Settings):
    blocks = {"text": fx.tfidf(counts, vocabulary, s.max_features, s.sublinear_tf, normalise=False)}
    if s.categorical:
        blocks["category"] = fx.one_hot(rows, "row_id", s.categorical, levels, s.unknown)
    if s.numeric:
        blocks["number"] = fx.numeric_features(rows, "row_id", s.numeric)
    if s.embeddings is not None:
        blocks["dense"] = fx.embedding_features(rows, "row_id", s.embeddings, s.embedding_key, s.embedding_vector)
    return fx.union_features(blocks)


def _own(rows: DataFrame, counts: DataFrame, whole: bool) -> DataFrame:
    """The counts of ``rows``; with ``whole`` the caller has left out all others, so nothing is joined."""
    return counts.filter("row_id IS NOT NULL") if whole else counts.join(rows.select("row_id"), "row_id", "left_semi")


def fit_features(rows: DataFrame, counts: DataFrame, s: Settings, whole: bool = False) -> tuple[FittedFeatures, DataFrame]:
    """Fit the blocks on ``rows`` and return them with the vectors of ``rows``.

    ``whole`` says that ``counts`` holds no other rows, so the large table need not be joined.
    """
    own = _own(rows, counts, whole)
    n_docs = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    vocabulary = materialize(fx.fit_tfidf(own, n_docs, s.min_df, s.max_df, s.max_features), "vocabulary")
    names = {"text": fx.text_names(vocabulary)}
    levels = None
    if s.categorical:
        levels = materialize(fx.fit_one_hot(rows, "row_id", s.categorical, s.drop), "levels")
        names["category"] = fx.category_names(levels)
    if s.numeric:
        named = rows.sparkSession.createDataFrame([(c,) for c in s.numeric], "feature string")
        names["number"] = named
    if s.embeddings is not None:
        names["dense"] = fx.embedding_names(s.embeddings, s.embedding_vector)
    index = fx.feature_index(fx.union_names(names))
    size = index.count()
    if size == 0:
        raise ValueError("no features left: the documents may be empty or min_df too high")
    fitted = FittedFeatures(vocabulary, levels, index, size)
    cells = _blocks(rows, own, vocabulary, levels, s)
    return fitted, fx.feature_vectors(rows.select("row_id", "label"), cells, index, size, "text__")


def transform(rows: DataFrame, counts: DataFrame, fitted: FittedFeatures, s: Settings, whole: bool = False) -> DataFrame:
    own = _own(rows, counts, whole)
    cells = _blocks(rows, own, fitted.vocabulary, fitted.levels, s)
    keep = [c for c in ("row_id", "label", "event_id") if c in rows.columns]
    return fx.feature_vectors(rows.select(*keep), cells, fitted.index, fitted.size, "text__")


def _run_fold(
    fold: int, train: DataFrame, valid: DataFrame, train_counts: DataFrame, valid_counts: DataFrame, s: Settings, whole: bool
) -> DataFrame:
    fitted, vectors = fit_features(train, train_counts, s, whole)
    model = md.fit_model(vectors, s.model, **s.model_params)
    scored = md.score(model, transform(valid, valid_counts, fitted, s, whole))
    return scored.select(F.lit(fold).alias("fold"), "row_id", F.col("label").alias("y"), "p")


def _roles(rows: DataFrame, s: Settings) -> tuple[DataFrame, list[int]]:
    """``(row_id, fold, role)`` of the rolling folds, written once, and the fold numbers (at most ``n_splits``)."""
    folds = fl.rolling_folds(rows, s.n_splits, s.minimum_train, s.date, "row_id").select("row_id", "fold", "role")
    roles = materialize(folds, "folds")
    return roles, sorted(r["fold"] for r in roles.select("fold").distinct().collect())


def _folds(rows: DataFrame, s: Settings) -> list[tuple[int, DataFrame, DataFrame]]:
    if s.strategy == "rolling":
        roles, numbers = _roles(rows, s)

        def part(fold: int, role: str) -> DataFrame:
            chosen = roles.filter((F.col("fold") == fold) & (F.col("role") == role))
            return rows.join(chosen.select("row_id"), "row_id", "left_semi")

        return [(f, part(f, "train"), part(f, "validate")) for f in numbers]
    if s.strategy == "leave_one_event_out":
        # One model per event is what this strategy means, so its fold list is as long as the loop.
        table = fl.leave_one_event_out(rows, s.minimum_train, s.event).orderBy("fold").collect()
        held = [(r["fold"], F.col(s.event).eqNullSafe(r[s.event])) for r in table]
        return [(fold, rows.filter(~own), rows.filter(own)) for fold, own in held]
    raise ValueError(f"unsupported validation strategy: {s.strategy}")


def _labelled(df: DataFrame, s: Settings) -> DataFrame:
    labelled = fl.require_labels(df, s.target)
    used = dict.fromkeys([s.event, s.date, s.text, *s.categorical, *s.numeric, "label"])
    return materialize(labelled.select(F.col(s.row_id).alias("row_id"), *used), "rows")


def _counts(rows: DataFrame, s: Settings, keep: Sequence[str] = ()) -> DataFrame:
    return materialize(fx.term_counts(rows, "row_id", s.text, s.ngram_range, s.lowercase, keep), "counts")


def prepare(df: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """Labelled rows and their token counts, both written once."""
    rows = _labelled(df, s)
    return rows, _counts(rows, s)


def _rolling_jobs(rows: DataFrame, s: Settings) -> tuple[DataFrame, list[tuple]]:
    """Token counts of all rows and ``(fold, train, valid, their counts)`` of the rolling folds.

    Rows and counts carry the folds of their row id (twice the fold, plus 1 to validate), so a fold filters
    both: only the texts are joined with the folds, once, and never the counts.
    """
    roles, numbers = _roles(rows, s)
    code = 2 * F.col("fold") + F.when(F.col("role") == "validate", 1).otherwise(0)
    of_row = roles.groupBy("row_id").agg(F.sort_array(F.collect_set(code)).alias("__folds"))
    marked = rows.join(of_row, "row_id", "left")
    counts = _counts(marked, s, ["__folds"])
    slim = materialize(marked.select(*[c for c in marked.columns if c != s.text or c in (*s.categorical, *s.numeric)]), "marked")

    def part(df: DataFrame, fold: int, valid: int) -> DataFrame:
        return df.filter(F.array_contains("__folds", 2 * fold + valid)).drop("__folds")

    jobs = [(f, part(slim, f, 0), part(slim, f, 1), part(counts, f, 0), part(counts, f, 1)) for f in numbers]
    return counts.drop("__folds"), jobs


def run_experiment(df: DataFrame, s: Settings) -> Result:
    """Folds, metrics over all folds, then the calibrated model on all rows.

    Token counts and rows are written once. Fold fits run from a few driver threads; the data and all
    metrics stay on the executors.
    """
    rows, rolling = _labelled(df, s), s.strategy == "rolling"
    if rolling:
        counts, jobs = _rolling_jobs(rows, s)
    else:
        counts = _counts(rows, s)
        jobs = [(*job, counts, counts) for job in _folds(rows, s)]

    def one(job):
        return materialize(_run_fold(*job, s, rolling), "predictions")

    if not jobs:
        raise ValueError("no fold has enough training rows")
    with ThreadPoolExecutor(max_workers=s.parallel_fits) as pool:
        parts = list(pool.map(one, jobs))
    predictions = parts[0]
    for part in parts[1:]:
        predictions = predictions.unionByName(part)

    per_fold = materialize(mt.classification_metrics(predictions), "fold-metrics")
    fitted, vectors = fit_features(rows, counts, s, whole=True)
    base = md.fit_model(vectors, s.model, **s.model_params)
    calibrated = md.calibrate(vectors, s.model, s.calibration, s.cv, "row_id", **s.model_params)
    final = calibrated.predict(vectors).select(F.lit(0).alias("fold"), F.col("label").alias("y"), "p")
    return Result(
        predictions=predictions,
        fold_metrics=per_fold,
        metrics=mt.mean_over_folds(mt.long_metrics(per_fold)),
        calibration=mt.calibration_result(final, s.calibration),
        calibration_curve=mt.calibration_curve(final),
        importances=md.feature_importances(base, fitted.index),
        model=calibrated,
        fitted=fitted,
    )


def save_result(result: Result, s: Settings, folder: str, dataset_path: str | None = None, news: DataFrame | None = None) -> dict[str, str]:
    """Everything a run leaves behind, under ``folder``: paths by name.

    ``config`` (the settings, as ``key: value`` lines that ``read_run_configs`` reads), ``fold_metrics`` (one folder per fold),
    ``aggregate_metrics.json`` and ``calibration.json`` (one object each, as ``read_metric_files`` reads them), the tables ``predictions``,
    ``calibration_curve`` and ``feature_importances``, and the model. With ``news`` (a feature table with snapshot hash and
    provenance) also ``news_snapshot_hash`` and ``news_provenance``. An existing folder is an error.
    """
    spark, folder = result.metrics.sparkSession, folder.rstrip("/")
    values = {"target_column": s.target, "dataset_path": dataset_path or "", **{k: v for k, v in vars(s).items() if k not in ("target", "embeddings")}}
    lines = spark.createDataFrame([(f"{key}: {value}",) for key, value in values.items()], "value string")
    paths = {"config": f"{folder}/config.yaml", "model": f"{folder}/model"}
    lines.coalesce(1).write.mode("errorifexists").text(paths["config"])
    paths["fold_metrics"] = tables.write_metric_files(result.fold_metrics, folder)
    wide = result.metrics.groupBy().pivot("metric", mt.METRICS).agg(F.first("value"))
    paths["aggregate_metrics"] = tables.write_one_json(wide, f"{folder}/aggregate_metrics.json")
    paths["calibration"] = tables.write_one_json(result.calibration, f"{folder}/calibration.json")
    kept = {"predictions": result.predictions, "calibration_curve": result.calibration_curve, "feature_importances": result.importances}
    if news is not None:
        kept["news_snapshot_hash"] = op_news.snapshot_hash(news)
        kept["news_provenance"] = op_news.parse_provenance(news).select("event_id", "articles")
    paths |= tables.write_results(kept, folder)
    save_model(result.model, result.fitted, paths["model"])
    return paths


def score_segments(df: DataFrame, fitted: FittedFeatures, model: md.Calibrated, s: Settings) -> DataFrame:
    """``(row_id, event_id, probability)`` of new rows under a trained model."""
    rows = df.select(F.col(s.row_id).alias("row_id"), *dict.fromkeys([s.event, s.text, *s.categorical, *s.numeric]))
    counts = fx.term_counts(rows, "row_id", s.text, s.ngram_range, s.lowercase)
    vectors = transform(rows.withColumnRenamed(s.event, "event_id"), counts, fitted, s, whole=True)
    return model.predict(vectors, "probability").select("row_id", "event_id", "probability")


def save_model(model: md.Calibrated, fitted: FittedFeatures, folder: str) -> None:
    """Feature tables and all fitted models under ``folder``."""
    spark = fitted.index.sparkSession
    folder = folder.rstrip("/")
    fitted.vocabulary.write.parquet(f"{folder}/vocabulary")
    fitted.index.write.parquet(f"{folder}/index")
    if fitted.levels is not None:
        fitted.levels.write.parquet(f"{folder}/levels")
    kind = "gbt" if isinstance(model.pairs[0][0], GBTClassificationModel) else "logistic"
    note = [(model.method, len(model.pairs), fitted.size, fitted.levels is not None, kind)]
    spark.createDataFrame(note, "method string, pairs int, size int, levels boolean, kind string").coalesce(
        1
    ).write.json(f"{folder}/about")
    for i, (base, calibrator) in enumerate(model.pairs):
        base.write().save(f"{folder}/model_{i}")
        if calibrator is not None:
            calibrator.write().save(f"{folder}/calibrator_{i}")


def load_model(spark, folder: str) -> tuple[md.Calibrated, FittedFeatures]:
    """What ``save_model`` wrote."""
    from pyspark.ml.regression import IsotonicRegressionModel

    folder = folder.rstrip("/")
    about = spark.read.json(f"{folder}/about").first()
    base = GBTClassificationModel if about["kind"] == "gbt" else LogisticRegressionModel
    calibrator = {"sigmoid": LogisticRegressionModel, "isotonic": IsotonicRegressionModel}.get(about["method"])
    pairs = [
        (
            base.load(f"{folder}/model_{i}"),
            calibrator.load(f"{folder}/calibrator_{i}") if calibrator else None,
        )
        for i in range(about["pairs"])
    ]
    fitted = FittedFeatures(
        spark.read.parquet(f"{folder}/vocabulary"),
        spark.read.parquet(f"{folder}/levels") if about["levels"] else None,
        spark.read.parquet(f"{folder}/index"),
        int(about["size"]),
    )
    return md.Calibrated(about["method"], pairs), fitted
