"""Estimators, calibration, importances, and event scoring on vectors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.ml.classification import (
    GBTClassificationModel, GBTClassifier, LogisticRegression, LogisticRegressionModel,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, functions as F

from phrasecast.operators.folds import stratified_parts
from phrasecast.session import materialize

# Defaults of the two estimators.
LOGISTIC_DEFAULTS = {"C": 1.0, "max_iter": 1000, "class_weight": "balanced"}
BOOSTING_DEFAULTS = {"learning_rate": 0.05, "n_estimators": 200, "subsample": 0.8, "max_depth": 3, "seed": 42}


def class_counts(rows: DataFrame, label: str = "label") -> dict[int, int]:
    return {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}


def class_weights(counts: dict[int, int]) -> dict[int, float]:
    """Balanced weights ``n / (classes * n_class)``."""
    n = sum(counts.values())
    return {c: n / (len(counts) * k) for c, k in counts.items()}


def fit_model(rows: DataFrame, kind: str = "logistic_regression", **params) -> Model:
    """Fit on ``(features, label)``. The logistic penalty is scaled to the sum of row weights."""
    if kind == "logistic_regression":
        settings = {**LOGISTIC_DEFAULTS, **params}
        counts = class_counts(rows)
        if settings["class_weight"] not in ("balanced", None):
            raise ValueError("class_weight must be balanced or None")
        weights = class_weights(counts) if settings["class_weight"] else dict.fromkeys(counts, 1.0)
        weight = F.lit(None).cast("double")
        for value, w in weights.items():
            weight = F.when(F.col("label") == value, F.lit(w)).otherwise(weight)
        total = sum(weights[c] * n for c, n in counts.items())
        return LogisticRegression(
            featuresCol="features", labelCol="label", weightCol="weight", elasticNetParam=0.0,
            regParam=1.0 / (settings["C"] * total), standardization=False, maxIter=settings["max_iter"],
        ).fit(rows.withColumn("weight", weight))
    if kind == "gradient_boosting":
        settings = {**BOOSTING_DEFAULTS, **params}
        return GBTClassifier(
            featuresCol="features", labelCol="label", stepSize=settings["learning_rate"],
            maxIter=settings["n_estimators"], subsamplingRate=settings["subsample"],
            maxDepth=settings["max_depth"], seed=settings["seed"],
        ).fit(rows)
    raise ValueError(f"unsupported model type: {kind}")


def score(model: Model, rows: DataFrame) -> DataFrame:
    """Add ``p`` (probability of class 1) and ``margin`` (raw score of class 1)."""
    out = model.transform(rows)
    out = out.withColumn("p", vector_to_array("probability")[1])
    return out.withColumn("margin", vector_to_array("rawPrediction")[1]).drop(
        "probability", "rawPrediction", "prediction"
    )


def fit_sigmoid(scored: DataFrame) -> LogisticRegressionModel:
    """Platt scaling of ``margin``: unpenalised fit to the smoothed targets.

    A soft target t is one row of class 1 with weight t and one of class 0 with weight 1 - t; equal
    margins are counted first.
    """
    n = scored.agg(F.sum("label").alias("pos"), F.count(F.lit(1)).alias("n")).first()
    high = (n["pos"] + 1.0) / (n["pos"] + 2.0)
    low = 1.0 / (n["n"] - n["pos"] + 2.0)
    target = F.when(F.col("label") == 1, F.lit(high)).otherwise(F.lit(low))
    sides = F.array(
        F.struct(F.lit(1.0).alias("y"), target.alias("w")), F.struct(F.lit(0.0).alias("y"), (1 - target).alias("w"))
    )
    soft = scored.select("margin", F.explode(sides).alias("s")).groupBy("margin", F.col("s.y").alias("y"))
    soft = soft.agg(F.sum("s.w").alias("w")).withColumn("x", array_to_vector(F.array("margin")))
    return LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", regParam=0.0, maxIter=200).fit(soft)


def fit_isotonic(scored: DataFrame):
    """Isotonic fit of label on ``margin``; equal margins are pooled before the fit."""
    pooled = scored.groupBy("margin").agg(
        F.avg(F.col("label").cast("double")).alias("y"), F.count(F.lit(1)).cast("double").alias("w")
    )
    return IsotonicRegression(featuresCol="margin", labelCol="y", weightCol="w").fit(pooled)


@dataclass
class Calibrated:
    """The mean of several (model, calibrator) pairs; ``method`` none means one bare model."""

    method: str
    pairs: list

    def predict(self, rows: DataFrame, name: str = "p") -> DataFrame:
        """Add the calibrated probability as ``name``."""
        columns = rows.columns
        out, parts = rows, []
        for i, (model, calibrator) in enumerate(self.pairs):
            out = score(model, out).withColumnRenamed("p", f"__p{i}")
            if self.method == "sigmoid":
                out = out.withColumn("x", array_to_vector(F.array("margin")))
                out = calibrator.transform(out).withColumn(f"__p{i}", vector_to_array("probability")[1])
                out = out.drop("x", "probability", "rawPrediction", "prediction")
            elif self.method == "isotonic":
                out = calibrator.transform(out).withColumn(f"__p{i}", F.col("prediction")).drop("prediction")
            out = out.drop("margin")
            parts.append(F.col(f"__p{i}"))
        mean: Column = parts[0]
        for part in parts[1:]:
            mean = mean + part
        return out.withColumn(name, mean / len(parts)).select(*columns, name)


def calibrate(
    rows: DataFrame, kind: str, method: str = "isotonic", cv: int = 3, row_id: str = "row_id", **params
) -> Calibrated:
    """Fit ``cv`` models on stratified parts, calibrate each on its held-out part."""
    if method not in ("none", "sigmoid", "isotonic"):
        raise ValueError(f"unsupported calibration method: {method}")
    if method == "none":
        return Calibrated(method, [(fit_model(rows, kind, **params), None)])
    parts = stratified_parts(rows.select(row_id, "label"), cv, "label", row_id).select(row_id, "part")
    split = materialize(rows.join(parts, row_id), "calibration-parts")
    fit = fit_sigmoid if method == "sigmoid" else fit_isotonic
    pairs = []
    for part in range(cv):
        model = fit_model(split.filter(F.col("part") != part), kind, **params)
        pairs.append((model, fit(score(model, split.filter(F.col("part") == part)))))
    return Calibrated(method, pairs)


def feature_importances(model: Model, index: DataFrame) -> DataFrame:
    """``(feature, importance)``: coefficients or tree importances with their names.

    The model already holds one number per feature on the driver; names are joined on Spark.
    """
    if isinstance(model, LogisticRegressionModel):
        values = model.coefficients.toArray()
    elif isinstance(model, GBTClassificationModel):
        values = model.featureImportances.toArray()
    else:
        raise TypeError(f"no importances for {type(model).__name__}")
    rows = [(i, float(v)) for i, v in enumerate(values)]
    table = index.sparkSession.createDataFrame(rows, "index bigint, importance double")
    return index.join(table, "index").select("feature", "importance")
