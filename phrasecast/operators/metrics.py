"""Probability metrics of all folds in grouped queries over ``(fold, y, p)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from phrasecast.functions.scan import prefix_sums

METRICS = ["log_loss", "brier", "roc_auc", "average_precision", "f1", "precision", "recall", "accuracy"]
EPSILON = 2.220446049250313e-16  # double precision, the clip of the log loss


def log_loss(y: Column, p: Column) -> Column:
    safe = F.least(F.greatest(p, F.lit(EPSILON)), F.lit(1 - EPSILON))
    return F.avg(F.when(y == 1, -F.log(safe)).otherwise(-F.log(1 - safe)))


def brier(y: Column, p: Column) -> Column:
    return F.avg((p - y) * (p - y))


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def point_metrics(predictions: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per fold: log loss, Brier score and the metrics at a threshold (0 where undefined)."""
    y, p = F.col("y"), F.col("p")
    said = p >= threshold
    sums = predictions.groupBy("fold").agg(
        log_loss(y, p).alias("log_loss"),
        brier(y, p).alias("brier"),
        F.count_if(said & (y == 1)).alias("tp"),
        F.count_if(said & (y == 0)).alias("fp"),
        F.count_if(~said & (y == 1)).alias("fn"),
        F.count(F.lit(1)).alias("n"),
    )
    tp, fp, fn, n = (F.col(c) for c in ("tp", "fp", "fn", "n"))
    return sums.select(
        "fold",
        "log_loss",
        "brier",
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        ((n - fp - fn) / n).alias("accuracy"),
    )


def ranking_metrics(predictions: DataFrame) -> DataFrame:
    """Per fold: ROC AUC (ties count half, NaN with one class) and average precision.

    Rows are first counted per distinct score; running counts over the scores go through two levels of
    score ranges, so one huge fold is no single task.
    """
    scores = predictions.groupBy("fold", "p").agg(
        F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg")
    )
    blocks = {"coarse": F.floor(F.col("p") * 1024), "fine": F.floor(F.col("p") * 1048576)}
    run = prefix_sums(
        scores, ["fold"], blocks, ["p"], {"pos_below": F.col("pos"), "neg_below": F.col("neg")}, totals=True
    )
    all_pos, all_neg = F.col("pos_below_total"), F.col("neg_below_total")
    tp, fp = all_pos - F.col("pos_below"), all_neg - F.col("neg_below")
    wins = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2))
    area = F.sum(F.col("pos") * tp / (tp + fp))
    pos, neg = F.first("pos_below_total"), F.first("neg_below_total")
    return run.groupBy("fold").agg(
        F.when((pos > 0) & (neg > 0), wins / (pos.cast("double") * neg)).otherwise(F.lit(float("nan"))).alias("roc_auc"),
        F.when(pos > 0, area / pos).otherwise(F.lit(0.0)).alias("average_precision"),
    )


def classification_metrics(predictions: DataFrame) -> DataFrame:
    """One row per fold with all metrics."""
    return point_metrics(predictions).join(ranking_metrics(predictions), "fold").select("fold", *METRICS)


def long_metrics(per_fold: DataFrame) -> DataFrame:
    return per_fold.unpivot(["fold"], METRICS, "metric", "value")


def mean_over_folds(metrics: DataFrame) -> DataFrame:
    """Plain mean of every metric over ``(fold, metric, value)``; NaN spreads."""
    return metrics.groupBy("metric").agg(F.avg("value").alias("value"))


def fold_summary(metrics: DataFrame) -> DataFrame:
    """Mean, minimum and maximum per metric; missing and NaN values are skipped."""
    value = F.when(~F.isnan("value"), F.col("value"))
    return metrics.groupBy("metric").agg(
        F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max")
    )


def calibration_curve(predictions: DataFrame, bins: int = 10) -> DataFrame:
    """Equal-width bins on [0, 1], upper edges inclusive; empty bins do not appear."""
    step = 1.0 / bins
    place = sum(((F.col("p") > F.lit(i * step)).cast("int") for i in range(1, bins)), F.lit(0))
    return predictions.groupBy(place.alias("bin")).agg(
        F.avg("p").alias("mean_predicted_value"),
        F.avg(F.col("y").cast("double")).alias("fraction_of_positives"),
        F.count(F.lit(1)).alias("rows"),
    )


def calibration_result(predictions: DataFrame, method: str) -> DataFrame:
    """One row: method, Brier score and log loss of all predictions."""
    y, p = F.col("y"), F.col("p")
    return predictions.agg(brier(y, p).alias("brier"), log_loss(y, p).alias("log_loss")).select(
        F.lit(method).alias("method"), "brier", "log_loss"
    )
