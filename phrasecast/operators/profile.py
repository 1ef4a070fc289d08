"""Dataset profile and the comparison of experiment runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from phrasecast.functions.numbers import clean_metric, format_percent, format_score
from phrasecast.functions.phrases import humanise_slug

SCORES = ["log_loss", "brier", "accuracy", "average_precision"]


def dataset_profile(df: DataFrame) -> DataFrame:
    """One row per column: rows of the table, type and missing values, from one pass."""
    spark = df.sparkSession
    missing = {
        f.name: F.count_if(F.col(f"`{f.name}`").isNull() | F.isnan(F.col(f"`{f.name}`")))
        if f.dataType.typeName() in ("double", "float")
        else F.count_if(F.col(f"`{f.name}`").isNull())
        for f in df.schema.fields
    }
    counted = df.agg(F.count(F.lit(1)).alias("__rows"), *[c.alias(n) for n, c in missing.items()])
    long = counted.unpivot(["__rows"], [F.col(f"`{n}`") for n in missing], "column", "missing")
    kinds = spark.createDataFrame(
        [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)],
        "position int, column string, type string",
    )
    return long.join(F.broadcast(kinds), "column").select(
        F.col("__rows").alias("rows"), "position", "column", "type", "missing"
    ).orderBy("position")


def run_table(configs: DataFrame, metrics: DataFrame, manifests: DataFrame) -> DataFrame:
    """One row per run that has a config and metrics, with its manifest and phrase where known.

    ``configs(experiment, target_column, dataset_key)``, ``metrics(experiment, <scores as text>)``,
    ``manifests(dataset_key, version, generated_at, num_rows, target_columns map)``.
    """
    runs = configs.join(metrics, "experiment").join(manifests, "dataset_key", "left")
    column = F.col("target_column")
    labels = F.map_filter("target_columns", lambda _, c: c == column)
    label = F.element_at(F.array_sort(F.map_keys(labels)), 1)
    named = F.when(F.size(labels) > 0, label)
    return runs.select(
        humanise_slug(column, named).alias("phrase"),
        "experiment",
        "target_column",
        F.col("version").alias("dataset_version"),
        "generated_at",
        "num_rows",
        *[clean_metric(F.col(s)).alias(s) for s in SCORES],
    ).orderBy(F.lower("phrase"), "experiment")


def runs_with_accuracy(runs: DataFrame) -> DataFrame:
    """The rows behind the accuracy chart, by phrase and run."""
    return runs.filter(F.col("accuracy").isNotNull()).orderBy("phrase", "experiment")


def comparison_table(runs: DataFrame) -> DataFrame:
    """Display form: percentages, scores with three decimals, dashes for missing values."""
    dash = F.lit("—")
    return runs.select(
        "phrase",
        "experiment",
        F.coalesce(F.when(F.col("dataset_version") != "", F.col("dataset_version")), dash).alias("dataset_version"),
        F.coalesce(F.when(F.col("generated_at") != "", F.col("generated_at")), dash).alias("generated_at"),
        F.coalesce(F.col("num_rows").cast("string"), dash).alias("num_rows"),
        format_percent(F.col("accuracy")).alias("accuracy"),
        format_percent(F.col("average_precision")).alias("average_precision"),
        format_score(F.col("log_loss")).alias("log_loss"),
        format_score(F.col("brier")).alias("brier"),
    )
