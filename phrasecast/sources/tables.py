"""Inventories, modelling tables, manifests and experiment results on disk."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, functions as F, types as T

from phrasecast.operators.metrics import METRICS

_MANIFEST = (
    "version string, generated_at string, num_rows bigint, "
    "validation struct<checks:map<string,boolean>,notes:array<string>>, target_columns map<string,string>"
)


def _suffix(path: str) -> str:
    return PurePosixPath(path.rstrip("/")).suffix.lower()


def _csv(spark: SparkSession, separator: str, multi_line: bool) -> DataFrameReader:
    reader = spark.read.option("header", True).option("sep", separator).option("escape", '"')
    return reader.option("multiLine", multi_line)


def read_inventory(
    spark: SparkSession, path: str, columns: list[str] | None = None, multi_line: bool = True
) -> DataFrame:
    """Inventory rows as text columns: ``.csv`` with header, ``.json`` (one array) or ``.jsonl`` (lines).

    ``columns`` fixes the schema and saves the pass that finds the column names. Without quoted line
    breaks in the CSV, ``multi_line=False`` lets one file be read by many tasks.
    """
    kind = _suffix(path)
    schema = None
    if columns:
        schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    if kind == ".csv":
        reader = _csv(spark, ",", multi_line)
        return (reader.schema(schema) if schema else reader).csv(path)
    if kind in (".json", ".jsonl"):
        reader = spark.read.option("multiLine", kind == ".json").option("primitivesAsString", True)
        return (reader.schema(schema) if schema else reader).json(path)
    raise ValueError(f"unsupported inventory format: {kind or path}")


def read_table(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, multi_line: bool = True
) -> DataFrame:
    """A modelling table from Parquet, CSV or TSV (``multi_line`` as for inventories)."""
    kind = _suffix(path)
    if kind == ".parquet":
        return spark.read.parquet(path)
    if kind in (".csv", ".tsv"):
        reader = _csv(spark, "\t" if kind == ".tsv" else ",", multi_line)
        return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    raise ValueError(f"unsupported table format: {kind or path}")


def _file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def _dataset_key(path: Column) -> Column:
    """Folder and stem of a dataset or of its manifest, which lie side by side."""
    return F.concat_ws("/", _folder(path), _file_stem(path))


def _folder(path: Column) -> Column:
    """The folder of a file; a file written by Spark is itself a folder of parts."""
    return F.regexp_extract(F.regexp_replace(path, r"(\.(?:json|yaml))/part-[^/]*$", "$1"), r"([^/]+)/[^/]+$", 1)


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Manifests matched by ``path``, with stem and key (folder and stem) of the table they describe."""
    reader = spark.read.schema(_MANIFEST).option("multiLine", True)
    where = _json_unit(F.col("_metadata.file_path"))
    found = reader.json(path).withColumns({"dataset_stem": _file_stem(where), "dataset_key": _dataset_key(where)})
    return found


def _json_unit(path: Column) -> Column:
    """A manifest written by Spark is a folder ``<stem>.json/part-…``; use the folder name then."""
    return F.regexp_replace(path, r"/part-[^/]*$", "")


def target_terms(manifests: DataFrame) -> DataFrame:
    """Sorted phrases of the first manifest, by name, that has any."""
    named = manifests.filter(F.size("target_columns") > 0)
    first = named.orderBy("dataset_stem").limit(1)
    return first.select(F.explode(F.map_keys("target_columns")).alias("term")).orderBy("term")


def read_run_configs(spark: SparkSession, pattern: str) -> DataFrame:
    """``(experiment, target_column, dataset_key)`` from top-level scalars of run config files."""
    lines = spark.read.text(pattern).select(
        _folder(F.col("_metadata.file_path")).alias("experiment"),
        F.regexp_extract("value", r"^(\w+):\s*['\"]?(.*?)['\"]?\s*$", 1).alias("key"),
        F.regexp_extract("value", r"^(\w+):\s*['\"]?(.*?)['\"]?\s*$", 2).alias("text"),
    )

    def value(key: str) -> Column:
        return F.max(F.when((F.col("key") == key) & (F.col("text") != ""), F.col("text")))

    return lines.groupBy("experiment").agg(
        value("target_column").alias("target_column"),
        _dataset_key(value("dataset_path")).alias("dataset_key"),
    )


def read_metric_files(spark: SparkSession, pattern: str) -> DataFrame:
    """``(experiment, file, <metrics>)`` of metric JSON files; bare NaN is read, missing keys are NULL."""
    schema = T.StructType([T.StructField(m, T.DoubleType()) for m in METRICS])
    reader = spark.read.schema(schema).option("multiLine", True).option("allowNonNumericNumbers", True)
    try:
        found = reader.json(pattern)
    except AnalysisException:
        return spark.createDataFrame([], T.StructType([
            T.StructField("experiment", T.StringType()), T.StructField("file", T.StringType()), *schema.fields
        ]))
    path = F.col("_metadata.file_path")
    return found.select(_folder(path).alias("experiment"), F.regexp_extract(path, r"([^/]+)$", 1).alias("file"), *METRICS)


def write_segments(rows: DataFrame, folder: str, version: str, by_type: bool = False) -> str:
    """Publish the labelled table as ``segments_<version>.parquet``; an existing version is an error."""
    path = f"{folder.rstrip('/')}/segments_{version}.parquet"
    writer = rows.write.mode("errorifexists")
    (writer.partitionBy("event_type") if by_type else writer).parquet(path)
    return path


def segment_manifest(
    rows: DataFrame, validation: DataFrame, version: str, generated_at: str, targets: dict[str, str]
) -> DataFrame:
    """One row: version, time, number of rows, validation and the phrase -> column map."""
    pairs = [F.lit(x) for pair in targets.items() for x in pair]
    columns = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    checked = validation.select(F.struct("checks", "notes").alias("validation"))
    counted = rows.agg(F.count(F.lit(1)).alias("num_rows"))
    return counted.select(
        F.lit(version).alias("version"),
        F.lit(generated_at).alias("generated_at"),
        "num_rows",
        checked.scalar().alias("validation"),
        columns.alias("target_columns"),
    )


def write_one_json(df: DataFrame, path: str) -> str:
    """A one-row table as one JSON file (the coalesce moves a single row)."""
    df.coalesce(1).write.mode("errorifexists").option("ignoreNullFields", False).json(path)
    return path


def write_results(tables: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """Fold, aggregate, calibration, importance and provenance tables as Parquet, one folder each."""
    paths = {}
    for name, df in tables.items():
        paths[name] = f"{folder.rstrip('/')}/{name}"
        df.write.mode("errorifexists").parquet(paths[name])
    return paths


def write_metric_files(per_fold: DataFrame, folder: str) -> str:
    """Per-fold metrics as JSON lines, partitioned by fold; NaN is written as such."""
    path = f"{folder.rstrip('/')}/fold_metrics"
    per_fold.write.mode("errorifexists").partitionBy("fold").json(path)
    return path
