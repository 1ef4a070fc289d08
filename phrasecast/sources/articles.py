"""Article dumps: scan, pluggable sources, ingest, JSON-lines sink and run manifest."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from phrasecast.functions.text import is_blank
from phrasecast.operators import news

_LINES = "file string, split_start bigint, line_no bigint, line string"


def read_lines(spark: SparkSession, path: str | list[str], glob: str = "*.{jsonl,json,txt}") -> DataFrame:
    """Non-blank lines under ``path`` with their place: file, split of the file, line in the split.

    Places of one file sort as its lines do. A missing path gives no rows.
    """
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    try:
        lines = reader.text(path)
    except AnalysisException:
        return spark.createDataFrame([], _LINES)
    return lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split_start"),
        F.monotonically_increasing_id().alias("line_no"),
        F.col("value").alias("line"),
    ).filter(~is_blank(F.col("line")))


def parse_lines(lines: DataFrame) -> DataFrame:
    """Add ``record``: all top-level fields as text, NULL where the line is no JSON object."""
    return lines.withColumn("record", F.from_json("line", "map<string,string>"))


def read_articles(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Article columns of all lines that parse (see ``bad_lines`` for the others)."""
    return news.record_columns(parse_lines(read_lines(spark, path)))


def bad_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Quarantine: lines that are no JSON object."""
    return parse_lines(read_lines(spark, path)).filter(F.col("record").isNull()).drop("record")


def load_jsonl(
    spark: SparkSession, path: str, since: str | None = None, until: str | None = None, limit: int | None = None
) -> DataFrame:
    """Articles of a dump inside the window, at most ``limit`` in file order."""
    found = news.within_window(read_articles(spark, path), since, until)
    if limit is None:
        return found
    marked = found.withColumn("__all", F.lit(0))
    return news.first_per_source(marked, limit, "__all").drop("__all")


_LOADERS: dict[str, Callable[..., DataFrame]] = {"jsonl": load_jsonl}


def register_source(name: str, loader: Callable[..., DataFrame]) -> None:
    """Make ``loader(spark, **params)`` available to sources; it returns article columns."""
    if not callable(loader):
        raise TypeError(f"loader {name!r} is not callable")
    _LOADERS[name] = loader


@dataclass
class Source:
    name: str
    loader: str = "jsonl"
    params: dict = field(default_factory=dict)
    enabled: bool = True


def ingest(
    spark: SparkSession,
    sources: Iterable[Source],
    ingested_at: str,
    since: str | None = None,
    until: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Normalised articles of all enabled sources; window and limit apply per source."""
    out = None
    for source in sources:
        if not source.enabled:
            continue
        asked = {k: v for k, v in {"since": since, "until": until, "limit": limit}.items() if v is not None}
        loaded = _LOADERS[source.loader](spark, **{**asked, **source.params})
        if not isinstance(loaded, DataFrame):
            raise TypeError(f"loader {source.loader!r} returned {type(loaded).__name__}, not a DataFrame")
        part = news.normalise_articles(loaded, source.name, ingested_at)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no enabled source")
    return out


def article_lines(articles: DataFrame) -> DataFrame:
    """``(ingest_source, value)``: one flat JSON object per article, extras beside the core fields."""
    core = F.to_json(F.struct(*news.REQUIRED, "tags", "provenance"))
    more = F.to_json("extras")
    flat = F.when(
        F.size("extras") > 0, F.concat(F.left(core, F.char_length(core) - 1), F.lit(","), F.substr(more, F.lit(2)))
    ).otherwise(core)
    return articles.select("ingest_source", flat.alias("value"))


def write_articles(articles: DataFrame, folder: str, run_id: str) -> str:
    """JSON lines under ``<folder>/<run_id>/ingest_source=<name>/``."""
    path = f"{folder.rstrip('/')}/{run_id}"
    article_lines(articles).write.mode("errorifexists").partitionBy("ingest_source").text(path)
    return path


def write_dated(lines: DataFrame, path: str) -> str:
    """Lines ``(day, ingest_source, value)`` under ``<path>/day=<day>/ingest_source=<name>/``.

    Each task writes a range of folders, so a folder has a file for each task it is cut over, not for each task of the
    input; one with many lines (those without a day) is cut over several.
    """
    dealt = lines.repartitionByRange("day", "ingest_source", F.xxhash64("value"))
    dealt.write.mode("errorifexists").partitionBy("day", "ingest_source").text(path)
    return path


def ingest_manifest(
    articles: DataFrame,
    run_id: str,
    generated_at: str,
    outputs: list[str],
    since: str | None = None,
    until: str | None = None,
    dry_run: bool = False,
    sources: DataFrame | None = None,
) -> DataFrame:
    """One row: run, window, articles per source, outputs. ``sources`` (a table ``ingest_source``) adds those without articles."""
    totals = news.totals_per_source(articles, sources).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("ingest_source", "articles")))).alias("totals")
    )
    return totals.select(
        F.lit(run_id).alias("run_id"),
        F.lit(generated_at).alias("generated_at"),
        F.lit(dry_run).alias("dry_run"),
        F.struct(F.lit(since).cast("string").alias("since"), F.lit(until).cast("string").alias("until")).alias("window"),
        "totals",
        F.array(*[F.lit(o) for o in outputs]).cast("array<string>").alias("outputs"),
    )


def read_ingest_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifests written by an ingest run."""
    return spark.read.schema(
        "run_id string, generated_at string, dry_run boolean, window struct<since:string,until:string>, "
        "totals map<string,bigint>, outputs array<string>"
    ).json(path)


def write_features(features: DataFrame, path: str) -> str:
    """The per-event feature table; an empty one keeps its schema."""
    features.write.mode("errorifexists").parquet(path)
    return path
