"""Article dumps to the per-event feature table."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from phrasecast.operators import news
from phrasecast.session import materialize
from phrasecast.sources import articles as dumps, tables


@dataclass
class NewsTables:
    features: DataFrame
    provenance: DataFrame
    digest: DataFrame


def build_features(spark: SparkSession, folder: str, terms: Sequence[str], output: str | None = None) -> NewsTables:
    """Features of every dump under ``folder``; the deduplicated articles are written once and reused."""
    lines = dumps.read_lines(spark, folder)
    digest = news.corpus_digest(lines)
    parsed = news.record_columns(dumps.parse_lines(lines))
    copies = materialize(news.first_copies(news.measure_articles(parsed, terms)), "articles")
    features = news.with_snapshot(news.event_features(copies, terms), digest)
    provenance = news.provenance_json(news.provenance_rows(copies))
    if output is not None:
        dumps.write_features(features, f"{output.rstrip('/')}/features")
        provenance.write.mode("errorifexists").parquet(f"{output.rstrip('/')}/provenance")
    return NewsTables(features, provenance, digest)


@dataclass
class IngestRun:
    """What an ingest did: articles per source as a one-row manifest, and the paths it wrote (none on a dry run)."""

    manifest: DataFrame
    articles_path: str | None
    manifest_path: str | None


def run_ingest(
    spark: SparkSession,
    sources: Iterable[dumps.Source],
    folder: str,
    run_id: str,
    generated_at: str,
    since: str | None = None,
    until: str | None = None,
    limit: int | None = None,
    dry_run: bool = False,
) -> IngestRun:
    """Load and normalise all enabled sources, write their articles under ``<folder>/raw`` and a manifest under ``<folder>/manifests``.

    Every enabled source stands in the manifest, with 0 if it brought nothing; only sources with articles have an output.
    The totals of a real run count what was written, so the sources are read once. A dry run reads and counts the same
    articles and writes nothing under ``folder``. Existing runs are never overwritten.
    """
    enabled = [source for source in sources if source.enabled]
    found = dumps.ingest(spark, enabled, generated_at, since, until, limit)
    named = spark.createDataFrame([(source.name,) for source in enabled], "ingest_source string")
    if dry_run:
        return IngestRun(dumps.ingest_manifest(found, run_id, generated_at, [], since, until, True, named), None, None)
    folder = folder.rstrip("/")
    path = dumps.write_articles(found, f"{folder}/raw", run_id)
    written = spark.read.schema("value string, ingest_source string").text(path)
    brought = written.select("ingest_source").distinct().orderBy("ingest_source").collect()  # one row per source
    outputs = [f"{path}/ingest_source={row['ingest_source']}" for row in brought]
    manifest = dumps.ingest_manifest(written, run_id, generated_at, outputs, since, until, False, named)
    place = tables.write_one_json(manifest, f"{folder}/manifests/{run_id}_manifest.json")
    return IngestRun(dumps.read_ingest_manifest(spark, place), path, place)
