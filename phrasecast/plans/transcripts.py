"""Page text to the published segment table."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from phrasecast.operators import label, segment
from phrasecast.operators.inventory import project_inventory, require_unique_ids
from phrasecast.session import materialize
from phrasecast.sources import tables


def labelled_segments(
    pages: DataFrame,
    inventory: DataFrame,
    terms: Sequence[str],
    mode: str = "speaker_turn",
    window: int = 200,
    stride: int | None = None,
    include: Iterable[str] | None = None,
    exclude: Iterable[str] | None = None,
) -> DataFrame:
    """Raw pages and a projected inventory to labelled segments.

    Clean pages are written once, because the segment operators read them several times.
    """
    clean = materialize(segment.clean_pages(pages), "clean-pages")
    return label.build_rows(segment.segment(clean, mode, window, stride), inventory, terms, include, exclude)


@dataclass
class Published:
    path: str
    manifest: str
    rows: DataFrame


def publish(
    pages: DataFrame,
    raw_inventory: DataFrame,
    terms: Sequence[str],
    folder: str,
    version: str,
    generated_at: str,
    mode: str = "speaker_turn",
    window: int = 200,
    stride: int | None = None,
    include: Iterable[str] | None = None,
    exclude: Iterable[str] | None = None,
) -> Published:
    """Clean, segment, label, write the table, check it, write the manifest."""
    inventory = require_unique_ids(project_inventory(raw_inventory))
    rows = labelled_segments(pages, inventory, terms, mode, window, stride, include, exclude)
    path = tables.write_segments(rows, folder, version)
    written = rows.sparkSession.read.parquet(path)
    manifest = tables.segment_manifest(
        written, label.validate_segments(written), version, generated_at, label.target_map(terms)
    )
    where = tables.write_one_json(manifest, f"{folder.rstrip('/')}/segments_{version}.json")
    return Published(path, where, written)
