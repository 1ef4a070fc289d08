"""``article_dump``: folders of JSON lines as a data source of Spark's, with splits and pushed filters.

    spark.dataSource.register(ArticleDump)
    spark.read.format("article_dump").option("columns", "day date").load("/dumps").filter("day >= DATE '2024-01-03'")

Folders named ``column=value`` give the columns listed in ``columns``. Filters that compare such a column with constants are
answered by the source: files outside them are never opened. With ``limit`` each split ends after so many articles, so
little is read before ``load_dump`` cuts the total. Files are found and read by Arrow's file systems (local, HDFS, S3, GCS).
Pushed filters need ``spark.sql.python.filterPushdown.enabled``.
"""

from __future__ import annotations

import datetime
import json
import operator
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan,
    LessThanOrEqual,
)

from phrasecast.operators import news

#: Bytes of a split; longer files are cut, shorter ones share a split.
SPLIT_BYTES = 64 * 1024 * 1024
BATCH_ROWS = 1000
_MISSING = "__HIVE_DEFAULT_PARTITION__"
_TESTS = {
    EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le,
}
_KINDS = {"date": (T.DateType(), datetime.date.fromisoformat), "string": (T.StringType(), str), "int": (T.IntegerType(), int), "bigint": (T.LongType(), int)}
_TEXT = T.StringType()
_ARTICLE = [
    *[T.StructField(name, _TEXT) for name in news.REQUIRED], T.StructField("tags", T.ArrayType(_TEXT)), T.StructField("provenance", _TEXT),
    T.StructField("extras", T.MapType(_TEXT, _TEXT)), T.StructField("file", _TEXT), T.StructField("split_start", T.LongType()),
    T.StructField("line_no", T.LongType()),
]


@dataclass
class Split(InputPartition):
    """Stretches of files: (path, first byte, byte after the last, values of the folder columns)."""

    parts: list[tuple[str, int, int, tuple]]


def _text(value: object) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def article_of(line: bytes) -> tuple | None:
    """The article columns of a line, without its place; None if it is no JSON object."""
    try:
        record = json.loads(line)
    except ValueError:
        return None
    if not isinstance(record, dict):
        return None
    tags = record.get("tags")
    if isinstance(tags, list):
        listed = [_text(t) for t in tags]
    else:
        listed = [_text(tags)] if tags not in (None, "") else []
    core = {*news.REQUIRED, "tags", "provenance"}
    extras = [(k, _text(v)) for k, v in record.items() if k not in core]
    return (*(_text(record.get(n)) for n in news.REQUIRED), listed, _text(record.get("provenance")), extras)


class DumpReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType, columns: list[tuple[str, str]]):
        self.path, self.schema = options["path"], schema
        self.split_bytes = int(options.get("splitbytes", SPLIT_BYTES))
        self.limit = int(options["limit"]) if "limit" in options else None
        self.columns = columns
        self.tests: list[tuple[int, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Take the filters that compare a folder column with constants; leave the others to Spark."""
        names = [name for name, _ in self.columns]
        for f in filters:
            column = getattr(f, "attribute", None)
            if column is None or len(column) != 1 or column[0] not in names:
                yield f
            elif type(f) in _TESTS or isinstance(f, (In, IsNotNull, IsNull)):
                self.tests.append((names.index(column[0]), type(f).__name__, getattr(f, "value", None)))
            else:
                yield f

    def _wanted(self, values: tuple) -> bool:
        compare = {kind.__name__: test for kind, test in _TESTS.items()}
        for i, name, constant in self.tests:
            value = values[i]
            if name == "IsNull":
                if value is not None:
                    return False
            elif value is None or (name == "In" and value not in constant) or (name in compare and not compare[name](value, constant)):
                return False
        return True

    def _folder_values(self, path: str) -> tuple:
        found = dict(part.split("=", 1) for part in path.split("/")[:-1] if "=" in part)
        out = []
        for name, kind in self.columns:
            text = found.get(name, _MISSING)
            out.append(None if text == _MISSING else _KINDS[kind][1](unquote(text)))
        return tuple(out)

    def partitions(self) -> list[Split]:
        splits, held, size = [], [], 0
        for path, length in list_files(self.path):
            values = self._folder_values(path)
            if not self._wanted(values):
                continue
            for start in range(0, length, self.split_bytes):
                end = min(start + self.split_bytes, length)
                if held and size + end - start > self.split_bytes:
                    splits.append(Split(held))
                    held, size = [], 0
                held.append((path, start, end, values))
                size += end - start
        if held:
            splits.append(Split(held))
        return splits or [Split([])]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, rows, left = to_arrow_schema(self.schema), [], self.limit
        for path, start, end, values in partition.parts:
            for offset, line in lines_of(path, start, end):
                if left == 0:
                    break
                article = article_of(line)
                if article is None:
                    continue
                rows.append((*article, path, start, offset, *values))
                left = None if left is None else left - 1
                if len(rows) == BATCH_ROWS:
                    yield _batch(rows, schema)
                    rows = []
        if rows:
            yield _batch(rows, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def list_files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files below a folder, in order; hidden ones and those that start with ``_`` stay out."""
    from pyarrow import fs

    system, root = _file_system(path)
    if system.get_file_info(root).type == fs.FileType.NotFound:
        return []
    found = system.get_file_info(fs.FileSelector(root, recursive=True))
    head = path[: len(path) - len(root)] if path.endswith(root) else ""
    kept = [f for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
    return sorted((head + f.path, f.size) for f in kept)


def lines_of(path: str, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the non-blank lines that begin in ``[start, end)``."""
    system, name = _file_system(path)
    with system.open_input_file(name) as raw:
        at = start
        if start:
            at = start - 1
            raw.seek(at)
        reader = _Lines(raw)
        if start:
            at += len(reader.next())  # the line that began before belongs to the split before
        while at < end:
            line = reader.next()
            if not line:
                return
            if line.strip():
                yield at, line
            at += len(line)


class _Lines:
    """Lines of an open file, read in blocks."""

    def __init__(self, raw: pa.NativeFile):
        self.raw, self.rest, self.at = raw, b"", 0

    def next(self) -> bytes:
        seen = self.at
        while True:
            cut = self.rest.find(b"\n", seen)
            if cut >= 0:
                line, self.at = self.rest[self.at : cut + 1], cut + 1
                return line
            block = self.raw.read(1 << 20)
            if not block:
                line, self.rest, self.at = self.rest[self.at :], b"", 0
                return line
            seen = len(self.rest) - self.at
            self.rest, self.at = self.rest[self.at :] + block, 0


class ArticleDump(DataSource):
    """The data source; options: ``columns`` (types of the folder columns), ``splitbytes``, ``limit``."""

    @classmethod
    def name(cls) -> str:
        return "article_dump"

    def _columns(self) -> list[tuple[str, str]]:
        found = [tuple(part.split()) for part in self.options.get("columns", "").split(",") if part.strip()]
        for column in found:
            if len(column) != 2 or column[1] not in _KINDS:
                raise ValueError(f"no folder column: {' '.join(column)!r}; types are {', '.join(_KINDS)}")
        return found

    def schema(self) -> T.StructType:
        return T.StructType([*_ARTICLE, *[T.StructField(name, _KINDS[kind][0]) for name, kind in self._columns()]])

    def reader(self, schema: T.StructType) -> DumpReader:
        return DumpReader(dict(self.options), schema, self._columns())


def load_dump(
    spark: SparkSession, path: str, since: str | None = None, until: str | None = None, limit: int | None = None, columns: str = "day date",
    day: str | None = "day",
) -> DataFrame:
    """Articles of a dump inside the window, at most ``limit`` in file order; a loader for ``register_source``.

    With a folder column ``day`` (publication day; NULL where the time cannot be read) files outside the window are not opened.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArticleDump)
    reader = spark.read.format("article_dump").option("columns", columns)
    if limit is not None and since is None and until is None:
        reader = reader.option("limit", limit)
    found = reader.load(path)
    if day and (since or until):
        inside = found
        for bound, test in ((since, F.col(day).__ge__), (until, F.col(day).__le__)):
            if bound is not None:
                inside = inside.filter(test(F.lit(bound).cast("timestamp").cast("date")))
        # Loaded anew: the scans of one load share the filters pushed last.
        found = inside.unionByName(reader.load(path).filter(F.col(day).isNull()))
    found = news.within_window(found, since, until)
    if limit is None:
        return found
    return news.first_per_source(found.withColumn("__all", F.lit(0)), limit, "__all").drop("__all")
