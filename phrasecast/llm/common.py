"""Shared expressions and table access of the training-data operators."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from phrasecast.session import materialize

#: Words are maximal runs of anything but ASCII white space; Python's ``bytes.split()`` cuts at the same bytes.
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Texts that go to Python at once.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BLANKS = " \t\n\x0b\x0c\r"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that their Python workers can import it.

    The archive is made in a folder of the driver; Spark itself carries it to the executors.
    """
    context = spark.sparkContext
    if getattr(context, "_phrasecast_shipped", False):
        return
    root = Path(__file__).resolve().parents[2]
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='phrasecast-code-')}/phrasecast", "zip", root, "phrasecast")
    context.addPyFile(archive)
    context._phrasecast_shipped = True


def small_batches(spark: SparkSession) -> None:
    """At most ``BATCH_ROWS`` rows in a batch for Python from now on in this session.

    A batch of whole texts stands several times in memory: in the JVM, on its way, and as Python strings.
    """
    if int(spark.conf.get(_BATCH, "10000")) > BATCH_ROWS or int(spark.conf.get(_BATCH, "10000")) <= 0:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def split_unnamed(docs: DataFrame, id_col: str, first: int) -> tuple[DataFrame, DataFrame]:
    """The rows with an id, and those without one, written once, with a number of their own from ``first`` on in ``__row``.

    A null names no document, so each of these rows is one.
    """
    named, unnamed = docs.filter(F.col(id_col).isNotNull()), docs.filter(F.col(id_col).isNull())
    return named, materialize(unnamed.withColumn("__row", F.lit(first) + F.monotonically_increasing_id()), "unnamed")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often the body uses it."""
    return F.transform(F.array(value), body).getItem(0)


def words(text: Column) -> Column:
    """The words of a text as an array; empty for null or blank text."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(_BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, GAP))


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def blank_free(text: Column) -> Column:
    return without(text, _BLANKS)


def crc_remainder(column: str, modulus: int) -> Column:
    """crc32 of an id written as text, modulo a number; null ids count as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))
