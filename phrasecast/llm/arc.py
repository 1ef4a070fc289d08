"""Legacy web archives: ARC files are read by their declared lengths and rewritten as WARC records.

An ARC file opens with a version block that names the fields of its record lines: five in version 1, ten in version 2.
The converter synthesises what ARC lacks: record identifiers, ISO timestamps, record types and payload digests.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
from collections.abc import Iterator
from typing import Any, BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from phrasecast.llm.common import ship
from phrasecast.session import materialize, scratch_path

#: The field lines of the two versions.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
_LINE_ENDS = {1: r" (\S+) (\d{8,14}) (\S+) (\d+)$", 2: r" (\S+) (\d{8,14}) (\S+) (\S+) (\S+) (\S+) (\S+) (\S+) (\d+)$"}
_HEADER = {v: re.compile(r"^(\S+.*)" + end) for v, end in _LINE_ENDS.items()}
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
MIN_REVISIT = 1000


# --- ARC ---------------------------------------------------------------------------------------------------------


def write_arc(pages: DataFrame, folder: str, version: int = 1, date: str = "20000101000000") -> None:
    """Write ``page_id, url, html`` as gzipped ARC files, one per partition, each behind its version block.

    The page id travels in a response header. Null urls become ``unknown:``, blanks in urls are escaped, null html is
    empty.
    """

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started = False
        for batch in batches:
            out = []
            for page, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not started:
                    out.append(_version_block(version, date))
                    started = True
                payload = (html or "").encode()
                mark = b"" if page is None else b"X-Page-Id: %d\r\n" % page
                head = b"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n%s\r\n"
                block = head % (len(payload), mark) + payload
                address = re.sub(r"\s", lambda m: "%%%02X" % ord(m[0]), url or "unknown:")
                fields = f"{address} 0.0.0.0 {date} text/html"
                if version == 2:
                    fields += " 200 - - 0 pages.arc"
                out.append(f"{fields} {len(block)}\n".encode() + block)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    ship(pages.sparkSession)
    rows = pages.select("page_id", "url", "html").mapInArrow(lines, "value binary")
    rows.select(F.col("value").cast("string")).write.option("compression", "gzip").option("lineSep", "\n").text(folder)


def _version_block(version: int, date: str) -> bytes:
    body = f"{version} 0 phrasecast\n{FIELDS[version]}\n".encode()
    tail = "200 - - 0 pages.arc " if version == 2 else ""
    return f"filedesc://pages.arc 0.0.0.0 {date} text/plain {tail}{len(body)}\n".encode() + body


def parse_arc(stream: BinaryIO) -> Iterator[dict[str, Any]]:
    """Records of one ARC file: url, date, mime type, block, and ``whole`` (the declared length was there).

    The version block decides how later lines are read; without one, both forms are tried. Blank lines between records
    are skipped, and a line that is no header is passed over until the next one that is.
    """
    version = None
    while line := stream.readline():
        text = line.rstrip(b"\r\n").decode("utf-8", "replace")
        if not text.strip():
            continue
        found = None
        for v in (version,) if version else (2, 1):
            if found := _HEADER[v].match(text):
                break
        if not found:
            continue
        parts = found.groups()
        block = stream.read(int(parts[-1]))
        if parts[0].startswith("filedesc:"):
            version = 2 if block[:1] == b"2" else 1
        yield {"url": parts[0], "date": parts[2], "mime": parts[3], "block": block, "whole": len(block) == int(parts[-1])}


def _head_and_body(block: bytes) -> tuple[bytes, bytes]:
    """An HTTP message's head (with its blank line) and body; a block that is none is all body."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    cut = block.find(b"\r\n\r\n")
    return (block[: cut + 4], block[cut + 4 :]) if cut >= 0 else (block, b"")


def _field(head: bytes, name: bytes) -> str | None:
    found = re.search(rb"(?im)^" + re.escape(name) + rb":[ \t]*(.*?)\r?$", head)
    return found[1].decode("utf-8", "replace") if found else None


def _open(content: bytes) -> BinaryIO:
    raw = io.BytesIO(content)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20) if content[:2] == b"\x1f\x8b" else raw  # type: ignore[return-value]


def _files(spark: SparkSession, folder: str) -> DataFrame:
    ship(spark)
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")


_RECORD = "url string, date string, mime string, kind string, whole boolean, page_id long, head binary, digest string, bytes long, payload binary"


def read_arc(spark: SparkSession, folder: str, payloads: bool = True, batch_bytes: int = 4 << 20) -> DataFrame:
    """Records of all ARC files of a folder; ``kind`` is the WARC type that they will have.

    Archives are one task each, as usual for gzipped ones, and are unpacked record by record. Without ``payloads`` that
    column is null (its length and digest are there).
    """
    schema = pa.schema([
        ("url", pa.string()), ("date", pa.string()), ("mime", pa.string()), ("kind", pa.string()), ("whole", pa.bool_()),
        ("page_id", pa.int64()), ("head", pa.binary()), ("digest", pa.string()), ("bytes", pa.int64()), ("payload", pa.binary()),
    ])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for r in parse_arc(_open(content.as_py())):
                    head, body = _head_and_body(r.pop("block"))
                    page = _field(head, b"X-Page-Id")
                    kind = "warcinfo" if r["url"].startswith("filedesc:") else "response" if head or r["url"].startswith("dns:") else "resource"
                    rows.append(r | {
                        "kind": kind, "page_id": int(page) if page and re.fullmatch(r"-?\d+", page) else None, "head": head,
                        "digest": hashlib.sha1(body).hexdigest(), "bytes": len(body), "payload": body if payloads else None,
                    })
                    held += len(body) if payloads else 200
                    if held >= batch_bytes:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return _files(spark, folder).mapInArrow(records, _RECORD)


# --- WARC --------------------------------------------------------------------------------------------------------


def _record_id(page: Column, url: Column, digest: Column) -> Column:
    """An identifier that the same record gets on every run."""
    seed = F.md5(F.concat_ws("|", F.coalesce(page.cast("string"), url), digest).cast("binary"))
    return F.regexp_replace(seed, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>")


def iso_date(date: Column) -> Column:
    """``YYYYMMDD[hh[mm[ss]]]`` as WARC writes it; what is missing is the first moment of the day or hour."""
    full = F.rpad(date, 14, "0")
    return F.regexp_replace(full, r"^(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)$", "$1-$2-$3T$4:$5:$6Z")


def revisits(records: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """Of payloads held by several pages: digest, length and the largest page id, whose record keeps the payload."""
    large = records.filter((F.col("kind") == "response") & (F.col("bytes") >= min_bytes))
    groups = large.groupBy("digest", "bytes").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n"))
    return groups.filter((F.col("n") > 1) & F.col("keeper").isNotNull()).select("digest", "bytes", "keeper")


def convert(spark: SparkSession, arc_folder: str, warc_folder: str, min_bytes: int = MIN_REVISIT) -> None:
    """Write the records of ARC files as gzipped WARC files.

    Equal payloads of at least ``min_bytes`` are kept once, under the largest page id; the others become revisit
    records. Two passes over the archives: lengths and digests first, then the records. The list of shared payloads is
    a written table, so Spark knows its size when it chooses the join, and AQE splits a digest that is hot.
    """
    shared = materialize(revisits(read_arc(spark, arc_folder, payloads=False), min_bytes), "revisits")
    rows = read_arc(spark, arc_folder).join(shared, ["digest", "bytes"], "left")
    again = (F.col("kind") == "response") & F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    rows = rows.withColumn("type", F.when(again, "revisit").otherwise(F.col("kind")))
    block = F.when(again, F.col("head")).otherwise(F.concat("head", "payload"))
    mime = (
        F.when(F.col("type") == "warcinfo", "application/warc-fields")
        .when(F.length("head") > 0, "application/http; msgtype=response").otherwise(F.col("mime"))
    )
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    rows = rows.withColumn("block", block)
    refers = F.concat(
        field("WARC-Refers-To", _record_id(F.col("keeper"), F.lit(""), F.col("digest"))),
        field("X-Refers-To-Page-Id", F.col("keeper").cast("string")), field("WARC-Profile", F.lit(PROFILE)),
    )
    head = F.concat(
        F.lit("WARC/1.0\r\n"), field("WARC-Type", F.col("type")), field("WARC-Target-URI", F.col("url")),
        field("WARC-Date", iso_date(F.col("date"))), field("WARC-Record-ID", _record_id(F.col("page_id"), F.col("url"), F.col("digest"))),
        F.when(again, refers).otherwise(F.lit("")),
        F.when(F.col("whole"), F.lit("")).otherwise(F.lit("WARC-Truncated: length\r\n")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), field("Content-Type", mime),
        field("Content-Length", F.length("block").cast("string")), F.lit("\r\n"),
    )
    value = F.concat(head.cast("binary"), F.col("block")).cast("string")
    rows.select(value.alias("value")).write.option("compression", "gzip").option("lineSep", "\r\n\r\n").text(warc_folder)


def parse_warc(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        fields = {}
        while (line := stream.readline()) and line.strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        yield fields, stream.read(int(fields["content-length"]))


def read_warc(spark: SparkSession, folder: str, batch_bytes: int = 4 << 20) -> DataFrame:
    """Records of WARC files: type, ids, page ids, head, and payload with its length and digest.

    A revisit record has no payload of its own: length and digest are those it declares.
    """
    schema = pa.schema([
        ("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("date", pa.string()),
        ("page_id", pa.int64()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()),
    ])
    spec = (
        "record_id string, record_type string, url string, date string, page_id long, refers_to long, payload_bytes long, "
        "payload_digest string, payload binary"
    )

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for fields, block in parse_warc(_open(content.as_py())):
                    head, body = _head_and_body(block)
                    page, kind = _field(head, b"X-Page-Id"), fields["warc-type"]
                    own = kind != "revisit"
                    rows.append({
                        "record_id": fields.get("warc-record-id"), "record_type": kind, "url": fields.get("warc-target-uri"),
                        "date": fields.get("warc-date"), "page_id": int(page) if page else None,
                        "refers_to": int(fields["x-refers-to-page-id"]) if not own else None,
                        "payload_bytes": len(body) if own else int(_field(head, b"Content-Length") or 0),
                        "payload_digest": hashlib.sha1(body).hexdigest() if own else fields["warc-payload-digest"].split(":")[1],
                        "payload": body if own else None,
                    })
                    held += len(body)
                    if held >= batch_bytes:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return _files(spark, folder).mapInArrow(records, spec)


def round_trip(pages: DataFrame, version: int = 1) -> DataFrame:
    """Pages to ARC, to WARC, and back: the page records of the WARC files.

    Null ids come back as null and are always responses when no page with an id has their payload; pages that repeat an
    id and a payload are all responses; an empty table gives no record; other columns are not read.
    """
    spark = pages.sparkSession
    arc, warc = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    write_arc(pages, arc, version)
    convert(spark, arc, warc)
    return read_warc(spark, warc).filter(F.col("record_type").isin("response", "revisit"))
