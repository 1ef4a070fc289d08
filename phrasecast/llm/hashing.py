"""Word hashes and fixed-size count tables used inside tasks."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

ODD = np.uint64(0x9E3779B97F4A7C15)
CHUNKS = 64


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < 500_000:
            self[word] = h
        return h


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def counts_out(counts: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Packed chunks of a task's count table that are not all zero."""
    for c, part in enumerate(np.split(counts, CHUNKS)):
        if part.any():
            yield c, zlib.compress(np.minimum(part, 65535).astype(np.uint16).tobytes(), 1)


def add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum the packed chunks of all tasks, which come sorted by chunk; one chunk is held at a time."""
    now, total = None, None
    row = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["chunk", "counts"])
    for batch in batches:
        for c, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            part = np.frombuffer(zlib.decompress(packed), np.uint16).astype(np.int64)
            if c == now:
                total = total + part
                continue
            if now is not None:
                yield row()
            now, total = c, part
    if now is not None:
        yield row()
