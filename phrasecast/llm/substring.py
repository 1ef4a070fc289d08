"""Removal of repeated passages by an FM-index per shard and matching statistics.

A shard is chosen by content: every window of ``width`` words goes where the smallest hash of its ``gram``-word parts
sends it, so equal windows meet in one shard and neighbouring windows mostly travel as one piece. Pieces whose part
was seen once only cannot repeat; a bit table of fixed size finds most of them before anything is shuffled. In a shard
the distinct pieces are indexed (suffix order, Burrows-Wheeler transform, wavelet tree), and backward search streams
the pieces against the index. The match is held at ``width`` words by widening its suffix interval to the bounds of
the suffixes that agree in so many words, so each word costs one step.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from phrasecast.llm.common import ship, split_unnamed
from phrasecast.llm.hashing import ODD, WordHashes, mix
from phrasecast.session import materialize

WIDTH, GRAM = 20, 8
#: Bits of the two tables "seen" and "seen twice"; their size does not depend on the input.
TABLE_BITS = 27
_CHUNKS = 256
#: Rows without an id are numbered from here: behind all others.
UNNAMED = 1 << 62


# --- pieces ------------------------------------------------------------------------------------------------------


def _minima(x: np.ndarray, span: int) -> np.ndarray:
    """Minimum of every ``span`` neighbours."""
    out, have = x, 1
    while have < span:
        step = min(have, span - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def _parts(words: list[bytes], memo: dict, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all parts, and of the smallest part of each window."""
    n = len(words)
    if n < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=n)
    part = np.zeros(n - gram + 1, np.uint64)
    for k in range(gram):
        part = part * ODD + h[k : n - gram + 1 + k]
    part = mix(part)
    return part, _minima(part, width - gram + 1)


def chosen_parts(words: list[bytes], memo: dict, width: int, gram: int) -> np.ndarray:
    """Hash of every place whose part is the smallest of some window around it.

    Places count, not runs: in a text that repeats at once, one run of windows has its part at several places.
    """
    part, low = _parts(words, memo, width, gram)
    if not len(low):
        return part
    none = np.full(width - gram, np.iinfo(np.uint64).max, np.uint64)
    most = ~_minima(np.concatenate([none, ~low, none]), width - gram + 1)
    return part[most == part]


def pieces(words: list[bytes], memo: dict, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part hash, first window, number of windows) of the runs of windows that share their smallest part."""
    _, low = _parts(words, memo, width, gram)
    if not len(low):
        return low, np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    return low[first], first, np.diff(np.append(first, len(low)))


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[list[bytes]]:
    for t in batch.column(column):
        b = t.as_py()
        yield b.encode().split() if b else []


def _seen_tables(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """Per chunk: the bits of parts that occur at least twice."""
    size, per = 1 << TABLE_BITS, (1 << TABLE_BITS) // _CHUNKS

    def fold(once: np.ndarray, twice: np.ndarray, slots: np.ndarray) -> None:
        slots, counts = np.unique(slots, return_counts=True)
        at, bit = slots >> 3, (1 << (slots & 7)).astype(np.uint8)
        again = (counts > 1) | ((once[at] & bit) > 0)
        np.bitwise_or.at(twice, at[again], bit[again])
        np.bitwise_or.at(once, at, bit)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, held, count = WordHashes(), [], 0
        once, twice = np.zeros(size >> 3, np.uint8), np.zeros(size >> 3, np.uint8)
        for batch in batches:
            for w in _texts(batch, 0):
                held.append((chosen_parts(w, memo, width, gram) & np.uint64(size - 1)).astype(np.int64))
                count += len(held[-1])
                if count > 1_000_000:
                    fold(once, twice, np.concatenate(held))
                    held, count = [], 0
        if held:
            fold(once, twice, np.concatenate(held))
        for c in range(_CHUNKS):
            part = slice(c * per >> 3, (c + 1) * per >> 3)
            if once[part].any():
                row = [c], [zlib.compress(once[part].tobytes(), 1)], [zlib.compress(twice[part].tobytes(), 1)]
                yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.int32()), *(pa.array(x, pa.binary()) for x in row[1:])], ["chunk", "once", "twice"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, once, twice = None, None, None
        out = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([twice.tobytes()], pa.binary())], ["chunk", "bits"])
        for batch in batches:
            for c, a, b in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if c != now:
                    if now is not None:
                        yield out()
                    now, once, twice = c, np.zeros(per >> 3, np.uint8), np.zeros(per >> 3, np.uint8)
                a, b = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (a, b))
                twice |= b | (once & a)
                once |= a
        if now is not None:
            yield out()

    found = docs.select("text").mapInArrow(local, "chunk int, once binary, twice binary")
    return found.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(merge, "chunk int, bits binary")


def _repeated(docs: DataFrame, width: int, gram: int) -> np.ndarray:
    """The table "seen twice" as bytes: 2**TABLE_BITS bits, whatever the input."""
    table = np.zeros(1 << (TABLE_BITS - 3), np.uint8)
    per = len(table) // _CHUNKS
    for chunk, bits in materialize(_seen_tables(docs, width, gram), "seen").toLocalIterator():
        table[chunk * per : (chunk + 1) * per] = np.frombuffer(bits, np.uint8)
    return table


def _spread(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


_PIECE = "shard long, doc long, at long, n int, words binary"


def _emit(docs: DataFrame, table: np.ndarray, width: int, gram: int) -> DataFrame:
    """Pieces that may repeat: shard, document, first window, windows, and the words (null: known to repeat).

    A task sends the words of equal pieces once, for the copy that starts first; its other copies go on as repeats.
    """
    shared = docs.sparkSession.sparkContext.broadcast(table)
    size = 1 << TABLE_BITS
    names = ["shard", "doc", "at", "n", "words"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, bits, firsts = WordHashes(), shared.value, {}
        for batch in batches:
            rows = []
            for doc, words in zip(batch.column(0).to_pylist(), _texts(batch, 1), strict=True):
                low, first, n = pieces(words, memo, width, gram)
                slot = (low & np.uint64(size - 1)).astype(np.int64)
                maybe = np.flatnonzero(bits[slot >> 3] & (1 << (slot & 7)).astype(np.uint8))
                for i in maybe.tolist():
                    at, count, shard = int(first[i]), int(n[i]), int(low[i].view(np.int64))
                    text = b" ".join(words[at : at + count + width - 1])
                    key = xxhash.xxh3_128_digest(text)
                    old = firsts.get(key)
                    if old is None:
                        firsts[key] = (doc, at, count, shard, text)
                    elif (doc, at) < old[:2]:
                        rows.append((_spread(key), old[0], old[1], count, None))
                        firsts[key] = (doc, at, count, shard, text)
                    elif (doc, at) > old[:2]:
                        rows.append((_spread(key), doc, at, count, None))
                if len(firsts) >= 200_000:
                    rows += [(s, d, a, c, t) for d, a, c, s, t in firsts.values()]
                    firsts = {}
            yield batch_of(rows)
        yield batch_of([(s, d, a, c, t) for d, a, c, s, t in firsts.values()])

    return docs.select("doc_id", "text").mapInArrow(run, _PIECE)


# --- index -------------------------------------------------------------------------------------------------------


class Bits:
    """A bit vector with counts per byte block: ``rank(i)`` ones among the first i."""

    def __init__(self, bits: np.ndarray):
        self.packed = np.packbits(bits, bitorder="little")
        ones = np.bitwise_count(self.packed)
        self.before = np.concatenate([[0], np.cumsum(ones)]).astype(np.int32)
        self.packed = np.append(self.packed, np.uint8(0))

    def rank(self, i: np.ndarray) -> np.ndarray:
        byte = i >> 3
        return self.before[byte] + np.bitwise_count(self.packed[byte] & ((1 << (i & 7)) - 1).astype(np.uint8))


class Wavelet:
    """Wavelet tree in matrix form over symbols below 2**levels: occurrences of a symbol before a position."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = max(int(sigma - 1).bit_length(), 1)
        self.rows, self.zeros = [], []
        x = symbols
        for level in reversed(range(self.levels)):
            bit = ((x >> level) & 1).astype(bool)
            self.rows.append(Bits(bit))
            self.zeros.append(int(len(x) - bit.sum()))
            x = np.concatenate([x[~bit], x[bit]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        start = np.zeros_like(i)
        for row, zeros, level in zip(self.rows, self.zeros, reversed(range(self.levels)), strict=True):
            one = ((symbol >> level) & 1).astype(bool)
            a, b = row.rank(start), row.rank(i)
            start, i = np.where(one, zeros + a, start - a), np.where(one, zeros + b, i - b)
        return i - start


class FMIndex:
    """Index of a text of word numbers (0 separates pieces); suffixes are ordered by their first ``width`` words."""

    def __init__(self, text: np.ndarray, width: int):
        n, self.width = len(text), width
        order, have = text.astype(np.int64), 1
        if int(text.max(initial=0)) < 1 << 21 and width >= 3:  # three word numbers fit one key
            after = np.append(text, [0, 0])
            order = np.unique((text << 42) | (after[1:-1] << 21) | after[2:], return_inverse=True)[1].astype(np.int64)
            have = 3
        while have < width:  # ranks by the first `have` words, doubled until they cover the width
            step = min(have, width - have)
            nxt = np.zeros(n, np.int64)
            nxt[: n - step] = order[step:] + 1
            order = np.unique(order * (n + 2) + nxt, return_inverse=True)[1].astype(np.int64)
            have += step
        self.suffixes = np.argsort(order, kind="stable")
        ranked = order[self.suffixes]
        edge = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        self.first = np.repeat(edge, np.diff(np.append(edge, n)))
        self.end = np.repeat(np.append(edge[1:], n), np.diff(np.append(edge, n)))
        sigma = int(text.max()) + 1
        self.tree = Wavelet(text[self.suffixes - 1], sigma)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals after one more word in front."""
        base = self.below[symbol]
        return base + self.tree.rank(symbol, low), base + self.tree.rank(symbol, high)


def matching(index: FMIndex, text: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matching statistics of the pieces, from their ends: (length up to the width, interval) at every text position."""
    size = np.zeros(len(text), np.int32)
    low, high = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
    a, b = np.zeros(len(starts), np.int64), np.full(len(starts), len(text), np.int64)
    have = np.zeros(len(starts), np.int32)
    for back in range(1, int(lengths.max(initial=0)) + 1):
        live = np.flatnonzero(lengths >= back)
        at = starts[live] + lengths[live] - back
        x, y = a[live], b[live]
        full = have[live] >= index.width
        wide = x[full]
        x[full], y[full] = index.first[wide], index.end[wide]
        x, y = index.extend(text[at], x, y)
        some = y > x
        keep = np.where(full, index.width, have[live] + 1)
        a[live], b[live], have[live] = np.where(some, x, 0), np.where(some, y, len(text)), np.where(some, keep, 0)
        size[at], low[at], high[at] = have[live], x, y
    return size, low, high


def repeats(rows: list[tuple[int, int, int, bytes]], width: int) -> list[tuple[int, int, int]]:
    """(document, first window, windows) of the distinct pieces' windows that start earlier elsewhere.

    ``rows``: document, first window, windows and words of each piece.
    """
    numbers: dict[bytes, int] = {}
    flat: list[int] = [0]
    starts, lengths = [], []
    for _, _, _, words in rows:
        starts.append(len(flat))
        split = words.split(b" ")
        lengths.append(len(split))
        flat.extend(numbers.setdefault(w, len(numbers) + 1) for w in split)
        flat.append(0)
    text = np.array(flat, np.int64)
    begin, count = np.array(starts), np.array(lengths)
    index = FMIndex(text, width)
    size, low, _ = matching(index, text, begin, count)

    doc, place = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
    inside = np.zeros(len(text), bool)
    which = np.repeat(np.arange(len(rows)), count)
    offset = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    at = begin[which] + offset
    doc[at] = np.array([r[0] for r in rows])[which]
    place[at] = np.array([r[1] for r in rows])[which] + offset
    inside[at] = offset <= (count - width)[which]
    # the earliest start among the suffixes that share their first words: the interval of a full match
    by = np.lexsort((place[index.suffixes], doc[index.suffixes], ~inside[index.suffixes], index.first))
    lead = index.suffixes[by]
    group = index.first[by]
    head = np.concatenate([[True], group[1:] != group[:-1]])
    earliest = np.zeros(len(text), np.int64)
    earliest[group[head]] = lead[head]
    full = inside & (size >= width)
    first = earliest[index.first[np.where(full, low, 0)]]
    later = full & ((doc[first] < doc) | ((doc[first] == doc) & (place[first] < place)))
    hit = np.flatnonzero(later)
    if not len(hit):
        return []
    joined = (np.diff(hit) == 1) & (doc[hit][1:] == doc[hit][:-1]) & (np.diff(place[hit]) == 1)
    head = np.flatnonzero(np.concatenate([[True], ~joined]))
    runs = np.diff(np.append(head, len(hit)))
    return list(zip(doc[hit[head]].tolist(), place[hit[head]].tolist(), runs.tolist(), strict=True))


def _divide_hot(found: DataFrame, width: int, most_words: int) -> DataFrame:
    """Pieces, those of shards above ``most_words`` words as single windows whose shard is their own hash.

    Equal windows have the same shard before and after, so nothing is lost. A task sends equal windows once, for the
    copy that starts first; the others go on as repeats.
    """
    words = F.sum(F.col("n") + F.lit(width - 1))
    sizes = found.filter("words IS NOT NULL").groupBy("shard").agg(words.alias("total")).filter(F.col("total") > most_words)
    hot = np.array(sorted(r.shard for r in sizes.select("shard").toLocalIterator()), np.int64)  # one per ``most_words`` words at most
    if not len(hot):
        return found
    shared = found.sparkSession.sparkContext.broadcast(hot)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["shard", "doc", "at", "n", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts: dict[bytes, tuple[int, int]] = {}
        for batch in batches:
            out: list[tuple] = []
            mine = np.isin(batch.column(0).to_numpy(), shared.value)
            for row, divide in zip(zip(*(c.to_pylist() for c in batch.columns), strict=True), mine.tolist(), strict=True):
                _, doc, at, n, words = row
                if not divide or words is None:
                    out.append(row)
                    continue
                split = words.split(b" ")
                for k in range(n):
                    window, place = b" ".join(split[k : k + width]), (doc, at + k)
                    old = firsts.setdefault(window, place)
                    if place != old:
                        firsts[window], later = min(old, place), max(old, place)
                        out.append((_spread(xxhash.xxh3_128_digest(window)), *later, 1, None))
                if len(out) >= 50_000:
                    yield batch_of(out)
                    out = []
                if len(firsts) >= 200_000:
                    yield batch_of([(_spread(xxhash.xxh3_128_digest(w)), d, a, 1, w) for w, (d, a) in firsts.items()])
                    firsts = {}
            yield batch_of(out)
        yield batch_of([(_spread(xxhash.xxh3_128_digest(w)), d, a, 1, w) for w, (d, a) in firsts.items()])

    return found.mapInArrow(run, _PIECE)


def _search(found: DataFrame, width: int, gram: int, most_words: int) -> DataFrame:
    """Runs of windows that start earlier elsewhere: ``doc, at, n``.

    Rows come sorted by shard, words and start. Of equal pieces only the first is indexed, the others are repeats at
    once. Whole shards are gathered until they hold ``most_words`` words; larger shards have been divided before they
    come here, so memory is bounded. A piece that is alone in its shard
    could only repeat itself; then the second of two equal windows adds no word of its own, so the piece has fewer
    distinct words than windows.
    """

    def indexed(rows: list[tuple[int, int, int, bytes]]) -> Iterator[tuple[int, int, int]]:
        total = sum(r[2] + width - 1 for r in rows)
        if total <= 2 * most_words or len(rows) < 2:
            yield from repeats(rows, width)
            return
        parts = total * width // most_words + 1
        cut: list[dict[bytes, tuple[int, int, int, bytes]]] = [{} for _ in range(parts)]
        for doc, at, n, words in rows:
            split = words.split(b" ")
            for k in range(n):
                window = b" ".join(split[k : k + width])
                mine = cut[xxhash.xxh3_64_intdigest(window) % parts]
                old = mine.get(window)
                if old is None:
                    mine[window] = (doc, at + k, 1, window)
                elif (doc, at + k) < old[:2]:
                    mine[window] = (doc, at + k, 1, window)
                    yield old[0], old[1], 1
                elif (doc, at + k) > old[:2]:
                    yield doc, at + k, 1
        for mine in cut:
            if mine:
                yield from repeats(list(mine.values()), width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []
        total, start, shard, last = 0, 0, None, None

        def close() -> int:
            """Drop the last shard's piece if it is alone and cannot repeat; the number of words dropped."""
            if len(held) - start == 1 and len(set(held[-1][3].split(b" "))) >= held[-1][2]:
                return held.pop()[2] + width - 1
            return 0

        for batch in batches:
            out = []
            for s, doc, at, n, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if words is None:
                    out.append((doc, at, n))
                    continue
                if s != shard:
                    total -= close()
                    if total >= most_words:
                        out += indexed(held)
                        held.clear()
                        total = 0
                    start = len(held)
                elif words == last:
                    if (doc, at) != held[-1][:2]:
                        out.append((doc, at, n))
                    continue
                shard, last = s, words
                held.append((doc, at, n, words))
                total += n + width - 1
            if out:
                yield _runs(out)
        close()
        if held:
            yield _runs(list(indexed(held)))

    order = ["shard", F.col("words").asc_nulls_first(), "doc", "at"]
    return found.repartition("shard").sortWithinPartitions(*order).mapInArrow(run, "doc long, at long, n int")


def _runs(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    kinds = [pa.int64(), pa.int64(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc", "at", "n"])


# --- documents ---------------------------------------------------------------------------------------------------


def repeated_windows(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, most_words: int = 300_000) -> DataFrame:
    """Runs of windows (``doc, at, n``: document, first word, windows) whose words also start earlier; ids are not null."""
    ship(docs.sparkSession)
    slim = docs.select("doc_id", "text")
    found = materialize(_emit(slim, _repeated(slim, width, gram), width, gram), "pieces")
    return _search(_divide_hot(found, width, most_words), width, gram, most_words)


def strip_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` (the words that are left, one blank between them) of every row.

    A word goes when a window of ``width`` words that covers it also starts earlier: in a document of smaller id, or in
    the same one before. Null and empty texts have no words and come back with an empty ``kept``. Rows that share an id
    are one document: a window is no repeat of one at the same place of a row of that id, and what is found in one of
    them is cut from all; each row with a null id is a document of its own behind all others. Ids must be below 2**62.
    Other columns are not read.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    named, unnamed = split_unnamed(slim, "doc_id", UNNAMED)
    slim = named.union(unnamed.select("__row", "text"))
    runs = repeated_windows(slim, width, gram)
    per = runs.groupBy("doc").agg(F.collect_list(F.struct("at", "n")).alias("runs"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [zlib.compress(b" ".join(w), 1) for w in _texts(batch, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["doc", "packed"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            for doc, packed, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = zlib.decompress(packed).split()
                gone = np.zeros(len(words) + 1, np.int32)
                for r in found or ():
                    a, b = min(r["at"], len(words)), min(r["at"] + r["n"] + width - 1, len(words))
                    gone[a] += 1
                    gone[b] -= 1
                left = np.flatnonzero(np.cumsum(gone)[:-1] == 0)
                kept = b" ".join(words if len(left) == len(words) else [words[i] for i in left.tolist()])
                for column, value in zip(rows, (None if doc >= UNNAMED else doc, len(words), len(words) - len(left), kept.decode()), strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], ["doc_id", "n_words", "n_removed", "kept"])

    joined = slim.mapInArrow(pack, "doc long, packed binary").join(per, "doc", "left")
    return joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")


def report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256``."""
    out = strip_repeats(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
