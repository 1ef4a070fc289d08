"""Periodic stretches of words ("runs") from Lyndon arrays, and texts without their repetitions.

The words of a text are numbered, which gives an alphabet; any order of it will do. Baier's grouping, the first phase of
his suffix sorter, ends with every position in a group whose common prefix is the longest Lyndon word that starts there.
So the group lengths are the Lyndon array. Every run has a Lyndon root in the alphabet's order or in the opposite one
that starts inside its first period, so the arrays of both orders give all candidate roots, two per position. A root
of ``p`` words at ``i`` extends to the right by the longest common extension of ``i`` and ``i + p``, and to the left by
that of the words before them.

Only long runs are wanted, of at least ``min_exponent`` periods. Each of their words stands there at least so often. Words
that are rarer inside their stretch of text therefore cut it, exactly; stretches that become too short leave. In plain
prose nearly nothing is left to group.

Defined cases: null and blank texts have no words, no runs and an empty collapsed text; a null id stays null; every input
row gives one row, repeated rows too; other columns are not carried, so their names cannot clash. No rows give no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from phrasecast.llm.common import let, ship, words

#: A run has at least so many words, and at least so many periods.
MIN_WORDS, MIN_EXPONENT = 6, 4
#: Texts are handled in groups of about so many bytes; a longer text is a group of its own.
GROUP_BYTES = 2_000_000


def lyndon_lengths(symbols: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word at every position, by Baier's grouping.

    Symbol 0 closes a stretch: it is smaller than all others, so no Lyndon word reaches over it. Groups are intervals of
    ``slots``, named by their first slot, so a greater name is a greater group. They are taken from the greatest down. For
    each member the nearest earlier position of a smaller group is sought; a position found ``l`` times is followed by
    ``l`` copies of the group's word, so it moves to a new group just above its old one, whose word is that much longer.
    """
    n = len(symbols)
    slots = np.argsort(symbols, kind="stable")
    ordered = symbols[slots]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, n))
    group = np.empty(n, np.int64)
    group[slots] = np.repeat(starts, sizes)
    place = np.empty(n, np.int64)
    place[slots] = np.arange(n)
    size, length = dict(zip(starts.tolist(), sizes.tolist())), dict.fromkeys(starts.tolist(), 1)
    closing = int((symbols == 0).sum())
    slots, group, place = slots.tolist(), group.tolist(), place.tolist()
    before = [-1] * n

    end = n
    while end > closing:
        g = group[slots[end - 1]]
        members = sorted(slots[g:end])
        end = g
        found: list[list[int]] = []  # [position, how often], by position
        for i in members:
            j = i - 1
            while j >= 0 and group[j] > g:
                j = before[j]
            if j >= 0 and group[j] == g:
                j = before[j]
            before[i] = j
            if j < 0:
                continue
            if found and found[-1][0] == j:
                found[-1][1] += 1
            else:
                found.append([j, 1])
        by_count = defaultdict(lambda: defaultdict(list))
        for j, times in found:
            by_count[times][group[j]].append(j)
        word = length[g]
        for times in sorted(by_count, reverse=True):
            # The groups of one count are those the positions have now: earlier counts moved other positions.
            for old, moved in by_count[times].items():
                first = old + size[old] - len(moved)
                for k, j in enumerate(moved):
                    to, at = first + k, place[j]
                    other = slots[to]
                    slots[at], slots[to] = other, j
                    place[other], place[j] = at, to
                    group[j] = first
                size[old] -= len(moved)
                size[first] = len(moved)
                length[first] = length[old] + times * word
    return np.fromiter((length[g] for g in group), np.int64, n)


class Extensions:
    """Longest common extensions in both directions, from ranks of all pieces of 1, 2, 4, ... symbols."""

    def __init__(self, symbols: np.ndarray, longest: int):
        ranks = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
        self.levels = [ranks.astype(np.int32)]
        width = 1
        while 2 * width <= longest:
            pairs = ranks[:-width] * (int(ranks.max()) + 1) + ranks[width:]
            ranks = np.unique(pairs, return_inverse=True)[1]
            self.levels.append(ranks.astype(np.int32))
            width *= 2

    def right(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols agree from ``i`` and ``j`` on."""
        length = np.zeros(len(i), np.int64)
        for k in reversed(range(len(self.levels))):
            ranks = self.levels[k]
            a, b = i + length, j + length
            fits = np.maximum(a, b) < len(ranks)
            a, b = np.where(fits, a, 0), np.where(fits, b, 0)
            length += (fits & (ranks[a] == ranks[b])).astype(np.int64) << k
        return length

    def left(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols agree before ``i`` and ``j``."""
        length = np.zeros(len(i), np.int64)
        for k in reversed(range(len(self.levels))):
            ranks = self.levels[k]
            a, b = i - length - (1 << k), j - length - (1 << k)
            fits = np.minimum(a, b) >= 0
            a, b = np.where(fits, a, 0), np.where(fits, b, 0)
            length += (fits & (ranks[a] == ranks[b])).astype(np.int64) << k
        return length


def stretches(ids: np.ndarray, text: np.ndarray, min_words: int, min_exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, stretch of each) that may hold a run: every word stands in its stretch ``min_exponent`` times."""
    at, part = np.arange(len(ids)), text
    kinds = int(ids.max()) + 1 if len(ids) else 1
    for _ in range(8):  # more rounds would only leave less to group
        if not len(at):
            break
        _, which, counts = np.unique(part * kinds + ids[at], return_inverse=True, return_counts=True)
        kept = counts[which] >= min_exponent
        at, part = at[kept], part[kept]
        if not len(at):
            break
        new = np.concatenate([[True], (np.diff(at) > 1) | (np.diff(part) != 0)])
        part = np.cumsum(new) - 1
        long = np.bincount(part)[part] >= min_words
        at, part = at[long], part[long]
        if kept.all() and long.all():
            break
    return at, part


def runs_of(ids: np.ndarray, text: np.ndarray, min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT) -> np.ndarray:
    """Rows (start, length, period) of all runs, starts counted over all texts; ``text`` names each word's text, ascending.

    Results are ordered by start, then period.
    """
    at, part = stretches(ids, text, min_words, min_exponent)
    if not len(at):
        return np.zeros((0, 3), np.int64)
    # One sequence of all stretches, each closed by a symbol 0.
    part = np.unique(part, return_inverse=True)[1]
    where = np.arange(len(at)) + part
    n = len(at) + int(part[-1]) + 1
    symbols = np.zeros(n, np.int64)
    symbols[where] = np.unique(ids[at], return_inverse=True)[1] + 1
    source = np.full(n, -1)
    source[where] = at
    top = int(symbols.max()) + 1
    sizes = np.bincount(part)
    room = np.zeros(n, np.int64)
    room[where] = sizes[part]
    distinct = symbols.copy()
    closings = np.flatnonzero(symbols == 0)
    distinct[closings] = top + np.arange(len(closings))
    common = Extensions(distinct, int(sizes.max()))

    out = []
    for order in (symbols, np.where(symbols > 0, top - symbols, 0)):
        period = lyndon_lengths(order)
        root = np.flatnonzero((symbols > 0) & (period * min_exponent <= room))
        period = period[root]
        again = root + period
        equal = distinct[root] == distinct[np.minimum(again, n - 1)]
        root, period, again = root[equal], period[equal], again[equal]
        back = common.left(root, again)
        length = back + period + common.right(root, again)
        wanted = length >= np.maximum(min_words, min_exponent * period)
        out.append(np.stack([source[(root - back)[wanted]], length[wanted], period[wanted]], axis=1))
    found = np.unique(np.concatenate(out), axis=0)
    return found[np.lexsort((found[:, 2], found[:, 0]))]


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _groups(texts: pa.Array) -> Iterator[tuple[int, int]]:
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(texts):
        done = sizes[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(sizes, done + GROUP_BYTES, side="right")))
        yield first, last
        first = last


def _collapse_group(ids: pa.Array, texts: pa.Array, min_words: int, min_exponent: int) -> pa.RecordBatch:
    """Runs, strongest run and collapsed text of some rows."""
    bare = pc.ascii_trim_whitespace(pc.fill_null(texts, ""))
    lists = pc.ascii_split_whitespace(pc.if_else(pc.equal(bare, ""), None, bare))
    counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    collapsed = pc.fill_null(pc.binary_join(lists, " "), "")
    flat = lists.flatten()
    word_ids = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(counts)])
    found = runs_of(word_ids, np.repeat(np.arange(len(counts)), counts), min_words, min_exponent)
    owner = np.searchsorted(first, found[:, 0], side="right") - 1

    runs: list[list[dict]] = [[] for _ in counts]
    best: list[dict | None] = [None] * len(counts)
    dropped: dict[int, np.ndarray] = {}
    for d, (start, length, period) in zip(owner.tolist(), found.tolist()):
        run = {"start": start - int(first[d]), "length": length, "period": period}
        runs[d].append(run)
        if best[d] is None or length * best[d]["period"] > best[d]["length"] * period:
            best[d] = run
        gone = dropped.setdefault(d, np.zeros(counts[d], bool))
        gone[run["start"] + period : run["start"] + length] = True
    if dropped:
        texts_out = collapsed.to_pylist()
        for d, gone in dropped.items():
            texts_out[d] = " ".join(flat.slice(first[d], counts[d]).filter(pa.array(~gone)).to_pylist())
        collapsed = pa.array(texts_out, collapsed.type)
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(counts, pa.int64()), pa.array(runs, pa.list_(RUN)), pa.array(best, RUN), collapsed.cast(pa.string())],
        ["id", "n_words", "runs", "strongest", "collapsed"],
    )


def collapse(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT
) -> DataFrame:
    """Per row: the id, ``n_words``, ``runs`` (start, length, period; by start, then period), the ``strongest`` run (greatest
    length / period; ties: smallest start, then period; null without runs) and the ``collapsed`` text: the words, joined by
    one blank, without those that a run repeats.

    A run has at least ``min_words`` words and ``min_exponent`` (2 or more) periods. Rows are handled where they lie,
    nothing is shuffled.
    """
    if min_exponent < 2:
        raise ValueError("a run has at least two periods")
    ship(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _groups(batch.column(1)):
                yield _collapse_group(batch.column(0)[a:b], batch.column(1)[a:b], min_words, min_exponent)

    run = "struct<start:bigint,length:bigint,period:bigint>"
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = rows.mapInArrow(work, f"id {kind}, n_words bigint, runs array<{run}>, strongest {run}, collapsed string")
    return found.withColumnRenamed("id", id_col)


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where one document in ten ends periodically: with ``h`` the crc32 of the id as text and g = h // 10,
    if h % 10 = 0, word i >= a becomes word a + (i - a) % p with a = g % n and p = 1 + (n - a) // (3 + g % 8).

    Other texts, and those without words or id, stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("bigint")

    def tail(w):
        n = F.size(w).cast("bigint")
        a = F.pmod(g, n)
        p = F.lit(1).cast("bigint") + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8)))).cast("bigint")
        return let(
            F.struct(a.alias("a"), p.alias("p")),
            lambda x: F.array_join(
                F.transform(w, lambda v, i: F.when(i < x["a"], v).otherwise(F.get(w, (x["a"] + F.pmod(i - x["a"], x["p"])).cast("int")))), " "
            ),
        )

    rewritten = let(words(F.col("text")), lambda w: F.when(F.size(w) > 0, tail(w)).otherwise(F.col("text")))
    return docs.select("doc_id", F.when(F.pmod(h, F.lit(10)) == 0, rewritten).otherwise(F.col("text")).alias("text"))


def report(docs: DataFrame) -> DataFrame:
    """Runs of the documents with periodic tails, their strongest run, digests of the runs and of the collapsed text."""
    line = lambda r: F.concat(*[c.cast("string") for c in (r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))])
    best = F.col("strongest")
    # 1000 * length stays far inside a long, and the integer division is exact.
    return collapse(with_periodic_tails(docs)).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
