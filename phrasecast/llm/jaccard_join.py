"""Size-aware heavy-light join of documents on the Jaccard similarity of their word shingles.

Light (small) sets enumerate the 2-subsets of their prefix as join keys; heavy (large) sets scan the inverted lists of
their prefix shingles. Prefixes follow one global order, rare shingles first, from a count table of fixed size; the
border between light and heavy sets is the one of least estimated cost. Sets of the border's neighbourhood take part
in both, so no link is lost.

What is wanted is the components of the links, so a list need not be expanded into pairs. A parity bitmap, which
bounds the symmetric difference of two sets from below, tells which pairs may link at all. Each set meets the heads of
its lists; pairs that may link form loose components, and pairs that may link across loose components are found from
the keys that such components share. The exact sets decide about these pairs. What a loose component holds without
being linked is then compared in the same way inside it. So every two sets that share a key are linked indirectly,
compared, or ruled out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window

from phrasecast.llm.common import ship, small_batches, split_unnamed
from phrasecast.llm.hashing import ODD, WordHashes, add_counts, counts_out, mix
from phrasecast.session import materialize

SHINGLE = 5
#: Similarity 0.8 as the fraction 4/5, for exact integer arithmetic.
NUM, DEN = 4, 5
#: Cells of the count table and bits of the filter of wanted sets; fixed, whatever the input.
CELLS, FILTER_BITS = 1 << 22, 1 << 24
#: Sets above this size also get a bitmap of this many cells; the small one says little about them.
WIDE_FROM, WIDE_CELLS = 300, 4096
#: Frequency classes of a count table's cell for each doubling of its count.
STEPS = 8
BORDERS = (0, 4, 8, 16, 32, 64, 128)
#: Cost of looking at one list entry, in shuffled rows.
SCAN_COST = 0.02
_SYNTHETIC = 1 << 62


def shingles(text: str | None, memo: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles; fewer words are one shingle, no words none."""
    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=n)
    width = min(n, SHINGLE)
    s = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        s = s * ODD + h[k : n - width + 1 + k]
    return np.unique(mix(s))


def signature(s: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def text_hash(text: str | None) -> int:
    """Tells texts apart before they are taken apart; equal sets may come from texts of different hashes."""
    return int.from_bytes(xxhash.xxh3_64_digest((text or "").encode()), "little", signed=True)


def parity(s: np.ndarray, cells: int = 512) -> np.ndarray:
    """Parities of hash cells, packed: the bits in which two sets differ are no more than their symmetric difference."""
    at = (s >> np.uint64(65 - cells.bit_length())).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=cells) & 1).astype(np.uint8)).view(np.int64)


def prefix_length(n: int) -> int:
    return n - (NUM * n + DEN - 1) // DEN + 1


@dataclass(frozen=True)
class Plan:
    """``rank``: class of each cell of the count table (small: rare); ``salts``: parts of a class's lists; ``border``: largest light set."""

    rank: np.ndarray
    salts: np.ndarray
    border: int


# --- first pass: sets and counts ---------------------------------------------------------------------------------

_SETS = "doc long, n int, sig long, sig2 long, bits array<long>, wide array<long>, textual long, chunk int, counts binary"


def _measure(docs: DataFrame) -> DataFrame:
    """A row per document (size, signature, parity bits, hash of the text), and the count table of each task in chunks."""
    names = ["doc", "n", "sig", "sig2", "bits", "wide", "textual", "chunk", "counts"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, counts = WordHashes(), np.zeros(CELLS, np.int64)
        for batch in batches:
            rows: list[tuple] = []
            held: list[np.ndarray] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                s = shingles(text, memo)
                sig, sig2 = signature(s) if len(s) else (None, None)
                wide = parity(s, WIDE_CELLS) if len(s) > WIDE_FROM else None
                rows.append((doc, len(s), sig, sig2, parity(s) if len(s) else None, wide, text_hash(text), None, None))
                held.append((s & np.uint64(CELLS - 1)).astype(np.int64))
                if len(held) >= 1000:
                    counts += np.bincount(np.concatenate(held), minlength=CELLS)
                    held = []
            if held:
                counts += np.bincount(np.concatenate(held), minlength=CELLS)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        for c, packed in counts_out(counts):
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip([[None]] * 7 + [[c], [packed]], kinds, strict=True)], names)

    return docs.mapInArrow(run, _SETS)


def _classes_of_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A byte per cell, ``STEPS`` classes for each doubling of the count, and the sum of squared counts of each chunk."""
    for batch in batches:
        counts = [np.frombuffer(c, np.int64) for c in batch.column(1).to_pylist()]
        ranks = [np.minimum(np.ceil(STEPS * np.log2(np.maximum(c, 1))), 255).astype(np.uint8).tobytes() for c in counts]
        squares = [float((c.astype(float) ** 2).sum()) for c in counts]
        columns = [batch.column(0), pa.array(ranks, pa.binary()), pa.array(squares, pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, ["chunk", "ranks", "squares"])


def choose_plan(measured: DataFrame) -> Plan:
    """Frequency classes of the count table's cells, and the border of least cost.

    The driver gets one row of sums, then a byte for each of the ``CELLS`` cells.
    """
    n = F.col("n")
    prefix = n - F.floor((NUM * n + DEN - 1) / DEN) + 1
    light = [F.sum(F.when((n > 1) & (n <= b), prefix * (prefix + 1) / 2)).alias(f"light{b}") for b in BORDERS]
    heavy = [F.sum(F.when((n > 1) & (n >= NUM * b / DEN), prefix)).alias(f"heavy{b}") for b in BORDERS]
    row = measured.filter("chunk IS NULL").agg(F.sum("n").alias("total"), *light, *heavy).first()
    total = max(int(row["total"] or 0), 1)
    load = total / CELLS
    chunks = measured.filter("chunk IS NOT NULL").select("chunk", "counts").repartition("chunk").sortWithinPartitions("chunk")
    classed = chunks.mapInArrow(lambda batches: _classes_of_cells(add_counts(batches)), "chunk int, ranks binary, squares double")
    rank, squares = np.zeros((64, CELLS // 64), np.uint8), 0.0
    for chunk, packed, part in sorted(tuple(r) for r in classed.collect()):  # CELLS bytes in 64 rows
        squares += part
        rank[chunk] = np.frombuffer(packed, np.uint8)
    list_length = max(squares / total - load, 1.0)
    cost = [((row[f"light{b}"] or 0.0) + float(row[f"heavy{b}"] or 0) * (1 + SCAN_COST * list_length), b) for b in BORDERS]
    # Lists that may be much longer than a cell's load of rare shingles are dealt over parts.
    times = np.ceil(np.arange(256) / STEPS - np.log2(4 * load + 16)).astype(np.int64)
    return Plan(rank.reshape(-1), np.where(times > 0, 8 << np.clip(times, 0, 16), 0), min(cost)[1])


# --- second pass: keys -------------------------------------------------------------------------------------------

_ENTRIES = "key long, salt int, sig long, n int, room int"


def keys_of(s: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, class of each, room of each) of a set: single shingles of its prefix, pairs of them, or both.

    The room of a shingle is the number of shingles from it on in the global order: the intersection of two sets is no
    larger than the room, on either side, of the first shingle that they share. A pair leaves all of the set.
    """
    n = len(s)
    rank = plan.rank[(s & np.uint64(CELLS - 1)).astype(np.int64)]
    order = np.lexsort((s, rank))
    p = prefix_length(n)
    keys, ranks, rooms = [], [], []
    if DEN * n >= NUM * plan.border:  # heavy, or light with heavy partners in reach
        keys.append(s[order[:p]])
        ranks.append(rank[order[:p]])
        rooms.append(n - np.arange(p))
    if n <= plan.border:
        first = order[: p + 1]
        i, j = np.triu_indices(len(first), 1)
        keys.append(mix(mix(s[first[i]] + np.uint64(1)) * ODD + s[first[j]]))
        ranks.append(np.minimum(rank[first[i]], rank[first[j]]))
        rooms.append(np.full(len(i), n))
    return np.concatenate(keys), np.concatenate(ranks), np.concatenate(rooms)


def _entries(docs: DataFrame, plan: Plan) -> DataFrame:
    """(key, salt, signature, size, room); frequent keys are dealt over salts, and a task sends equal sets once."""
    shared = docs.sparkSession.sparkContext.broadcast(plan)  # CELLS bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, plan, seen = WordHashes(), shared.value, set()
        for batch in batches:
            parts: list[tuple[np.ndarray, ...]] = []
            for text in batch.column(1):
                s = shingles(text.as_py(), memo)
                if len(s) < 2:
                    continue
                sig = signature(s)
                if sig in seen:
                    continue
                if len(seen) < 500_000:
                    seen.add(sig)
                keys, ranks, rooms = keys_of(s, plan)
                several = plan.salts[ranks]
                salts = np.where(several > 0, 1 + (sig[0] & 0x7FFFFFFF) % np.maximum(several, 1), 0)
                parts.append((keys.view(np.int64), salts.astype(np.int32), np.full(len(keys), sig[0]), np.full(len(keys), len(s), np.int32), rooms.astype(np.int32)))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], ["key", "salt", "sig", "n", "room"])

    return docs.mapInArrow(run, _ENTRIES)


def _size_class(n: Column) -> Column:
    return F.floor(F.log(n) / F.lit(float(np.log(DEN / NUM)))).cast("int")


def _shared(entries: DataFrame) -> DataFrame:
    """Entries whose key another set has, with the head (smallest signature) of their list, salt and size class.

    A list of salt 0 is no longer than the count table allows for a rare shingle; longer lists are in parts, all kept.
    """
    part = Window.partitionBy("key", "salt")
    rows = entries.withColumns({"least": F.min("sig").over(part), "most": F.max("sig").over(part)})
    rows = rows.filter((F.col("least") != F.col("most")) | (F.col("salt") > 0)).drop("least", "most")
    rows = rows.withColumn("size", _size_class(F.col("n")))
    return rows.withColumn("head", F.min("sig").over(Window.partitionBy("key", "salt", "size")))


# --- pairs -------------------------------------------------------------------------------------------------------


def _differing(bits: str) -> Column:
    both = F.zip_with(F.col(f"x.{bits}"), F.col(f"y.{bits}"), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(both, F.lit(0), lambda s, x: s + x)


def _could_link(bits: str) -> Column:
    """Sizes within reach, and no more differing parities than the symmetric difference may have."""
    least, most, differ = F.least("na", "nb"), F.greatest("na", "nb"), _differing(bits)
    return (DEN * least >= NUM * most) & ((NUM + DEN) * differ <= (DEN - NUM) * (F.col("na") + F.col("nb")))


_OF_SET = ["sig", "sig2", "node", "n", "bits"]


def _may_link() -> Column:
    """Of the sets ``x`` and ``y``, by their sizes and small bitmaps."""
    differ, both = _differing("bits"), F.col("x.n") + F.col("y.n")
    reach = DEN * F.least("x.n", "y.n") >= NUM * F.greatest("x.n", "y.n")
    return (F.col("x.node") != F.col("y.node")) & reach & ((NUM + DEN) * differ <= (DEN - NUM) * both)


def _candidates(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Signature pairs (a, b) as class pairs that may link."""
    sets = classes.select(*_OF_SET)
    rows = pairs.join(sets.alias("x"), F.col("a") == F.col("x.sig"))
    return _by_bitmaps(rows.join(sets.select(*_OF_SET).alias("y"), (F.col("b") == F.col("y.sig")) & _may_link()), classes)


def _by_bitmaps(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of sets ``x`` and ``y`` that the small bitmaps left; the wide ones go only with pairs of large sets."""
    rows = rows.select(
        F.col("x.node").alias("node_a"), F.col("y.node").alias("node_b"), F.col("x.sig").alias("a"), F.col("y.sig").alias("b"),
        F.col("x.sig2").alias("a2"), F.col("y.sig2").alias("b2"), F.col("x.n").alias("na"), F.col("y.n").alias("nb"),
    )
    rows = materialize(rows.distinct(), "near-pairs")
    small = F.least("na", "nb") <= WIDE_FROM
    wide = classes.filter(F.col("wide").isNotNull()).select("sig", "sig2", "wide")
    large = rows.filter(~small).join(wide.select(F.col("sig").alias("a"), F.col("sig2").alias("a2"), "wide").alias("x"), ["a", "a2"])
    large = large.join(wide.select(F.col("sig").alias("b"), F.col("sig2").alias("b2"), "wide").alias("y"), ["b", "b2"])
    return rows.filter(small).unionByName(large.filter(_could_link("wide")).select(*rows.columns))


def _wanted_sets(docs: DataFrame, pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The shingles of the sets that the pairs name, once per set.

    A filter of fixed size over the hashes of their texts spares the others being taken apart.
    """
    words = FILTER_BITS >> 6
    named = pairs.select(F.col("a").alias("sig"), F.col("a2").alias("sig2")).union(pairs.select("b", "b2"))
    named = classes.select("sig", "sig2", "textual").join(named, ["sig", "sig2"], "left_semi")
    named = named.select(F.pmod("textual", F.lit(FILTER_BITS)).alias("s"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("s", F.lit(64)).cast("int"))
    table = np.zeros(words, np.int64)
    rows = named.select(F.shiftright("s", 6).alias("i"), bit.alias("b")).groupBy("i").agg(F.bit_or("b").alias("b")).toArrow()
    table[rows["i"].to_numpy().astype(np.int64)] = rows["b"].to_numpy()  # at most FILTER_BITS / 64 rows
    shared = docs.sparkSession.sparkContext.broadcast(table.view(np.uint8))
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, bits, seen = WordHashes(), shared.value, set()
        for batch in batches:
            out: list[tuple] = []
            for text in batch.column(1):
                text = text.as_py()
                at = text_hash(text) & (FILTER_BITS - 1)
                if not (bits[at >> 3] >> (at & 7)) & 1:
                    continue
                s = shingles(text, memo)
                if not len(s) or (sig := signature(s)) in seen:
                    continue
                sig, sig2 = sig
                if len(seen) < 500_000:
                    seen.add((sig, sig2))
                out.append((sig, sig2, s.view(np.int64)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["sig", "sig2", "items"])

    found = docs.mapInArrow(run, "sig long, sig2 long, items array<long>")
    return materialize(found.groupBy("sig", "sig2").agg(F.first("items").alias("items")), "wanted-sets")


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links among class pairs, by the exact sizes of intersection and union."""
    x = sets.select(F.col("sig").alias("a"), F.col("sig2").alias("a2"), F.col("items").alias("items_a"))
    y = sets.select(F.col("sig").alias("b"), F.col("sig2").alias("b2"), F.col("items").alias("items_b"))
    rows = pairs.join(x, ["a", "a2"]).join(y, ["b", "b2"])
    both = F.size(F.array_intersect("items_a", "items_b"))
    rows = rows.withColumn("both", both).filter(DEN * F.col("both") >= NUM * (F.col("na") + F.col("nb") - F.col("both")))
    return rows.select(F.greatest("node_a", "node_b").alias("u"), F.least("node_a", "node_b").alias("v"))


def _are_stars(edges: DataFrame) -> bool:
    """Whether every upper node has one edge, and no lower node is an upper one."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up")).union(edges.select("v", F.lit(0)))
    return ends.groupBy("x").agg(F.sum("up").alias("n"), F.min("up").alias("lower")).filter("n > 1 OR (n = 1 AND lower = 0)").isEmpty()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): every node of the links with the smallest node it reaches.

    Alternating large-star and small-star steps on the edge table (Kiveris et al. 2014); the number of rounds grows
    with the logarithm of the longest chain. Each round is a written table.
    """
    edges = materialize(links.filter("u <> v").distinct(), "links")
    for _ in range(most_rounds):
        if _are_stars(edges):
            break
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.filter("u <> v").distinct()
        low = low.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = low.groupBy("u").agg(F.min("v").alias("m"))
        small = low.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        edges = materialize(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "links")
    else:
        raise RuntimeError("components did not settle")
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _cross_pairs(shared: DataFrame, component: DataFrame, classes: DataFrame) -> DataFrame:
    """Distinct class pairs that may link, share a key and belong to different components so far.

    Keys whose sets are all in one component are dropped. For the others the sets of one component at one key form a
    list; lists are paired (those with too little room behind the key, and two sets that are alone and whose bitmaps
    differ too much, are ruled out at once), equal pairs from many keys become one, and only lists whose bitmaps allow a
    link between any of their members are expanded into members. The sizes and bitmaps of members are compared where
    they meet.
    """
    named = classes.join(component, "node", "left").select("sig", F.coalesce("component", "node").alias("comp"), "bits")
    rows = shared.select("key", "sig", "n", "room").join(named, "sig")
    many = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key")
    rows = materialize(rows.join(many, "key").distinct(), "cross-rows")
    lists = rows.groupBy("key", "comp").agg(
        F.bit_xor(F.xxhash64("sig")).alias("l1"), F.bit_xor(F.xxhash64("sig", F.lit(1))).alias("l2"), F.min("sig").alias("head"),
        F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("room").alias("room"), (F.min("sig") == F.max("sig")).alias("alone"),
        F.when(F.min("sig") == F.max("sig"), F.first("bits")).alias("bits"),
    )
    lists = materialize(lists, "lists")
    x, y = lists.alias("x"), lists.alias("y")
    near = (DEN * F.col("x.hi") >= NUM * F.col("y.lo")) & (DEN * F.col("y.hi") >= NUM * F.col("x.lo"))
    near &= F.coalesce((NUM + DEN) * _differing("bits") <= (DEN - NUM) * (F.col("x.hi") + F.col("y.hi")), F.lit(True))
    # At the first key that two sets share, the smaller room bounds their intersection.
    near &= (NUM + DEN) * F.least("x.room", "y.room") >= NUM * (F.col("x.lo") + F.col("y.lo"))
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.comp") < F.col("y.comp")) & near)
    sides = [F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in "xy" for c in ("l1", "l2", "head", "hi")]
    met = materialize(met.select(*sides).distinct(), "list-pairs")

    used = met.select(F.col("x_l1").alias("l1"), F.col("x_l2").alias("l2")).union(met.select("y_l1", "y_l2")).distinct()
    several = lists.filter(~F.col("alone")).groupBy("l1", "l2", "comp", "head").agg(F.min("key").alias("key")).join(used, ["l1", "l2"])
    members = several.join(rows.select("key", "comp", "sig"), ["key", "comp"]).select("l1", "l2", "head", "sig")
    members = materialize(members, "list-members")
    met = _near_lists(met, members, classes)
    single = lists.filter("alone").join(used, ["l1", "l2"], "left_semi").select("l1", "l2", F.col("head").alias("sig")).distinct()
    sets = members.select("l1", "l2", "sig").union(single).join(classes.select(*_OF_SET), "sig")
    of = lambda side: (F.col(f"{side}.l1") == F.col(f"{side}_l1")) & (F.col(f"{side}.l2") == F.col(f"{side}_l2"))
    return _by_bitmaps(met.join(sets.alias("x"), of("x")).join(sets.select("l1", "l2", *_OF_SET).alias("y"), of("y") & _may_link()), classes)


def _near_lists(met: DataFrame, members: DataFrame, classes: DataFrame) -> DataFrame:
    """List pairs in which some member of one may link with some member of the other.

    Parity bitmaps differ in at least as many bits as those of the heads do, less the largest distances of members from
    their heads.
    """
    maps = classes.select("sig", "bits", "wide")
    heads = maps.withColumnRenamed("sig", "head")
    far = members.join(maps.alias("x"), "sig").join(heads.alias("y"), "head").select("l1", "l2", _differing("bits").alias("bits"), _differing("wide").alias("wide"))
    most = [F.when(F.count(c) == F.count(F.lit(1)), F.max(c)).alias(c) for c in ("bits", "wide")]
    far = far.groupBy("l1", "l2").agg(*most, F.lit(True).alias("many"))
    rows = met
    for side in "xy":
        reached = far.select(*(F.col(c).alias(f"{side}_{c}") for c in ("l1", "l2")), *(F.col(c).alias(f"{side}_{c}_reach") for c in ("bits", "wide")), F.col("many").alias(f"{side}_many"))
        rows = rows.join(reached, [f"{side}_l1", f"{side}_l2"], "left")
    rows = rows.join(heads.alias("x"), F.col("x_head") == F.col("x.head")).join(heads.alias("y"), F.col("y_head") == F.col("y.head"))
    allowed = F.lit(True)
    for c in ("bits", "wide"):
        reach = lambda side: F.when(F.col(f"{side}_many"), F.col(f"{side}_{c}_reach")).otherwise(0)  # noqa: B023, E731
        least = _differing(c) - reach("x") - reach("y")
        allowed &= F.coalesce((NUM + DEN) * least <= (DEN - NUM) * (F.col("x_hi") + F.col("y_hi")), F.lit(True))
    return rows.filter(allowed).select(*met.columns).distinct()


# --- the operator ------------------------------------------------------------------------------------------------


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row.

    Two documents link when their sets of 5-word shingles (ASCII letters in lower case) have similarity 0.8 or more;
    ``component_id`` is the smallest id reachable. Null and empty texts have no shingles and link with nothing. Rows
    that share an id and have shingles are one node. Null ids never name a component that has another id; a component
    without any id gets null. Ids must be below 2**62. Other columns are not read; an empty table gives no rows.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    out = _components_of(slim)
    found = F.when(F.col("n") == 0, F.col("doc")).when(F.col("component") < _SYNTHETIC, F.col("component"))
    return out.select(F.col("doc").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), found.alias("component_id"))


def _components_of(slim: DataFrame) -> DataFrame:
    """``doc, n, component`` of every row of ``doc, text``: the smallest node reachable; null without shingles."""
    ship(slim.sparkSession)
    small_batches(slim.sparkSession)
    measured = materialize(_measure(slim), "sets")
    plan = choose_plan(measured)
    rows = measured.filter("chunk IS NULL").select("doc", "n", "sig", "sig2", "bits", "wide", "textual")
    unnamed = F.lit(2**63 - 1) - F.shiftrightunsigned(F.col("sig"), 2)
    classes = rows.filter("n > 0").groupBy("sig", "sig2", "n").agg(F.min("doc").alias("node"), F.first("bits").alias("bits"), F.first("wide").alias("wide"), F.min("textual").alias("textual"))
    classes = materialize(classes.withColumn("node", F.coalesce("node", unnamed)), "classes")

    shared = materialize(_shared(_entries(slim, plan)), "shared")
    stars = shared.filter("sig <> head").select(F.col("sig").alias("a"), F.col("head").alias("b"))
    heads = shared.filter("salt > 0").select("key", "size", F.col("head").alias("a")).distinct()
    heads = heads.withColumn("b", F.min("a").over(Window.partitionBy("key", "size"))).filter("a <> b").select("a", "b")
    near = materialize(_candidates(stars.union(heads).distinct(), classes), "near")
    loose = components(near.select(F.greatest("node_a", "node_b").alias("u"), F.least("node_a", "node_b").alias("v")))
    apart = materialize(_cross_pairs(shared, loose, classes), "apart")
    sets = _wanted_sets(slim, near.unionByName(apart), classes)
    by = F.struct("node_b", "node_a", "a", "b", "a2", "b2", "na", "nb")
    one = near.groupBy("node_a").agg(F.min(by).alias("p")).select("p.*")
    links = _verify(one.unionByName(apart), sets).union(_same_id(rows, classes))
    tight = components(links)

    # inside a loose component, what is not linked yet; all its sets are named by near pairs
    inside = loose.join(classes.select("node", "sig"), "node").select("sig", "component")
    inside = shared.join(inside, "sig").withColumn("key", F.xxhash64("key", "component")).drop("component")
    rest = materialize(_cross_pairs(inside, tight, classes), "rest")
    final = components(_verify(rest, sets).union(tight.select(F.col("node").alias("u"), F.col("component").alias("v"))))
    named = classes.join(final, "node", "left").select("sig", "sig2", F.coalesce("component", "node").alias("component"))
    out = rows.select("doc", "n", "sig", "sig2").join(named, ["sig", "sig2"], "left")
    return out.select("doc", "n", F.when(F.col("n") > 0, F.col("component")).alias("component"))


def _same_id(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of rows that share an id."""
    ids = rows.filter("n > 0 AND doc IS NOT NULL")
    again = ids.groupBy("doc").agg(F.min("sig").alias("lo"), F.max("sig").alias("hi")).filter("lo <> hi").select("doc")
    nodes = ids.join(again, "doc").join(classes.select("sig", "sig2", "node"), ["sig", "sig2"])
    least = nodes.groupBy("doc").agg(F.min("node").alias("v"))
    return nodes.join(least, "doc").filter("node <> v").select(F.col("node").alias("u"), "v").distinct()


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, the one of smallest id (all of its rows); documents without shingles stay.

    Every row without an id is a document of its own, behind all those with one.
    """
    named, unnamed = split_unnamed(docs, id_col, _SYNTHETIC)
    key, text = F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")
    found = _components_of(named.select(key, text).union(unnamed.select("__row", text)))
    out = materialize(found.filter(F.col("component") != F.col("doc")).select(F.col("doc").alias("__out")).distinct(), "copies")
    kept = named.join(out, named[id_col] == F.col("__out"), "left_anti")
    return kept.unionByName(unnamed.join(out, unnamed["__row"] == F.col("__out"), "left_anti").drop("__row"))
