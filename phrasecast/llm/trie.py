"""Prefix trie of conversations and sums over its subtrees by centroid decomposition.

A node is a sequence of first turns. Its key is a 124-bit sum of hashes of (place, role, text), which adds up over blocks of
turns, so one conversation may hold any share of all rows. Nodes, members and parents come from one aggregate over
(conversation, depth) rows.

Subtree sums: in a component of the parent-edge forest, weighted by turns, the nodes whose subtree holds more than half
form the path from the top to the centroid. The centroid leaves: what lies under it is summed, that total goes to the
nodes of the path, each child's part and the rest are components of at most half the weight. Rounds over tables split all
components of more than ``SMALL`` turns, so there are log2(turns / SMALL) of them; the small ones are decomposed in tasks, each
component by itself.

Defined cases: rows without ``conv_id`` belong to no conversation and are left out; null roles and texts are empty; null
turns come first; rows of one turn are ordered by a hash of role and text, repeated rows stay; no conversations give no
nodes. Only the four columns are read, so names of others cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from phrasecast.functions.scan import prefix_sums, skew_join
from phrasecast.llm.common import ship, words
from phrasecast.session import materialize

#: Components of at most so many turns are decomposed inside a task.
SMALL = 4096
#: Turns of one block of a conversation, and conversation ids of one block of a digest.
BLOCK, IDS = 1024, 4096
#: Tables of at most so many rows are broadcast; larger ones take the salted join.
BROADCAST_ROWS = 50_000
_MODULUS = 1 << 62
ROOT = "0.0"


def placed(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, n_turns, words, a, b) per row: its place from 0 in its conversation, two hashes of role and text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    part = lambda start: F.conv(F.substring(digest, start, 15), 16, 10).cast("bigint")
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.coalesce(F.col("turn").cast("bigint"), F.lit(-(2**63))).alias("turn"),
        F.size(words(text)).cast("bigint").alias("words"),
        part(1).alias("a"),
        part(16).alias("b"),
    )
    # Shifting is monotone for negative turns, too.
    return prefix_sums(
        rows, ["conv_id"], {"block": F.shiftright("turn", 10)}, ["turn", "a", "b"], {"place": F.lit(1).cast("bigint")}, totals=True
    ).select("conv_id", "place", F.col("place_total").alias("n_turns"), "words", "a", "b")


def conversations_of(rows: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of placed rows."""
    return rows.filter(F.col("place") == 0).select("conv_id", "n_turns")


def _meet(fact: DataFrame, dim: DataFrame, on: str, how: str = "inner", spread: list[str] | None = None) -> DataFrame:
    """Join to a written table that is unique on ``on``: broadcast when it has few rows, else with hot keys salted."""
    if dim.count() <= BROADCAST_ROWS:
        return fact.join(F.broadcast(dim), on, how)
    return skew_join(fact, dim, on, how, spread)


def with_shared_openings(rows: DataFrame, group: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(rows, conversations) where conversation c opens with the first h turns of conversation c - c % ``group``, followed by its
    own turns after its first h, for h = crc32(c as text) % ``most``. Missing turns are left out."""
    c = F.col("conv_id")
    h = F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(most))
    convs = materialize(conversations_of(rows).select("conv_id", "n_turns", h.alias("h"), (c - c % group).alias("source")), "conversations")
    opening = convs.select(F.col("conv_id").alias("source"), F.col("n_turns").alias("n_source"))
    opened = convs.join(opening, "source", "left").select(
        "conv_id", "source", "h",
        F.least("h", F.coalesce("n_source", F.lit(0))).alias("n_opening"),
        F.greatest(F.col("n_turns") - F.col("h"), F.lit(0)).alias("n_own"),
    )
    opened = materialize(opened.withColumn("n_turns", F.col("n_opening") + F.col("n_own")), "opened")

    own = _meet(rows.drop("n_turns"), opened.select("conv_id", "h", "n_opening", "n_turns"), "conv_id", spread=["place", "a"])
    own = own.filter(F.col("place") >= F.col("h")).withColumn("place", F.col("place") - F.col("h") + F.col("n_opening"))
    heads = rows.filter(F.col("place") < most).select(F.col("conv_id").alias("source"), "place", "words", "a", "b")
    # A source has at most 2 * group - 1 conversations and ``most`` such turns.
    shared = heads.join(opened.select("conv_id", "source", "h", "n_turns"), "source").filter(F.col("place") < F.col("h"))
    columns = ["conv_id", "place", "n_turns", "words", "a", "b"]
    return own.select(*columns).unionByName(shared.select(*columns)), opened.select("conv_id", "n_turns")


def paths(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, key, parent_key, words, n_turns): the nodes on the way of each conversation."""
    salted = rows.withColumns({
        "ha": F.xxhash64("a", "place").bitwiseAND(F.lit(_MODULUS - 1)).cast("decimal(20,0)"),
        "hb": F.xxhash64("place", "b").bitwiseAND(F.lit(_MODULUS - 1)).cast("decimal(20,0)"),
    }).drop("a", "b")
    scanned = prefix_sums(salted, ["conv_id"], {"block": F.floor(F.col("place") / BLOCK)}, ["place"], {"pa": F.col("ha"), "pb": F.col("hb")})

    def key(a: Column, b: Column) -> Column:
        short = lambda x: F.lower(F.hex((x % F.lit(Decimal(_MODULUS))).cast("bigint")))
        return F.concat(short(a), F.lit("."), short(b))

    return scanned.select(
        "conv_id", (F.col("place") + 1).alias("depth"),
        key(F.col("pa") + F.col("ha"), F.col("pb") + F.col("hb")).alias("key"), key(F.col("pa"), F.col("pb")).alias("parent_key"),
        "words", "n_turns",
    )


def nodes(ways: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node: key, parent_key, conv_id (smallest member), depth, n_convs, n_children, own_saved, weight (turns below or here)."""
    one = F.lit(1).cast("bigint")
    below = ways.groupBy("key").agg(
        F.min("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"),
        F.count(F.lit(1)).alias("n_convs"), F.min("words").alias("words"), F.sum(F.col("n_turns") - F.col("depth") + 1).alias("weight"),
    )
    root = convs.agg(
        F.lit(ROOT).alias("key"), F.lit(None).cast("string").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.lit(0).cast("bigint").alias("depth"),
        F.count(F.lit(1)).alias("n_convs"), F.lit(0).cast("bigint").alias("words"), F.coalesce(F.sum("n_turns"), F.lit(0)).cast("bigint").alias("weight"),
    ).filter("n_convs > 0").withColumn("weight", F.col("weight") + 1)
    every = below.unionByName(root)
    children = ways.select("key", "parent_key").distinct().groupBy("parent_key").agg(F.count(F.lit(1)).alias("n_children"))
    out = every.join(children.withColumnRenamed("parent_key", "key"), "key", "left")
    return out.select(
        "key", "parent_key", "conv_id", "depth", "n_convs", F.coalesce("n_children", one - 1).alias("n_children"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("own_saved"), "weight",
    )


# --- sums over subtrees --------------------------------------------------------------------------------------------


def _decompose(parents: list[int], weights: list[int], sums: list[list[int]]) -> None:
    """Turn each node's own values into those of its subtree, in place, for one tree given in order of depth.

    ``parents`` has -1 for the top. Components are split at their centroids; a centroid's total is added along its path
    to the top of the component.
    """
    n = len(parents)
    own = [list(s) for s in sums]
    todo = [list(range(n))]
    where = [0] * n
    components = 1
    while todo:
        members = todo.pop()
        if len(members) == 1:
            continue
        here = where[members[0]]
        inside = {v: weights[v] for v in members}
        children: dict[int, list[int]] = {v: [] for v in members}
        for v in reversed(members):
            p = parents[v]
            if p >= 0 and where[p] == here:
                inside[p] += inside[v]
                children[p].append(v)
        top = members[0]
        path, half = [top], inside[top]
        while True:
            heavy = next((u for u in children[path[-1]] if 2 * inside[u] > half), None)
            if heavy is None:
                break
            path.append(heavy)
        centre = path.pop()
        under = {centre}
        parts: dict[int, list[int]] = {}
        rest = []
        for v in members:
            if v == centre:
                continue
            p = parents[v]
            if v != top and p in under:
                under.add(v)
                first = v if p == centre else where[p]
                if p == centre:
                    where[v] = components
                    parts[components] = [v]
                    components += 1
                else:
                    where[v] = first
                    parts[first].append(v)
            else:
                rest.append(v)
        for values, mine in zip(sums, own):
            total = sum(mine[v] for v in under)
            values[centre] += total - mine[centre]
            for v in path:
                values[v] += total
        where[centre] = -1
        todo.extend(parts.values())
        if rest:
            todo.append(rest)


def _small(ready: DataFrame, names: list[str]) -> DataFrame:
    """(key, sums) of components of at most ``SMALL`` turns, each decomposed by itself."""
    ship(ready.sparkSession)

    def flush(rows: list[tuple]) -> tuple[list, list[list[int]]]:
        index = {row[0]: i for i, row in enumerate(rows)}
        sums = [[row[3 + k] for row in rows] for k in range(len(names))]
        _decompose([index.get(row[1], -1) for row in rows], [row[2] for row in rows], sums)
        return [row[0] for row in rows], sums

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now = None
        keys: list[str] = []
        values: list[list[int]] = [[] for _ in names]

        def emit() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array(v, pa.int64()) for v in values)], ["key", *names])

        def close() -> None:
            k, sums = flush(held)
            keys.extend(k)
            for out, more in zip(values, sums):
                out.extend(more)

        for batch in batches:
            for component, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if component != now and held:
                    close()
                    held = []
                    if len(keys) > 20_000:
                        yield emit()
                        keys, values = [], [[] for _ in names]
                now = component
                held.append(tuple(row))
        if held:
            close()
        if keys:
            yield emit()

    # Nodes of one component arrive together, parents before children.
    dealt = ready.repartition("component").sortWithinPartitions("component", "depth", "key")
    return dealt.select("component", "key", "parent_key", "n_convs", *names).mapInArrow(
        work, "key string, " + ", ".join(f"{n} bigint" for n in names)
    )


def subtree_sums(tree: DataFrame, ways: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """(key, sums): for each node the sum of every expression over its subtree, itself included.

    ``tree`` has key, parent_key, conv_id, depth, n_convs and weight as ``nodes`` gives them, ``ways`` the rows of ``paths``.
    """
    names = list(sums)
    added = [f"added_{n}" for n in names]
    state = materialize(tree.select(
        "key", "parent_key", "conv_id", "depth", "n_convs", "weight", F.lit(ROOT).alias("component"),
        *[e.cast("bigint").alias(n) for n, e in sums.items()], *[F.lit(0).cast("bigint").alias(n) for n in added],
    ), "tree")
    done, ready = [], []
    while True:
        # The top of a component holds its whole weight.
        whole = materialize(state.groupBy("component").agg(F.max("weight").alias("whole")), "weights")
        state = _meet(state, whole, "component", spread=["key"])
        ready.append(state.filter(F.col("whole") <= SMALL).drop("whole"))
        large = state.filter(F.col("whole") > SMALL)
        heavy = large.filter(2 * F.col("weight") > F.col("whole"))
        found = F.max_by(F.struct(F.col("key").alias("centre"), F.col("depth").alias("centre_depth"), F.col("weight").alias("centre_weight")), "depth")
        centres = materialize(heavy.groupBy("component").agg(found.alias("c")).select("component", "c.*"), "centres")
        if centres.isEmpty():
            break
        # Conversations that go on from a centroid, and the child they go to.
        onward = _meet(
            ways.select(F.col("parent_key").alias("centre"), "conv_id", F.col("key").alias("child")),
            centres.select("centre", "component"), "centre", spread=["conv_id"],
        ).drop("centre")
        placed_in = _meet(large, centres, "component", spread=["key"])
        # A node is named by its smallest member, which passes the centroid if the node lies under it.
        chains = placed_in.filter(F.col("depth") > F.col("centre_depth")).select("component", "conv_id").distinct()
        chains = materialize(chains.join(onward, ["component", "conv_id"]).select(F.concat_ws("/", "component", "conv_id").alias("chain"), "child"), "chains")
        labelled = _meet(
            placed_in.withColumn("chain", F.concat_ws("/", "component", "conv_id")), chains, "chain", "left", spread=["key"]
        ).drop("chain")
        under = F.col("child").isNotNull() & (F.col("depth") > F.col("centre_depth"))
        labelled = materialize(labelled.withColumn("under", under | (F.col("key") == F.col("centre"))), "labelled")
        totals = materialize(labelled.filter("under").groupBy("component").agg(*[F.sum(n).alias(f"total_{n}") for n in names]), "totals")
        split = _meet(labelled, totals, "component", spread=["key"])
        centre, above = F.col("key") == F.col("centre"), ~F.col("under") & (2 * F.col("weight") > F.col("whole"))
        split = split.withColumns(
            {a: F.col(a) + F.when(above, F.col(f"total_{n}")).otherwise(0) for n, a in zip(names, added)}
            | {"component": F.when(F.col("under"), F.col("child")).otherwise(F.col("component"))}
            | {"weight": F.col("weight") - F.when(above, F.col("centre_weight")).otherwise(0)}
        )
        done.append(split.filter(centre).select("key", *[(F.col(f"total_{n}") + F.col(a)).alias(n) for n, a in zip(names, added)]))
        state = materialize(split.filter(~centre).select(*[c for c in large.columns if c != "whole"]), "tree")

    small = ready[0]
    for more in ready[1:]:
        small = small.unionByName(more)
    small = materialize(small, "small")
    inside = _small(small, names).withColumnsRenamed({n: f"inside_{n}" for n in names})
    out = small.select("key", *added).join(inside, "key").select(
        "key", *[(F.col(f"inside_{n}") + F.col(a)).alias(n) for n, a in zip(names, added)]
    )
    for more in done:
        out = out.unionByName(more)
    return out


def ends(ways: DataFrame, convs: DataFrame) -> DataFrame:
    """(key, ends_sha256) of the nodes where conversations end: digest of their ids, ascending, joined by commas.

    Ids are joined in blocks of at most ``IDS``; the blocks of a node then stream through its digest one by one.
    """
    last = ways.filter(F.col("depth") == F.col("n_turns")).select("key", "conv_id")
    last = last.unionByName(convs.filter("n_turns = 0").select(F.lit(ROOT).alias("key"), "conv_id"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    blocks = last.groupBy("key", F.shiftright("conv_id", 12).alias("block")).agg(joined.alias("ids"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        row = lambda keys, sums: pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(sums, pa.string())], ["key", "ends_sha256"])
        for batch in batches:
            keys, sums = [], []
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key == now:
                    digest.update(b"," + ids.encode())
                    continue
                if now is not None:
                    keys.append(now)
                    sums.append(digest.hexdigest())
                now, digest = key, hashlib.sha256(ids.encode())
            if keys:
                yield row(keys, sums)
        if now is not None:
            yield row([now], [digest.hexdigest()])

    ship(ways.sparkSession)
    dealt = blocks.repartition("key").sortWithinPartitions("key", "block")
    return dealt.select("key", "ids").mapInArrow(work, "key string, ends_sha256 string")


def trie(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """Per node of the trie of placed ``rows``: key, parent_key, conv_id (smallest member), parent_conv_id, depth, n_convs, n_children, n_leaves and
    saved_tokens of its subtree, ends_sha256. ``convs`` has conv_id and n_turns of all conversations, turnless ones too."""
    ways = materialize(paths(rows), "ways")
    convs = materialize(convs, "convs")
    tree = materialize(nodes(ways, convs), "nodes")
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0)
    rolled = subtree_sums(tree, ways, {"n_leaves": leaf, "saved_tokens": F.col("own_saved")})
    out = tree.join(rolled, "key").join(ends(ways, convs), "key", "left")
    out = materialize(out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest()))).drop("own_saved", "weight"), "trie")
    parents = tree.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    return _meet(out, parents, "parent_key", "left", spread=["key"])


def report(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations with shared openings."""
    rows, convs = with_shared_openings(materialize(placed(conversations), "placed"))
    return trie(rows, convs).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )
