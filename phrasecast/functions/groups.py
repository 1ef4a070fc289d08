"""Connected groups of items that share keys, for keys and groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from phrasecast.functions.scan import skew_join
from phrasecast.session import materialize


#: Hooks of at most so many nodes are broadcast; their number falls from round to round.
BROADCAST_ROWS = 100_000


def _looked_up(rows: DataFrame, column: str, table: DataFrame, size: int) -> DataFrame:
    """Replace ``column`` by its ``parent`` in ``table(node, parent)`` of ``size`` rows, where it has one."""
    named = table.select(F.col("node").alias(column), "parent")
    if size <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(named), column, "left")
    else:
        joined = skew_join(rows, named, column, "left")
    return joined.withColumn(column, F.coalesce("parent", column)).drop("parent")


def connected_groups(pairs: DataFrame) -> DataFrame:
    """``(item, group)`` for ``pairs(item, key)``: the smallest item reachable over shared keys.

    The items of a key are linked to its smallest item, so a key with n items has n - 1 links. Each round hooks every node to
    its smallest neighbour, follows the hooks to their ends by doubling, and contracts the links to the ends. Only nodes
    smaller than all their neighbours stay, at most half of those that still have links, so there are at most log2(n)
    rounds. A NULL key links nothing; rows without an item are left out.
    """
    rows = materialize(pairs.filter(F.col("item").isNotNull()).select("item", "key").distinct(), "pairs")
    centres = rows.filter(F.col("key").isNotNull()).groupBy("key").agg(F.min("item").alias("centre"))
    linked = skew_join(rows.filter(F.col("key").isNotNull()), centres, "key", spread=["item"])
    links = materialize(linked.filter("item <> centre").select(F.col("centre").alias("a"), F.col("item").alias("b")).distinct(), "links")

    out = rows.select("item").distinct().withColumn("group", F.col("item"))
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("parent"))
        hooks = materialize(hooks, "hooks")
        size = hooks.count()
        while True:
            further = hooks.select("node", F.col("parent").alias("was"), F.col("parent").alias("up"))
            further = materialize(_looked_up(further, "up", hooks, size), "hooks")
            hooks = further.select("node", F.col("up").alias("parent"))
            if further.filter("up <> was").isEmpty():
                break
        out = materialize(_looked_up(out, "group", hooks, size), "groups")
        moved = _looked_up(_looked_up(links, "a", hooks, size), "b", hooks, size).filter("a <> b")
        links = materialize(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    return out
