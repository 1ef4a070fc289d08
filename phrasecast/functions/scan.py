"""Running totals, row numbers and joins that survive a key holding a large share of all rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from phrasecast.session import materialize


def prefix_sums(
    df: DataFrame,
    keys: Sequence[str],
    blocks: Mapping[str, Column],
    order: Sequence[str],
    sums: Mapping[str, Column],
    totals: bool = False,
) -> DataFrame:
    """Add exclusive running totals per ``keys``, in the order ``blocks`` then ``order``.

    A plain window would put one key into one task. Here every block column splits its parent group
    (each block value must be monotone in ``order``). The totals of the blocks are added up level by
    level, then joined once to the rows on the finest block, by which the rows are partitioned anyway;
    so no task sees more than one block of rows or one list of block totals. All steps are deterministic
    and lazy. With ``totals`` a ``<name>_total`` column per key is added. Key, block and order columns
    must not be NULL.
    """
    keys, names = list(keys), list(sums)
    block_names = [f"__b{i}" for i in range(len(blocks))]
    work = df.withColumns(dict(zip(block_names, blocks.values())))
    work = work.withColumns({f"__v_{n}": sums[n] for n in names})

    def earlier(group: list[str], order_by: Sequence[str]) -> WindowSpec:
        spec = Window.partitionBy(*(group or [F.lit(0)])).orderBy(*order_by)
        return spec.rowsBetween(Window.unboundedPreceding, -1)

    finest = work.groupBy(*keys, *block_names).agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in names])
    offsets = None
    for depth in range(1, len(block_names) + 1):
        parent, group = keys + block_names[: depth - 1], keys + block_names[:depth]
        level = finest
        if depth < len(block_names):
            level = finest.groupBy(*group).agg(*[F.sum(f"__t_{n}").alias(f"__t_{n}") for n in names])
        before = earlier(parent, block_names[depth - 1 : depth])
        found = {f"__s_{n}": F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)) for n in names}
        if totals and depth == 1:
            whole = Window.partitionBy(*(keys or [F.lit(0)]))
            found |= {f"{n}_total": F.sum(f"__t_{n}").over(whole) for n in names}
        level = level.withColumns(found).drop(*[f"__t_{n}" for n in names])
        if offsets is None:
            offsets = level.withColumnsRenamed({f"__s_{n}": f"__o_{n}" for n in names})
        else:
            level = level.join(offsets, parent)
            offsets = level.withColumns({f"__o_{n}": F.col(f"__o_{n}") + F.col(f"__s_{n}") for n in names})
            offsets = offsets.drop(*[f"__s_{n}" for n in names])

    inside = earlier(keys + block_names, order)
    out = work.withColumns({f"__i_{n}": F.coalesce(F.sum(f"__v_{n}").over(inside), F.lit(0)) for n in names})
    out = out.join(offsets, keys + block_names)
    out = out.withColumns({n: F.col(f"__i_{n}") + F.col(f"__o_{n}") for n in names})
    return out.drop(*block_names, *[f"__{x}_{n}" for x in "vio" for n in names])


def global_index(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Add a dense 0-based ``name`` in the global order of the unique columns ``order``.

    Range partition, sort inside partitions, write to the shared folder, then add the offset of each
    partition (one row per partition, so the offset table has a fixed bound). The written table pins
    the sampled range borders, which a recomputation could move.
    """
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("__at", F.monotonically_increasing_id())
        .withColumn("__part", F.shiftright("__at", 33))
        .withColumn("__pos", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("__at")
    )
    placed = materialize(placed, "index")
    before = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("__part")
        .agg(F.count(F.lit(1)).alias("__n"))
        .select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    )
    return (
        placed.join(F.broadcast(offsets), "__part")
        .withColumn(name, F.col("__pos") + F.col("__off"))
        .drop("__part", "__pos", "__off")
    )


def hash_block(column: str, digits: int = 3) -> Column:
    """Leading hex digits of the md5 of an id: an evenly spread block, monotone in ``md5(id)``."""
    return F.substring(F.md5(F.col(column).cast("string").cast("binary")), 1, digits)


def hash_order(column: str) -> Column:
    return F.md5(F.col(column).cast("string").cast("binary"))


def skew_join(
    fact: DataFrame,
    dim: DataFrame,
    on: str,
    how: str = "inner",
    spread: Sequence[str] | None = None,
    hot: DataFrame | None = None,
    hot_share: int = 1000,
    salts: int = 64,
) -> DataFrame:
    """Join ``fact`` to ``dim`` (unique on ``on``) with hot fact keys spread over ``salts`` tasks.

    A key is hot when it holds more than 1/``hot_share`` of the fact rows, so there are fewer than
    ``hot_share`` hot keys: that bound is what allows the broadcast of the hot list. Only hot rows of
    ``dim`` are copied. ``spread`` names the fact columns that choose the salt (a row id, best); ``how``
    is inner or left. A caller that knows the key counts passes the hot keys itself as ``hot``.
    """
    if how not in ("inner", "left"):
        raise ValueError("skew_join supports inner and left joins")
    if hot is None:
        counts = fact.groupBy(on).agg(F.count(F.lit(1)).alias("__n"))
        total = counts.agg(F.sum("__n").alias("__total"))
        hot = counts.filter(F.col(on).isNotNull() & (F.col("__n") * hot_share > total.scalar()))
    hot = hot.select(on, F.lit(True).alias("__hot"))
    salt = F.pmod(F.xxhash64(*(spread or fact.columns)), F.lit(salts)).cast("int")
    left = (
        fact.join(F.broadcast(hot), on, "left")
        .withColumn("__salt", F.when(F.col("__hot") | F.col(on).isNull(), salt).otherwise(F.lit(0)))
        .drop("__hot")
    )
    right = (
        dim.join(F.broadcast(hot), on, "left")
        .withColumn(
            "__salt",
            F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))),
        )
        .drop("__hot")
    )
    return left.join(right, [on, "__salt"], how).drop("__salt")

