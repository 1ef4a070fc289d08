"""Window frames and ranks over keys of any size: decaying sums, trailing days, the last rows, places in value order.

A plain window puts a key into one task. Here rows are cut into blocks whose size the clock, the calendar or a parameter
bounds, and what a frame needs from outside its block is carried in: a decayed state, day totals, or copies of the rows
just before the block. Rows with a NULL key or order value are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from phrasecast.functions.scan import prefix_sums, skew_join
from phrasecast.session import materialize


def _present(columns: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull()
    return out


def join_on(fact: DataFrame, dim: DataFrame, on: Sequence[str], how: str = "left", spread: Sequence[str] | None = None) -> DataFrame:
    """``skew_join`` on several columns; ``dim`` has one row for each of their values."""
    key = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(on)])
    out = skew_join(fact.withColumn("__k", key), dim.withColumn("__k", key).drop(*on), "__k", how, spread or fact.columns)
    return out.drop("__k")


def decayed_sums(
    df: DataFrame, keys: Sequence[str], time: str, values: Mapping[str, Column], half_life: int, block: int | None = None
) -> DataFrame:
    """``(keys, time, names)``: at each time of a key, the sums of all values so far, halved every ``half_life`` seconds.

    ``time`` counts seconds. Values of one second are added up first, so a block of ``block`` seconds (a quarter of a
    half-life by default) has no more rows than seconds. The state of a block, its decayed sum at the block's end, combines
    associatively: the earlier one decays by the time between them and is added. Blocks of 16 half-lives are scanned as
    plain sums relative to their start; of those, 70 reach back to where a double is 0.
    """
    keys, names = list(keys), list(values)
    block = block or max(1, half_life // 4)
    span = -(-16 * half_life // block) * block
    decay = lambda seconds: F.pow(F.lit(2.0), -seconds / F.lit(float(half_life)))

    work = df.withColumns({f"__v_{n}": v for n, v in values.items()}).filter(_present([*keys, time]))
    sums = work.groupBy(*keys, time).agg(*[F.sum(f"__v_{n}").cast("double").alias(f"__v_{n}") for n in names])
    sums = materialize(sums, "decayed")  # read by three branches
    sums = sums.withColumns({"__b": F.floor(F.col(time) / block).cast("bigint"), "__s": F.floor(F.col(time) / span).cast("bigint")})
    inside = F.col(time) - F.col("__b") * block  # seconds since the block began
    offset = F.col("__b") * block - F.col("__s") * span  # and from the span to the block
    grown = sums.withColumns({f"__g_{n}": F.coalesce(f"__v_{n}", F.lit(0.0)) * decay(-inside) for n in names})

    of_block = grown.groupBy(*keys, "__s", "__b").agg(*[F.sum(f"__g_{n}").alias(f"__t_{n}") for n in names])
    of_block = of_block.withColumns({f"__t_{n}": F.col(f"__t_{n}") * decay(-offset) for n in names})
    of_span = of_block.groupBy(*keys, "__s").agg(*[F.sum(f"__t_{n}").alias(f"__t_{n}") for n in names])
    older = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__s").rangeBetween(-70, -1)
    listed = of_span.withColumn("__list", F.collect_list(F.struct("__s", *[f"__t_{n}" for n in names])).over(older))

    def carried(name: str) -> Column:
        age = lambda x: (F.col("__s") - x["__s"]) * span
        return F.aggregate("__list", F.lit(0.0), lambda acc, x: acc + x[f"__t_{name}"] * decay(age(x)))

    spans = listed.select(*keys, "__s", *[carried(n).alias(f"__c_{n}") for n in names])
    earlier = Window.partitionBy(*keys, "__s").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = of_block.withColumns({f"__e_{n}": F.coalesce(F.sum(f"__t_{n}").over(earlier), F.lit(0.0)) for n in names})
    blocks = blocks.join(spans, [*keys, "__s"]).select(
        *keys, "__s", "__b", *[((F.col(f"__e_{n}") + F.col(f"__c_{n}")) * decay(offset)).alias(f"__c_{n}") for n in names]
    )
    running = Window.partitionBy(*keys, "__s", "__b").orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    rows = grown.withColumns({f"__r_{n}": F.sum(f"__g_{n}").over(running) for n in names}).join(blocks, [*keys, "__s", "__b"])
    return rows.select(*keys, time, *[((F.col(f"__r_{n}") + F.col(f"__c_{n}")) * decay(inside)).alias(n) for n in names])


def trailing_moments(df: DataFrame, keys: Sequence[str], day: str, value: str, days: int = 90) -> DataFrame:
    """``(keys, day, n, mean, std)`` of the values of the last ``days`` days, the row's day included.

    A day of a key is first reduced to count, mean and squared deviations. Buckets of ``days`` days hold their own days and
    those of the bucket before them, at most twice ``days`` rows; a frame merges at most ``days`` of them. ``std`` is
    that of a sample, NULL for a single value. NULL and NaN values do not count.
    """
    keys = list(keys)
    x = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    daily = (
        df.withColumn("__x", x).filter(_present([*keys, day])).groupBy(*keys, day)
        .agg(F.count("__x").alias("n"), F.avg("__x").alias("m"), (F.var_pop("__x") * F.count("__x")).alias("d"))
        .withColumn("__at", F.datediff(F.col(day), F.lit("1970-01-01").cast("date")))
    )
    own = F.floor(F.col("__at") / days)
    copied = daily.withColumn("__own", own).withColumn("__bucket", F.explode(F.array(own, own + 1)))
    frame = Window.partitionBy(*keys, "__bucket").orderBy("__at").rangeBetween(-(days - 1), 0)
    part = F.when(F.col("n") > 0, F.struct("n", "m", "d"))
    listed = copied.withColumn("__l", F.collect_list(part).over(frame)).filter(F.col("__own") == F.col("__bucket"))
    count = F.aggregate("__l", F.lit(0).cast("bigint"), lambda acc, p: acc + p["n"])
    total = F.aggregate("__l", F.lit(0.0), lambda acc, p: acc + p["n"] * p["m"])
    merged = listed.withColumn("__n", count).withColumn("mean", F.when(F.col("__n") > 0, total / F.col("__n")))
    apart = F.aggregate("__l", F.lit(0.0), lambda acc, p: acc + p["d"] + p["n"] * F.pow(p["m"] - F.col("mean"), F.lit(2)))
    std = F.when(F.col("__n") > 1, F.sqrt(apart / (F.col("__n") - 1)))
    return merged.select(*keys, day, F.col("__n").alias("n"), "mean", std.alias("std"))


def last_rows(
    df: DataFrame, keys: Sequence[str], blocks: Mapping[str, Column], order: Sequence[str], k: int,
    columns: Mapping[str, Callable[[Callable[[int, int], WindowSpec]], Column]], block: int = 10_000,
) -> DataFrame:
    """Add columns over frames of the up to ``k`` rows before each row of its key.

    Each column is a function of ``frame(first, last)``, which gives the rows at these offsets (at least ``-k``). Places come
    from ``prefix_sums`` (see there for ``blocks`` and ``order``). Rows are cut into blocks of ``block`` places; a block also
    gets copies of the ``k`` rows before it, from as many earlier blocks as that takes.
    """
    keys = list(keys)
    placed = prefix_sums(df.filter(_present(keys)), keys, blocks, order, {"__p": F.lit(1).cast("bigint")})
    first, last = F.floor(F.col("__p") / block), F.floor((F.col("__p") + k) / block)
    copied = placed.withColumn("__own", first).withColumn("__f", F.explode(F.sequence(first, last)))

    def frame(low: int, high: int) -> WindowSpec:
        if low < -k:
            raise ValueError(f"a frame may reach back {k} rows")
        return Window.partitionBy(*keys, "__f").orderBy("__p").rowsBetween(low, high)

    out = copied.withColumns({name: make(frame) for name, make in columns.items()})
    return out.filter(F.col("__own") == F.col("__f")).drop("__own", "__f", "__p")


def ordered_totals(values: DataFrame, keys: Sequence[str], value: str, sums: Sequence[str]) -> DataFrame:
    """Add ``before_<sum>`` and ``total_<sum>``: what the smaller values of the key hold, and all of them.

    ``values`` has one row per key and value. They are sorted in ranges, whatever their key, and written, which pins the
    ranges; running totals inside a range start from the totals of the ranges before it (one row each).
    """
    keys, order = list(keys), [*keys, value]
    ranges = values.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    ranges = materialize(ranges, "ranges")
    # One row per range goes through this window.
    before = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.groupBy("__part").agg(*[F.sum(s).alias(f"__t_{s}") for s in sums])
    offsets = offsets.select("__part", *[F.coalesce(F.sum(f"__t_{s}").over(before), F.lit(0)).alias(f"__o_{s}") for s in sums])
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    run = ranges.withColumns({f"__r_{s}": F.coalesce(F.sum(s).over(inside), F.lit(0)) for s in sums})
    run = run.join(F.broadcast(offsets), "__part").withColumns({f"__r_{s}": F.col(f"__r_{s}") + F.col(f"__o_{s}") for s in sums})
    run = run.drop("__part", *[f"__o_{s}" for s in sums])
    if not keys:
        whole = run.agg(*[F.sum(s).alias(s) for s in sums])
        return run.withColumns(
            {f"before_{s}": F.col(f"__r_{s}") for s in sums} | {f"total_{s}": whole.select(s).scalar() for s in sums}
        ).drop(*[f"__r_{s}" for s in sums])
    starts = run.groupBy(*keys).agg(
        *[F.min(f"__r_{s}").alias(f"__s_{s}") for s in sums], *[F.sum(s).alias(f"total_{s}") for s in sums]
    )
    out = join_on(run, starts, keys, "inner")
    out = out.withColumns({f"before_{s}": F.col(f"__r_{s}") - F.col(f"__s_{s}") for s in sums})
    return out.drop(*[f"__{x}_{s}" for x in "rs" for s in sums])


def value_counts(df: DataFrame, keys: Sequence[str], value: str, name: str = "n") -> DataFrame:
    """``(keys, value, n)`` of the values that are neither NULL nor NaN, as double."""
    x = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    rows = df.select(*keys, x.alias("value")).filter(_present([*keys, "value"]))
    return rows.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias(name))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """``(keys, names)``: quantiles of each key, linear between neighbouring values."""
    keys = list(keys)
    ranks = ordered_totals(value_counts(df, keys, value), keys, "value", ["n"])
    here = lambda place: F.max(F.when((F.col("before_n") <= place) & (place < F.col("before_n") + F.col("n")), F.col("value")))
    aggs = [F.max("total_n").alias("__total")]
    for name, q in probs.items():
        at = F.lit(float(q)) * (F.col("total_n") - 1)
        aggs += [here(F.floor(at)).alias(f"__lo_{name}"), here(F.ceil(at)).alias(f"__hi_{name}")]
    found = ranks.groupBy(*keys).agg(*aggs).filter("__total IS NOT NULL")

    def between(name: str, q: float) -> Column:
        at = F.lit(float(q)) * (F.col("__total") - 1)
        low, high = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        return (low + (high - low) * (at - F.floor(at))).alias(name)

    return found.select(*keys, *[between(n, q) for n, q in probs.items()])


def sketched_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float], error: float = 1e-4) -> DataFrame:
    """``(keys, names)``: values of the data whose rank is off by at most ``error`` times the key's rows.

    The summaries merge, so a key of any size is reduced in its tasks and only summaries are shuffled.
    """
    if not 0 < error < 1:
        raise ValueError("the error is a share of the rows")
    x = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    rows = df.withColumn("__x", x).filter(_present([*keys, "__x"]))
    wanted = F.array(*[F.lit(float(q)) for q in probs.values()])
    found = F.percentile_approx("__x", wanted, int(1 / error)).alias("__q")
    return rows.groupBy(*keys).agg(found).filter("__q IS NOT NULL").select(*keys, *[F.col("__q")[i].alias(n) for i, n in enumerate(probs)])
