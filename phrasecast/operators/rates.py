"""Event flags, base rates, intervals, hit counts and series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from phrasecast.functions.numbers import kelly_edge, wilson_high, wilson_low
from phrasecast.functions.scan import global_index, hash_block, hash_order, prefix_sums



def _phrase(column: Column) -> Column:
    return F.regexp_replace(column, "^target__", "")


def _by_date(df: DataFrame) -> DataFrame:
    """Chronological rows, those without a date at the end."""
    return df.orderBy(F.asc_nulls_last("event_date"), "event_id")


def event_flags(segments: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Per event: was the phrase said at least once."""
    return segments.groupBy("event_id").agg(
        *[F.bool_or(F.col(t).cast("boolean")).alias(t) for t in targets]
    )


def event_counts(segments: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Per event: number of segments with the phrase."""
    return segments.groupBy("event_id").agg(
        *[F.coalesce(F.sum(F.col(t).cast("bigint")), F.lit(0)).alias(t) for t in targets]
    )


def _mean_per_target(per_event: DataFrame, targets: Sequence[str], name: str) -> DataFrame:
    # All columns are averaged in one pass; only the single result row is turned into rows.
    means = per_event.agg(*[F.avg(F.col(t).cast("double")).alias(t) for t in targets])
    long = means.unpivot([], list(targets), "target", name)
    return long.withColumn("target", _phrase(F.col("target"))).orderBy(F.desc(name), "target")


def base_rates(segments: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Share of events with the phrase, highest first."""
    return _mean_per_target(event_flags(segments, targets), targets, "historical_prob")


def mean_hits(segments: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Mean number of segments with the phrase per event, highest first."""
    return _mean_per_target(event_counts(segments, targets), targets, "avg_num")


def rate_intervals(segments: DataFrame, targets: Sequence[str], z: float = 1.96) -> DataFrame:
    """Base rate per phrase with k, n and the Wilson interval, highest first."""
    totals = event_flags(segments, targets).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.coalesce(F.sum(F.col(t).cast("bigint")), F.lit(0)).alias(t) for t in targets],
    )
    long = totals.unpivot(["n"], list(targets), "target", "k")
    return long.select(
        _phrase(F.col("target")).alias("target"),
        "k",
        "n",
        (F.col("k") / F.col("n")).alias("prob"),
        wilson_low(F.col("k"), F.col("n"), z).alias("ci_lo"),
        wilson_high(F.col("k"), F.col("n"), z).alias("ci_hi"),
    ).orderBy(F.desc("prob"), "target")


def top_phrases(rates: DataFrame, n: int = 15) -> DataFrame:
    """The ``n`` phrases with the highest base rate."""
    return rates.orderBy(F.desc("prob"), "target").limit(n)


def event_series(segments: DataFrame, target: str, counts: bool = False) -> DataFrame:
    """One phrase over the events in date order, as a flag or as a number of segments."""
    if counts:
        dated = segments.filter(F.col("event_date").isNotNull()).groupBy("event_id", "event_date")
        out = dated.agg(F.coalesce(F.sum(F.col(target).cast("bigint")), F.lit(0)).alias("hit_count"))
    else:
        out = segments.groupBy("event_id").agg(
            F.max("event_date").alias("event_date"), F.bool_or(target).alias("was_said")
        )
    return _by_date(out)


def events_in_order(segments: DataFrame) -> DataFrame:
    """Distinct events with their date, in chronological order."""
    return _by_date(segments.select("event_id", "event_date").distinct())


def hit_matrix(segments: DataFrame, targets: Sequence[str], counts: bool = False) -> DataFrame:
    """Events (chronological rows) by phrases (columns), flags as 0/1 or counts."""
    per_event = event_counts(segments, targets) if counts else event_flags(segments, targets)
    dated = per_event.join(event_dates(segments), "event_id", "left")
    return _by_date(dated.select("event_id", "event_date", *[F.col(t).cast("bigint").alias(t) for t in targets]))


def event_dates(segments: DataFrame) -> DataFrame:
    """Event -> date; both sides of a join on it hold one row per event and date."""
    return segments.select("event_id", "event_date").distinct()


def cumulative_share(segments: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Per phrase: running share of events with a hit, by date (ties in md5(event_id) order)."""
    dated = (
        segments.filter(F.col("event_date").isNotNull())
        .groupBy("event_id", "event_date")
        .agg(*[F.bool_or(F.col(t).cast("boolean")).cast("bigint").alias(t) for t in targets])
    )
    # The wide table is scanned once for all phrases; rows per phrase are made last.
    said = {t: F.coalesce(F.col(t), F.lit(0)) for t in targets}
    sums = {"event_index": F.lit(1).cast("bigint"), **{f"__c{i}": said[t] for i, t in enumerate(targets)}}
    blocks = {"day": F.col("event_date"), "part": hash_block("event_id", 2)}
    run = prefix_sums(dated.withColumn("__h", hash_order("event_id")), [], blocks, ["__h"], sums)
    parts = [
        F.struct(_phrase(F.lit(t)).alias("target"), F.col(t).alias("was_said"), (F.col(f"__c{i}") + said[t]).alias("cum_was_said"))
        for i, t in enumerate(targets)
    ]
    long = run.select("event_id", "event_date", (F.col("event_index") + 1).alias("event_index"), F.explode(F.array(*parts)).alias("p"))
    long = long.select("event_id", "event_date", "p.target", "p.was_said", "event_index", "p.cum_was_said")
    return long.withColumn("cum_share", F.col("cum_was_said") / F.col("event_index"))


def _share(long: DataFrame, keys: Sequence[str], blocks: dict[str, Column], order: Sequence[str]) -> DataFrame:
    run = prefix_sums(
        long.withColumn("__m", F.coalesce("was_said", F.lit(0))),
        keys,
        blocks,
        order,
        {"event_index": F.lit(1).cast("bigint"), "cum_was_said": F.col("__m")},
    )
    run = run.withColumn("event_index", F.col("event_index") + 1)
    run = run.withColumn("cum_was_said", F.col("cum_was_said") + F.col("__m")).drop("__m")
    return run.withColumn("cum_share", F.col("cum_was_said") / F.col("event_index"))


def cumulative_share_undated(segments: DataFrame, target: str) -> DataFrame:
    """Running share by event id, for tables without dates; ``event_index`` is the x axis."""
    flags = event_flags(segments, [target]).select("event_id", F.col(target).cast("bigint").alias("was_said"))
    placed = global_index(flags, ["event_id"], "place")
    block = {"block": F.floor(F.col("place") / 65536)}
    return _share(placed, [], block, ["place"]).drop("place")


def event_probability(scored: DataFrame, probability: str = "probability") -> DataFrame:
    """Segment probabilities to one per event: 1 - prod(1 - p), and the mean and the maximum."""
    p = F.col(probability)
    miss = F.sum(F.when(p < 1, F.log1p(-p)))
    return scored.groupBy("event_id").agg(
        F.when(F.max(p) >= 1, F.lit(1.0)).otherwise(1 - F.exp(miss)).alias("any_segment"),
        F.avg(p).alias("mean_segment"),
        F.max(p).alias("max_segment"),
    )


def edge_report(rates: DataFrame, prices: DataFrame) -> DataFrame:
    """Base rates against market probabilities ``(target, market_prob)``.

    ``rates`` has one row per tracked phrase, so its size is the vocabulary given on the driver.
    """
    joined = prices.join(F.broadcast(rates), "target")
    market = F.col("market_prob")
    return joined.select(
        F.col("target").alias("phrase"),
        F.round("prob", 3).alias("my_prob"),
        F.round("ci_lo", 3).alias("conservative_prob"),
        F.round(market, 3).alias("market_prob"),
        F.round(kelly_edge(F.col("prob"), market), 4).alias("edge_prob_based"),
        F.round(kelly_edge(F.col("ci_lo"), market), 4).alias("edge_conservative"),
    )
