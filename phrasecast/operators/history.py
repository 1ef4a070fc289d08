"""What earlier events and recent articles say: rolling phrase frequency, and news that fades."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from phrasecast.functions.frames import decayed_sums, last_rows
from phrasecast.functions.phrases import vocabulary
from phrasecast.functions.scan import hash_block, hash_order, skew_join
from phrasecast.operators.news import news_target_column
from phrasecast.session import materialize

HALF_LIFE = 24 * 3600


def rolling_frequency(segments: DataFrame, targets: Sequence[str], k: int = 10, by: Sequence[str] = (), block: int = 10_000) -> DataFrame:
    """Per phrase and event (and per ``by`` column, such as the speaker): how often the last ``k`` earlier events had it.

    ``past_events`` are those seen (at most ``k``), ``past_rate`` the share of them with a hit, ``trend`` the share in the newer
    half of the ``k`` minus that in the older half, ``surprise`` this event's flag minus ``past_rate``. Events are ordered by
    date, then md5 of the id; events without a date are left out; rates of no events are NULL.
    """
    if k < 2:
        raise ValueError("at least two events")
    by = list(by)
    flags = (
        segments.filter(F.col("event_date").isNotNull()).groupBy("event_id", "event_date", *by)
        .agg(*[F.coalesce(F.bool_or(F.col(t).cast("boolean")), F.lit(False)).cast("int").alias(t) for t in targets])
    )
    long = flags.unpivot(["event_id", "event_date", *by], list(targets), "target", "was_said").withColumn("__h", hash_order("event_id"))
    long, half = materialize(long, "flags"), k // 2
    out = last_rows(
        long, ["target", *by], {"day": F.col("event_date"), "part": hash_block("event_id", 2)}, ["__h"], k,
        {
            "past_events": lambda frame: F.count(F.lit(1)).over(frame(-k, -1)),
            "past_rate": lambda frame: F.avg("was_said").over(frame(-k, -1)),
            "__new": lambda frame: F.avg("was_said").over(frame(-half, -1)),
            "__old": lambda frame: F.avg("was_said").over(frame(-k, -half - 1)),
        },
        block,
    )
    return out.withColumns(
        {"trend": F.col("__new") - F.col("__old"), "surprise": F.col("was_said") - F.col("past_rate")}
    ).drop("__h", "__new", "__old")


def _measures(terms: Sequence[str]) -> dict[str, str]:
    counts = [news_target_column(p.column) for p in vocabulary(terms)]
    return {"decayed_articles": "__one", **{f"decayed_{c}": c for c in counts}}


def decaying_news(copies: DataFrame, terms: Sequence[str], half_life: int = HALF_LIFE, block: int | None = None) -> DataFrame:
    """``(event_id, seen_at, decayed_...)``: at each publication time (Unix seconds) the fading counts of articles and phrases so far.

    Articles without a readable time are left out.
    """
    timed = copies.withColumns({"seen_at": F.unix_timestamp("published_time"), "__one": F.lit(1)})
    return decayed_sums(timed, ["event_id"], "seen_at", {n: F.col(c) for n, c in _measures(terms).items()}, half_life, block)


def decayed_event_features(copies: DataFrame, starts: DataFrame, terms: Sequence[str], half_life: int = HALF_LIFE) -> DataFrame:
    """Per event of ``starts(event_id, starts_at)``: sum, mean and greatest weight of its articles published until it starts, and the
    weighted phrase counts; an article's weight halves every ``half_life`` seconds before the start. 0 and NULL without articles."""
    joined = skew_join(copies, starts.select("event_id", F.unix_timestamp("starts_at").alias("__start")), "event_id", spread=["article_id"])
    age = F.col("__start") - F.unix_timestamp("published_time")
    weighted = joined.withColumn("__w", F.pow(F.lit(2.0), -age / float(half_life))).filter(age >= 0)
    counts = [news_target_column(p.column) for p in vocabulary(terms)]
    found = weighted.groupBy("event_id").agg(
        F.sum("__w").alias("decayed_articles"), F.avg("__w").alias("mean_weight"), F.max("__w").alias("max_weight"),
        *[F.sum(F.col("__w") * F.col(c)).alias(f"decayed_{c}") for c in counts],
    )
    zero = ["decayed_articles", *[f"decayed_{c}" for c in counts]]
    return starts.select("event_id").join(found, "event_id", "left").fillna(0.0, subset=zero)
