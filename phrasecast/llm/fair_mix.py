"""Mixing sources to target weights by weighted fair queueing.

Every document of a source joins its source's queue in a shuffled order that depends on its id only. A copy's virtual
finish time is the number of words its source has sent by the end of the copy, divided by the source's weight. All
copies are then put into one global order of finish times and cut where the total budget is used up.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from phrasecast.functions.scan import hash_block, hash_order, prefix_sums, skew_join
from phrasecast.llm.common import WORD
from phrasecast.session import materialize

#: Ranges of virtual time that are sorted apart from each other.
RANGES = 4096


@dataclass(frozen=True)
class Mix:
    """``schedule``: taken copies with ``copy``, ``finish`` and ``start_word``; ``documents``: one row per input row."""

    schedule: DataFrame
    documents: DataFrame


def _key() -> Column:
    return F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("source")))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """Per source: size, weight and target words.

    Sources in code-point order (null last) take the weights in turn. A target stops at ``max_repeats`` times the
    source's size; what is left over goes to the others by weight. With sources ordered by the level at which they
    stop, the common level is the first one that is not above the next source's stop.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    per = per.withColumn("weight", F.get(cycle, F.pmod(place, F.lit(len(weights)))))
    per = per.withColumn("stop", F.lit(float(max_repeats)) * F.col("source_size") / F.col("weight"))
    order = Window.orderBy(F.col("stop"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    full = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumns({
        "budget": F.sum("source_size").over(full),
        "gone": F.coalesce(F.sum(F.col("source_size") * max_repeats).over(before), F.lit(0)),
        "share": F.sum("weight").over(rest),
    }).withColumn("level", (F.col("budget") - F.col("gone")) / F.col("share"))
    per = per.withColumn("level", F.min(F.when(F.col("level") <= F.col("stop"), F.struct("stop", "level"))).over(full))
    return per.select(
        "source", "source_size", "source_rows", "weight", "budget",
        F.least(F.col("weight") * F.col("level.level"), F.col("source_size") * float(max_repeats)).alias("target"),
    )


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[float] = (1, 2, 3), max_repeats: int = 3,
) -> Mix:
    """Queue all documents fairly and cut at the total number of words.

    ``documents`` has ``doc_id, source, size, source_size, target, copies, taken`` for every input row; ``schedule``
    one row per taken copy. Null or empty text has size 0 and is never sent on; null sources form one source, the
    last; null ids are shuffled as empty text; rows that agree in id, source and size stand side by side in the queue
    and share one decision per copy, so the total may pass the budget by such twins only. An empty table gives empty
    results. Other input columns, whatever their names, are not read.
    """
    slim = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col)).alias("size"),
    ).withColumn("key", _key())
    slim = materialize(slim, "mix-sizes")
    sources = materialize(source_targets(slim, weights, max_repeats), "mix-sources")
    total = sources.agg(F.sum("source_rows").alias("n")).scalar()
    dims = sources.withColumn("key", _key())
    hot = dims.filter(F.col("source_rows") * 1000 > total)
    rows = skew_join(slim, dims.drop("source", "source_rows"), "key", spread=["doc_id", "size"], hot=hot)
    rows = rows.withColumn("shuffle", hash_order("doc_id"))
    rows = rows.withColumn("shuffle", F.coalesce("shuffle", F.md5(F.lit("").cast("binary"))))
    block = F.coalesce(hash_block("doc_id"), F.substring(F.md5(F.lit("").cast("binary")), 1, 3))
    queued = prefix_sums(rows, ["key"], {"block": block}, ["shuffle", "size"], {"before": F.col("size")})
    queued = materialize(queued.drop("shuffle").withColumn("shuffle", F.coalesce(hash_order("doc_id"), F.lit(""))), "mix-queue")

    copies = queued.filter(F.col("size") > 0).withColumn("copy", F.explode(F.array(*map(F.lit, range(max_repeats)))))
    copies = copies.withColumn("finish", _finish(F.col("copy")))
    longest = sources.agg(F.max(F.lit(max_repeats) * F.col("source_size") / F.col("weight"))).scalar()
    span = F.floor(F.col("finish") / F.greatest(longest, F.lit(1.0)) * RANGES)
    ordered = prefix_sums(copies, [], {"range": span}, ["finish", "key", "shuffle", "size"], {"start_word": F.col("size")})
    ordered = ordered.filter(F.col("start_word") + F.col("size") <= F.col("budget"))
    place = F.struct("finish", "key", "shuffle", "size")
    last = materialize(ordered.agg(F.max(place).alias("last")), "mix-cut").scalar()
    sent = [
        F.when(F.struct(_finish(F.lit(c)), *map(F.col, ("key", "shuffle", "size"))) <= last, 1).otherwise(0)
        for c in range(max_repeats)
    ]
    taken = F.when(F.col("size") > 0, sum(sent[1:], sent[0])).otherwise(F.lit(0))
    documents = queued.withColumn("copies", taken).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken")
    )
    return Mix(ordered.select("doc_id", "source", "copy", "size", "finish", "start_word"), documents)


def _finish(copy: Column) -> Column:
    return (F.col("before") + F.col("size") + copy * F.col("source_size")).cast("double") / F.col("weight")


#: DuckDB twin of ``mix`` over a table ``docs(doc_id, text, source)``.
MIX_SQL = r"""
sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(doc_id::VARCHAR) AS shuffle
  FROM docs),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [1.0, 2.0, 3.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT]::DOUBLE AS weight
  FROM sizes GROUP BY source),
stops AS (SELECT *, 3.0::DOUBLE * source_size / weight AS stop, (sum(source_size) OVER ())::BIGINT AS budget FROM per),
levels AS (
  SELECT *, (budget - coalesce(sum(source_size * 3) OVER (ORDER BY stop, source NULLS LAST
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(weight) OVER (ORDER BY stop, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM stops),
targets AS (
  SELECT source, source_size, weight, budget, least(weight * (SELECT arg_min(level, stop) FROM levels WHERE level <= stop),
         source_size * 3.0::DOUBLE) AS target
  FROM levels),
queued AS (
  SELECT s.doc_id, s.source, s.size, s.shuffle, t.source_size, t.weight, t.target, t.budget,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.shuffle, s.size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
copies AS (
  SELECT *, (before + size + c * source_size)::DOUBLE / weight AS finish
  FROM queued, (VALUES (0), (1), (2)) v(c)),
placed AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source NULLS FIRST, shuffle, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS so_far
  FROM copies WHERE size > 0),
mixed AS (
  SELECT q.doc_id, q.source, q.size, q.source_size, q.target,
         coalesce(sum(p.size) FILTER (WHERE p.so_far <= p.budget), 0)::BIGINT AS taken
  FROM queued q LEFT JOIN placed p ON p.doc_id = q.doc_id
  GROUP BY ALL)
"""
