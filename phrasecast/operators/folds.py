"""Time-aware folds as tables keyed by row id or event id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from phrasecast.functions.scan import global_index, hash_block, hash_order, prefix_sums, skew_join


def labelled_rows(df: DataFrame, target: str, name: str = "label") -> DataFrame:
    """Rows with a target value, the target cast to INT as ``name``."""
    return df.filter(F.col(target).isNotNull()).withColumn(name, F.col(target).cast("int"))


def require_labels(df: DataFrame, target: str, name: str = "label") -> DataFrame:
    """``labelled_rows``, or an error when no row has a target value."""
    kept = labelled_rows(df, target, name)
    if not kept.select(name).take(1):
        raise ValueError("no row has a target value")
    return kept


def _day(rows: DataFrame, date: str) -> Column:
    """The date to order by; rows without one come last."""
    late = F.lit("9999-12-31").cast(rows.schema[date].dataType)
    return F.coalesce(F.col(date), late)


def date_positions(rows: DataFrame, date: str = "event_date", row_id: str = "segment_id") -> DataFrame:
    """``(row_id, date, position)``: 0-based place in date order, ties in md5(row_id) order."""
    slim = rows.select(row_id, date).withColumn("__h", hash_order(row_id))
    blocks = {"day": _day(rows, date), "part": hash_block(row_id)}
    if rows.schema[date].dataType.typeName() != "date":
        blocks = {"date": _day(rows, date).cast("date"), **blocks}  # times of day are unbounded, dates are not
    return prefix_sums(slim, [], blocks, ["__h"], {"position": F.lit(1).cast("bigint")}).drop("__h")


def rolling_borders(
    rows: DataFrame, n_splits: int, date: str = "event_date", row_id: str = "segment_id"
) -> DataFrame:
    """First validation row of every fold: ``(fold, n_train, test_size, day, h)``, ``n_splits`` rows.

    Row positions are only needed at the borders. Days are counted first (their number is bounded by the
    calendar), then the md5 ranges of the few border days, then the rows of one range per border.
    """
    total = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    size = F.greatest(F.lit(1), F.floor(total / (n_splits + 1)))
    days = rows.groupBy(_day(rows, date).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    if rows.schema[date].dataType.typeName() == "date":
        earlier = Window.partitionBy(F.lit(0)).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
        days = days.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    else:  # distinct times are counted date by date
        days = prefix_sums(days, [], {"date": F.col("day").cast("date")}, ["day"], {"before": F.col("n")})
    numbers = F.sequence(F.lit(0), F.lit(n_splits - 1))
    wanted = days.select("day", "n", "before", F.explode(numbers).alias("fold")).withColumn("test_size", size)
    wanted = wanted.withColumn("n_train", total - (n_splits - F.col("fold")) * F.col("test_size"))
    inside = (F.col("n_train") >= F.col("before")) & (F.col("n_train") < F.col("before") + F.col("n"))
    on_days = wanted.filter(inside & (F.col("n_train") > 0)).select(
        "day", "fold", "n_train", "test_size", (F.col("n_train") - F.col("before")).alias("rest")
    )
    # At most n_splits border rows, so they may be broadcast.
    keyed = rows.select(_day(rows, date).alias("day"), F.col(row_id).alias("id"))
    near = keyed.join(F.broadcast(on_days.select("day").distinct()), "day").select(
        "day", hash_order("id").alias("h"), hash_block("id").alias("part")
    )
    in_day = Window.partitionBy("day").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = near.groupBy("day", "part").agg(F.count(F.lit(1)).alias("n"))
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(in_day), F.lit(0)))
    on_parts = (
        parts.join(F.broadcast(on_days), "day")
        .filter((F.col("rest") >= F.col("before")) & (F.col("rest") < F.col("before") + F.col("n")))
        .select("day", "part", "fold", "n_train", "test_size", (F.col("rest") - F.col("before") + 1).alias("nth"))
    )
    last = near.join(F.broadcast(on_parts.select("day", "part").distinct()), ["day", "part"])
    ranked = last.withColumn("nth", F.row_number().over(Window.partitionBy("day", "part").orderBy("h")))
    return ranked.join(F.broadcast(on_parts), ["day", "part", "nth"]).select(
        "fold", "n_train", "test_size", "day", "h"
    )


def rolling_folds(
    rows: DataFrame,
    n_splits: int = 3,
    minimum_train: int = 5,
    date: str = "event_date",
    row_id: str = "segment_id",
) -> DataFrame:
    """``(row_id, fold, role)`` with role train or validate.

    A row is compared with the borders, so the big table is neither sorted nor joined. Folds with fewer
    than ``minimum_train`` training rows are skipped and the rest is numbered from 0.
    """
    borders = rolling_borders(rows, n_splits, date, row_id)
    listed = borders.agg(F.array_sort(F.collect_list(F.struct("fold", "n_train", "day", "h"))).alias("b"))
    marked = rows.select(row_id, _day(rows, date).alias("day"), listed.scalar().alias("borders"))
    marked = marked.withColumn("h", hash_order(row_id))

    def before(border: Column) -> Column:
        return (F.col("day") < border["day"]) | ((F.col("day") == border["day"]) & (F.col("h") < border["h"]))

    def role(border: Column, i: Column) -> Column:
        following = F.get("borders", i + 1)
        valid = ~before(border) & F.coalesce(before(following), F.lit(True))
        name = F.when(before(border), "train").when(valid, "validate")
        return F.struct(border["fold"].alias("fold"), border["n_train"].alias("n_train"), name.alias("role"))

    roles = F.filter(
        F.transform("borders", role),
        lambda r: r["role"].isNotNull() & (r["n_train"] >= minimum_train),
    )
    skipped = F.size(F.filter("borders", lambda b: b["n_train"] < minimum_train))
    return marked.select(row_id, skipped.alias("skipped"), F.explode(roles).alias("r")).select(
        row_id, (F.col("r.fold") - F.col("skipped")).alias("fold"), "r.role"
    )


def leave_one_event_out(rows: DataFrame, minimum_train: int = 5, event: str = "event_id") -> DataFrame:
    """One fold per event in event-id order: ``(fold, event, n_validate, n_train)``.

    The training rows of a fold are all rows of other events; listing them would square the table, so
    the fold table stands for them.
    """
    total = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    sized = rows.groupBy(event).agg(F.count(F.lit(1)).alias("n_validate"))
    sized = sized.withColumn("n_train", total - F.col("n_validate")).filter(F.col("n_train") >= minimum_train)
    return global_index(sized, [event], "fold").select("fold", event, "n_validate", "n_train")


def held_out_rows(rows: DataFrame, folds: DataFrame, row_id: str = "segment_id", event: str = "event_id") -> DataFrame:
    """``(row_id, event, fold)``: the fold that validates a row; hot events are spread."""
    return skew_join(rows.select(row_id, event), folds.select(event, "fold"), event, spread=[row_id]).select(
        row_id, event, "fold"
    )


def stratified_parts(rows: DataFrame, parts: int, label: str = "label", row_id: str = "segment_id") -> DataFrame:
    """Add ``part``: each class cut into ``parts`` equal pieces in md5(row_id) order."""
    keyed = rows.withColumn("__h", hash_order(row_id))
    placed = prefix_sums(
        keyed, [label], {"block": hash_block(row_id)}, ["__h"], {"__at": F.lit(1).cast("bigint")}, totals=True
    )
    return placed.withColumn("part", F.floor(F.col("__at") * parts / F.col("__at_total")).cast("int")).drop(
        "__at", "__at_total", "__h"
    )
