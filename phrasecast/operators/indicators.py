"""Indicators by day: trailing z-scores, winsorising, missing flags, filled gaps, and drift between two tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from phrasecast.functions.frames import (
    exact_quantiles, join_on, ordered_totals, sketched_quantiles, trailing_moments, value_counts,
)

#: Least share of a bin in the stability index, for bins that one of the tables leaves empty.
EMPTY_SHARE = 1e-4
DRIFT_LIMIT = 0.2


def _number(column: str) -> Column:
    return F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))


def trailing_zscores(df: DataFrame, keys: Sequence[str], day: str, value: str, days: int = 90, out: str = "zscore") -> DataFrame:
    """Rows with ``out``: distance from the mean of the last ``days`` days in standard deviations.

    0 where all values of the window are equal; NULL where it has one value, or the row's key, day or value is NULL or NaN.
    """
    stats = trailing_moments(df, keys, day, value, days).select(*keys, day, F.col("mean").alias("__mean"), F.col("std").alias("__std"))
    joined = join_on(df, stats, [*keys, day])
    apart = _number(value) - F.col("__mean")
    score = F.when(F.col("__std") > 0, apart / F.col("__std")).when(F.col("__std") == 0, apart * 0)
    return joined.withColumn(out, score).drop("__mean", "__std")


def fit_bounds(
    df: DataFrame, keys: Sequence[str], value: str, low: float = 0.01, high: float = 0.99, error: float | None = None
) -> DataFrame:
    """``(keys, low, high)``: exact quantiles, or with ``error`` sketched ones whose ranks are off by at most that share."""
    if not 0 <= low <= high <= 1:
        raise ValueError("bounds need 0 <= low <= high <= 1")
    probs = {"low": low, "high": high}
    return exact_quantiles(df, keys, value, probs) if error is None else sketched_quantiles(df, keys, value, probs, error)


def winsorise(df: DataFrame, keys: Sequence[str], value: str, bounds: DataFrame, out: str | None = None) -> DataFrame:
    """Values moved to the nearer bound of their key where they lie outside; keys without bounds keep theirs."""
    named = bounds.select(*keys, F.col("low").alias("__low"), F.col("high").alias("__high"))
    joined = join_on(df, named, keys)
    x = _number(value)
    inside = F.least(F.greatest(x, F.coalesce("__low", x)), F.coalesce("__high", x))
    return joined.withColumn(out or value, F.when(x.isNotNull(), inside)).drop("__low", "__high")


def missing_flags(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add ``<column>_missing`` for NULL, and NaN in floating columns."""
    kinds = dict(df.dtypes)
    nan = lambda c: F.isnan(c) if kinds[c] in ("double", "float") else F.lit(False)
    return df.withColumns({f"{c}_missing": F.col(c).isNull() | F.coalesce(nan(c), F.lit(False)) for c in columns})


# --- gaps ----------------------------------------------------------------------------------------------------------


def fit_fills(df: DataFrame, numeric: Sequence[str] = (), categorical: Sequence[str] = ()) -> DataFrame:
    """``(column, number, category)``: the median of each numeric column, the most frequent value of each categorical one.

    Of equally frequent values the smallest is taken. A column without any value has no row. Medians of all columns come
    from one sort, in which a column is a key of any size.
    """
    if not numeric and not categorical:
        raise ValueError("no columns to fill")
    parts = []
    if numeric:
        long = df.select(*[_number(c).alias(c) for c in numeric]).unpivot([], list(numeric), "column", "value")
        medians = exact_quantiles(long, ["column"], "value", {"number": 0.5})
        parts.append(medians.select("column", "number", F.lit(None).cast("string").alias("category")))
    if categorical:
        long = df.select(*[F.col(c).cast("string").alias(c) for c in categorical]).unpivot([], list(categorical), "column", "category")
        counts = long.filter("category IS NOT NULL").groupBy("column", "category").agg(F.count(F.lit(1)).alias("n"))
        best = F.min_by("category", F.struct(-F.col("n"), F.col("category"))).alias("category")
        parts.append(counts.groupBy("column").agg(best).select("column", F.lit(None).cast("double").alias("number"), "category"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def fill_gaps(df: DataFrame, fills: DataFrame, numeric: Sequence[str] = (), categorical: Sequence[str] = ()) -> DataFrame:
    """Rows with NULL (in numeric columns also NaN) replaced by the fitted values; columns without one stay as they are.

    Numeric columns become double, categorical ones text. The values are read as scalars: one per column.
    """
    one = lambda c, field: fills.filter(F.col("column") == c).agg(F.max(field).alias("v")).scalar()
    return df.withColumns(
        {c: F.coalesce(_number(c), one(c, "number")) for c in numeric}
        | {c: F.coalesce(F.col(c).cast("string"), one(c, "category")) for c in categorical}
    )


# --- drift ---------------------------------------------------------------------------------------------------------


def fit_bins(df: DataFrame, keys: Sequence[str], value: str, bins: int = 10) -> DataFrame:
    """``(keys, borders)``: inner borders of ``bins`` bins that hold equal shares of the table's rows.

    A border belongs to the bin below it. Equal borders count once, so few distinct values give fewer bins.
    """
    if bins < 2:
        raise ValueError("at least two bins")
    probs = {f"q{i}": i / bins for i in range(1, bins)}
    found = exact_quantiles(df, keys, value, probs)
    return found.select(*keys, F.array_sort(F.array_distinct(F.array(*probs))).alias("borders"))


def bin_counts(df: DataFrame, keys: Sequence[str], value: str, bins: DataFrame) -> DataFrame:
    """``(keys, bin, n)`` of another table under fitted bins; keys without bins are left out."""
    values = value_counts(df, keys, value)
    joined = join_on(values, bins, keys, "inner")
    place = F.size(F.filter("borders", lambda b: b < F.col("value")))
    return joined.groupBy(*keys, place.alias("bin")).agg(F.sum("n").alias("n"))


def stability(train: DataFrame, recent: DataFrame, keys: Sequence[str], value: str, bins: int = 10) -> DataFrame:
    """``(keys, psi, drifted)``: population stability index of the recent values against bins of the training values.

    A share of an empty bin counts as ``EMPTY_SHARE``. Keys without recent values have NULL for both.
    """
    keys = list(keys)
    fitted = fit_bins(train, keys, value, bins)
    every = fitted.select(*keys, F.explode(F.sequence(F.lit(0), F.size("borders"))).alias("bin"))
    joined = every
    for name, table in (("train", train), ("recent", recent)):
        joined = joined.join(bin_counts(table, keys, value, fitted).withColumnRenamed("n", name), [*keys, "bin"], "left")
    totals = joined.groupBy(*keys).agg(
        F.sum("train").alias("all_train"), F.sum("recent").alias("all_recent"),
        F.collect_list(F.struct(F.coalesce("train", F.lit(0)).alias("t"), F.coalesce("recent", F.lit(0)).alias("r"))).alias("l"),
    )
    share = lambda n, total: F.greatest(n / F.col(total), F.lit(EMPTY_SHARE))
    term = lambda x: (share(x["r"], "all_recent") - share(x["t"], "all_train")) * F.ln(share(x["r"], "all_recent") / share(x["t"], "all_train"))
    psi = F.when(F.col("all_recent") > 0, F.aggregate("l", F.lit(0.0), lambda acc, x: acc + term(x)))
    return totals.select(*keys, psi.alias("psi"), (psi > DRIFT_LIMIT).alias("drifted"))


def largest_gap(train: DataFrame, recent: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``(keys, ks)``: greatest distance between the two distribution functions (Kolmogorov-Smirnov); NULL if one is empty."""
    keys = list(keys)
    both = value_counts(train, keys, value, "train").withColumn("recent", F.lit(0).cast("bigint")).unionByName(
        value_counts(recent, keys, value, "recent").withColumn("train", F.lit(0).cast("bigint"))
    )
    one = both.groupBy(*keys, "value").agg(F.sum("train").alias("train"), F.sum("recent").alias("recent"))
    run = ordered_totals(one, keys, "value", ["train", "recent"])
    upto = lambda s: (F.col(f"before_{s}") + F.col(s)) / F.nullif(F.col(f"total_{s}"), F.lit(0))
    return run.groupBy(*keys).agg(F.max(F.abs(upto("train") - upto("recent"))).alias("ks"))


def drift(train: DataFrame, recent: DataFrame, keys: Sequence[str], value: str, bins: int = 10) -> DataFrame:
    """``(keys, psi, drifted, ks)`` for the keys of the training table."""
    return stability(train, recent, keys, value, bins).join(largest_gap(train, recent, keys, value), list(keys), "left")


def report_values(df: DataFrame, names: Mapping[str, int]) -> DataFrame:
    """Columns rounded to the given places."""
    return df.withColumns({c: F.round(c, places) for c, places in names.items()})
