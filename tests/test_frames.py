"""Frames and ranks against plain Python, with one key that holds most rows and blocks smaller than the frames."""

import random
import statistics
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from phrasecast.functions import frames
from phrasecast.functions.frames import (
    decayed_sums, exact_quantiles, last_rows, ordered_totals, sketched_quantiles, trailing_moments, value_counts,
)


@pytest.fixture(scope="module")
def timed(spark):
    pick = random.Random(2)
    rows = [("hot" if i % 4 else f"k{pick.randrange(3)}", pick.randrange(0, 40_000), pick.choice([1.0, 2.5, None])) for i in range(400)]
    rows += [("hot", 5_000_000, 1.0), ("hot", 5_000_000, 2.0), (None, 3, 1.0), ("k0", None, 1.0)]
    return spark.createDataFrame(rows, "key string, at bigint, v double").repartition(5), rows


@pytest.mark.parametrize(("half_life", "block"), [(1000, None), (1000, 7), (50, 1000), (7, 3)])
def test_decayed_sums(timed, half_life, block):
    df, rows = timed
    got = decayed_sums(df, ["key"], "at", {"n": F.lit(1), "s": F.col("v")}, half_life, block).collect()
    kept = [r for r in rows if r[0] is not None and r[1] is not None]
    want = {}
    for key, at in {(r[0], r[1]) for r in kept}:
        w = [(2 ** (-(at - t) / half_life), v) for k, t, v in kept if k == key and t <= at]
        want[key, at] = sum(x for x, _ in w), sum(x * v for x, v in w if v is not None)
    assert len(got) == len(want)
    for r in got:
        assert (r["n"], r["s"]) == pytest.approx(want[r["key"], r["at"]], rel=1e-9, abs=1e-12)


def test_decayed_sums_combine_over_blocks(timed):
    """One event cut into many blocks has the same states as one in a single block."""
    df, _ = timed
    a, b = (
        {(r["key"], r["at"]): r["n"] for r in decayed_sums(df, ["key"], "at", {"n": F.lit(1)}, 3000, block).collect()} for block in (11, 48_000)
    )
    assert a == pytest.approx(b, rel=1e-9)


def test_decayed_sums_of_nothing(spark):
    assert decayed_sums(spark.createDataFrame([], "at bigint"), [], "at", {"n": F.lit(1)}, 10).collect() == []


@pytest.mark.parametrize("days", [1, 5, 90])
def test_trailing_moments(spark, days):
    pick = random.Random(3)
    start = date(2020, 1, 1)
    rows = [("hot" if i % 3 else "k", start + timedelta(pick.randrange(200)), pick.choice([1e9 + pick.random(), None, float("nan")])) for i in range(500)]
    rows += [("flat", start, 5.0), ("flat", start, 5.0), (None, start, 1.0), ("k", None, 1.0)]
    df = spark.createDataFrame(rows, "key string, day date, v double")
    got = trailing_moments(df, ["key"], "day", "v", days).collect()
    assert len(got) == len({r[:2] for r in rows if None not in r[:2]})
    for r in got:
        x = [v for k, d, v in rows if k == r["key"] and d and v is not None and v == v and r["day"] - timedelta(days) < d <= r["day"]]
        assert r["n"] == len(x)
        assert r["mean"] == (pytest.approx(statistics.fmean(x)) if x else None)
        # Values near 1e9 with a spread below 1: sums of squares would lose it.
        assert r["std"] == (pytest.approx(statistics.stdev(x), rel=1e-6, abs=1e-6) if len(x) > 1 else None)


@pytest.mark.parametrize(("k", "block"), [(3, 2), (10, 3), (4, 100), (2, 2)])
def test_last_rows(spark, k, block):
    pick = random.Random(4)
    rows = [("hot" if i % 5 else "k", i, pick.randrange(9)) for i in range(120)]
    df = spark.createDataFrame(rows, "key string, at int, v int").repartition(4)
    columns = {
        "n": lambda frame: F.count(F.lit(1)).over(frame(-k, -1)),
        "top": lambda frame: F.max("v").over(frame(-k, -1)),
        "all": lambda frame: F.collect_list("v").over(frame(-k, 0)),
    }
    got = last_rows(df, ["key"], {"b": F.floor(F.col("at") / 50)}, ["at"], k, columns, block).collect()
    assert len(got) == len(rows)
    for r in got:
        before = [v for key, at, v in rows if key == r["key"] and at < r["at"]][-k:]
        assert (r["n"], r["top"], r["all"]) == (len(before), max(before, default=None), [*before, r["v"]])
    with pytest.raises(ValueError):
        last_rows(df, ["key"], {"b": F.lit(0)}, ["at"], 2, {"x": lambda frame: F.count(F.lit(1)).over(frame(-3, -1))})


@pytest.fixture(scope="module")
def valued(spark):
    pick = random.Random(6)
    rows = [("hot" if i % 3 else f"k{i % 4}", float(pick.choice([0, 0, 0, 1, pick.randrange(50), pick.random()]))) for i in range(700)]
    rows += [("one", 4.0), ("same", 2.0), ("same", 2.0), ("none", None), ("none", float("nan")), (None, 1.0)]
    return spark.createDataFrame(rows, "key string, v double").repartition(5), rows


def by_key(rows):
    out = {}
    for key, v in rows:
        if key is not None and v is not None and v == v:
            out.setdefault(key, []).append(v)
    return out


def test_exact_quantiles_with_ties_and_single_values(valued):
    df, rows = valued
    probs = {"a": 0.0, "b": 0.01, "c": 0.5, "d": 0.77, "e": 1.0}
    got = {r["key"]: tuple(r)[1:] for r in exact_quantiles(df, ["key"], "v", probs).collect()}
    assert got == {k: pytest.approx(tuple(np.quantile(x, list(probs.values())))) for k, x in by_key(rows).items()}
    (whole,) = exact_quantiles(df.filter("key IS NOT NULL"), [], "v", probs).collect()
    assert tuple(whole) == pytest.approx(tuple(np.quantile([v for x in by_key(rows).values() for v in x], list(probs.values()))))
    assert exact_quantiles(df.filter("false"), ["key"], "v", probs).collect() == []
    assert exact_quantiles(df.filter("false"), [], "v", probs).collect() == []


def test_sketched_quantiles_keep_their_error(valued):
    df, rows = valued
    error = 0.02
    for r in sketched_quantiles(df, ["key"], "v", {"low": 0.1, "high": 0.9}, error).collect():
        x = by_key(rows)[r["key"]]
        for name, q in (("low", 0.1), ("high", 0.9)):
            assert sum(v < r[name] for v in x) <= (q + error) * len(x) + 1 and sum(v <= r[name] for v in x) >= (q - error) * len(x) - 1
    with pytest.raises(ValueError):
        sketched_quantiles(df, ["key"], "v", {"a": 0.5}, 0.0)


def test_ordered_totals(valued):
    df, rows = valued
    got = ordered_totals(value_counts(df, ["key"], "v"), ["key"], "value", ["n"]).collect()
    for r in got:
        x = by_key(rows)[r["key"]]
        assert (r["n"], r["before_n"], r["total_n"]) == (x.count(r["value"]), sum(v < r["value"] for v in x), len(x))
    assert len(got) == sum(len(set(x)) for x in by_key(rows).values())


def test_no_window_holds_a_key(valued):
    plan = frames.decayed_sums(valued[0].withColumn("t", F.col("v").cast("bigint")), ["key"], "t", {"n": F.lit(1)}, 10)
    shown = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "__b" in shown and "Cross" not in shown
