import random

import pytest
from pyspark.sql import functions as F

from phrasecast.functions.scan import global_index, hash_block, hash_order, prefix_sums, skew_join


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else f"k{rng.randint(0, 5)}", i, rng.randint(0, 9)) for i in range(900)]
    return spark.createDataFrame(rows, "key string, at int, v int").repartition(7), rows


def expected(rows):
    out, running, totals = {}, {}, {}
    for key, at, v in sorted(rows, key=lambda r: (r[0], r[1])):
        out[at] = running.get(key, 0)
        running[key] = running.get(key, 0) + v
    return out, running


@pytest.mark.parametrize("levels", [{"b": lambda: F.floor(F.col("at") / 50)}, {"a": lambda: F.floor(F.col("at") / 300), "b": lambda: F.floor(F.col("at") / 7)}])
def test_prefix_sums(skewed, levels):
    df, rows = skewed
    got = prefix_sums(df, ["key"], {k: f() for k, f in levels.items()}, ["at"], {"before": F.col("v")}, totals=True).collect()
    want, totals = expected(rows)
    assert {r["at"]: r["before"] for r in got} == want
    assert all(r["before_total"] == totals[r["key"]] for r in got)
    assert len(got) == len(rows)


def test_prefix_sums_without_key(skewed):
    df, rows = skewed
    placed = prefix_sums(
        df.withColumn("h", hash_order("at")), [], {"b": hash_block("at", 2)}, ["h"], {"place": F.lit(1).cast("bigint")}
    )
    assert sorted(r["place"] for r in placed.collect()) == list(range(len(rows)))


def test_global_index(skewed):
    df, rows = skewed
    got = global_index(df, ["key", "at"], "i").collect()
    assert [(r["key"], r["at"]) for r in sorted(got, key=lambda r: r["i"])] == sorted((k, a) for k, a, _ in rows)
    assert sorted(r["i"] for r in got) == list(range(len(rows)))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_skew_join_equals_join(spark, skewed, how):
    df, _ = skewed
    dim = spark.createDataFrame([("hot", 1), ("k1", 2), ("none", 3)], "key string, d int")
    got = skew_join(df, dim, "key", how, spread=["at"], hot_share=10, salts=8).select("key", "at", "v", "d")
    want = df.join(dim, "key", how).select("key", "at", "v", "d")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_skew_join_spreads_the_hot_key(spark, skewed):
    df, _ = skewed
    dim = spark.createDataFrame([("hot", 1)], "key string, d int")
    plan = skew_join(df, dim, "key", spread=["at"], hot_share=10)._jdf.queryExecution().optimizedPlan().toString()
    assert "__salt" in plan
    with pytest.raises(ValueError):
        skew_join(df, dim, "key", "outer")


def test_skew_join_spreads_rows_without_a_key(spark):
    df = spark.createDataFrame([(None if i % 2 else "k", i) for i in range(400)], "key string, at int")
    dim = spark.createDataFrame([("k", 1), (None, 2)], "key string, d int")
    out = skew_join(df, dim, "key", "left", spread=["at"], salts=8)
    assert out.filter("key IS NULL AND d IS NULL").count() == 200 and out.filter("d = 1").count() == 200
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = skew_join(df, dim, "key", "left", spread=["at"], salts=8)
        sizes = joined.filter("key IS NULL").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(sizes) > 1
