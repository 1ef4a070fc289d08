"""Cases outside the provided tables: long ids, blank lines, NULL sources, clashing extras, constant columns."""

from pyspark.sql import functions as F

from catalog import views
from phrasecast.operators import features, news
from phrasecast.sources import articles


def test_long_ids_stay_apart(spark):
    rows = spark.createDataFrame([(5,), (600000,), (6000000,), (6000001,)], "i long")
    got = [r[0] for r in rows.orderBy("i").select(views.padded(F.col("i"), 6)).collect()]
    assert got == ["000005", "600000", "6000000", "6000001"]


def test_blank_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\t\n \n  \n{"a": 2}\n')
    lines = articles.read_lines(spark, str(tmp_path), "*.jsonl") if hasattr(articles, "read_lines") else None
    if lines is not None:
        assert lines.count() == 2
    texts = spark.createDataFrame([("x",), ("\t",), (" ",), ("",)], "line string")
    one = spark.createDataFrame([("x",)], "line string")
    assert news.corpus_digest(texts).collect() == news.corpus_digest(one).collect()


def test_limit_keeps_null_sources(spark):
    kinds = {"file": "string", "split_start": "long", "line_no": "long"}
    schema = ", ".join(["ingest_source string", *(f"{c} {kinds.get(c, 'long')}" for c in news.POSITION)])
    row = lambda s, n: (s, *("f" if kinds.get(c) == "string" else n for c in news.POSITION))
    rows = spark.createDataFrame([row(None, 1), row(None, 2), row("a", 1), row("a", 2), row("a", 3)], schema)
    got = news.first_per_source(rows, 1)
    assert sorted((r[0] or "") for r in got.collect()) == ["", "a"]
    assert "WindowGroupLimit" in got._jdf.queryExecution().toString()


def test_totals_of_empty_sources(spark):
    rows = spark.createDataFrame([("one",)], "ingest_source string")
    every = spark.createDataFrame([("one",), ("two",)], "ingest_source string")
    assert {tuple(r) for r in news.totals_per_source(rows, every).collect()} == {("one", 1), ("two", 0)}


def test_constant_columns_scale_by_one(spark):
    rows = [(i, "a", 1.7e9 + 0.1) for i in range(50)] + [(i, "b", 1234567.891) for i in range(50)] + [(1, "c", 2.0)]
    df = spark.createDataFrame(rows, "row_id long, feature string, value double")
    got = {r.feature: r.scale for r in features.fit_scales(df, F.lit(50)).collect()}
    assert got["a"] == got["b"] == 1.0
    assert abs(got["c"] - (4 / 50 - (2 / 50) ** 2) ** 0.5) < 1e-12
