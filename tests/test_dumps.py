"""The dump data source: splits, folder columns, pushed filters."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from phrasecast.sources import articles as sources, dumps
from phrasecast.sources.dumps import DumpReader, article_of, lines_of


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("dump")
    for day, ids in (("2024-01-01", range(5)), ("2024-01-02", range(5, 9)), ("2024-01-03", range(9, 12)), ("__HIVE_DEFAULT_PARTITION__", range(12, 14))):
        part = root / f"day={day}" / "ingest_source=wire%20a"
        part.mkdir(parents=True)
        lines = []
        for i in ids:
            lines.append(json.dumps({
                "article_id": f"A{i}", "event_id": "E1", "source": "S", "published_at": f"{day}T0{i % 10}:00:00Z" if day[0] == "2" else "soon", "headline": f"é {i}",
                "url": f"u{i}", "body_text": "x" * (i * 7), "tags": ["a", 2] if i % 2 else "solo", "score": 1.50, "deep": {"k": [1]}, "none": None,
            }, ensure_ascii=False))
        (part / "a.jsonl").write_text("\n".join([*lines[:2], "", "no json", "[1]", *lines[2:]]))
        (part / "_SUCCESS").write_text("")
    return str(root)


def test_lines_belong_to_one_split(tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_bytes(b"one\ntwo\n\n  \nthree" + b"x" * 3_000_000 + b"\nlast")
    whole = list(lines_of(str(path), 0, path.stat().st_size))
    assert [len(line) for _, line in whole] == [4, 4, 3_000_006, 4]
    for cuts in ([3, 4, 5, 8, 9], [1_000_000, 2_999_999], list(range(1, 20)), [path.stat().st_size - 2]):
        edges = [0, *cuts, path.stat().st_size]
        assert [x for a, b in zip(edges, edges[1:]) for x in lines_of(str(path), a, b)] == whole


def test_article_columns():
    got = article_of(b'{"article_id": "a", "tags": "t", "n": 1.25, "d": {"k": true}, "z": null}')
    assert got[0] == "a" and got[1] is None and got[7] == ["t"] and got[9] == [("n", "1.25"), ("d", '{"k":true}'), ("z", None)]
    assert article_of(b"[1]") is None and article_of(b"nope") is None and article_of(b'"x"') is None


def load(spark, folder, **options):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(dumps.ArticleDump)
    reader = spark.read.format("article_dump").option("columns", "day date, ingest_source string")
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(folder)


@pytest.mark.parametrize("splitbytes", [100, 10_000_000])
def test_same_articles_as_the_line_reader(spark, folder, splitbytes):
    got = load(spark, folder, splitbytes=splitbytes)
    assert sorted(r["article_id"] for r in got.collect()) == sorted(f"A{i}" for i in range(14))
    want = sources.read_articles(spark, folder)
    columns = ["article_id", "event_id", "published_at", "headline", "body_text", "tags"]
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))
    extras = [F.col("extras")[k] for k in ("score", "deep", "none")]
    assert sorted(map(str, got.select(*extras).collect())) == sorted(map(str, want.select(*extras).collect()))
    assert {r[0] for r in got.select("ingest_source").collect()} == {"wire a"}
    if splitbytes == 100:
        assert got.rdd.getNumPartitions() > 14


def test_filters_reach_the_source(spark, folder):
    every = load(spark, folder, splitbytes=1)
    some = every.filter("day >= DATE '2024-01-02' AND day < DATE '2024-01-03' AND headline LIKE '%6'")
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = some._jdf.queryExecution().explainString(mode)
    scan = plan[plan.index("BatchScan", plan.index("(1)", 20)) :]
    assert "PushedFilters" in scan and "2024-01-02" in scan
    condition = next(line for line in plan.splitlines() if "Condition" in line)
    assert "headline" in condition and "day" not in condition
    assert [r["article_id"] for r in some.collect()] == ["A6"]
    assert load(spark, folder).filter("day IN (DATE '2024-01-01', DATE '2024-01-03')").count() == 8
    assert load(spark, folder).filter("day IS NULL").count() == 2 and load(spark, folder).filter("ingest_source = 'other'").count() == 0


def test_partitions_read(folder):
    from pyspark.sql import types as T
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, StringContains

    columns = [("day", "date")]

    def parts(*filters):
        reader = DumpReader({"path": folder, "splitbytes": "1000000000"}, T.StructType(), columns)
        left = list(reader.pushFilters(list(filters)))
        return left, [p[0].split("day=")[1][:10] for split in reader.partitions() for p in split.parts]

    assert len(parts()[1]) == 4
    late = GreaterThanOrEqual(("day",), datetime.date(2024, 1, 2))
    text = StringContains(("headline",), "x")
    assert parts(late, text) == ([text], ["2024-01-02", "2024-01-03"])
    assert parts(EqualTo(("day",), datetime.date(2030, 1, 1))) == ([], [])


def test_loader_with_window_and_limit(spark, folder):
    ids = lambda df: sorted(r["article_id"] for r in df.collect())
    columns = "day date, ingest_source string"
    assert ids(dumps.load_dump(spark, folder, "2024-01-02T06:00:00Z", "2024-01-03T00:00:00Z", columns=columns)) == ["A10", "A12", "A13", "A6", "A7", "A8"]
    assert ids(dumps.load_dump(spark, folder, limit=3, columns=columns)) == ["A0", "A1", "A2"]
    assert ids(dumps.load_dump(spark, folder, since="2024-01-03", limit=2, columns=columns)) == ["A10", "A9"]
    assert ids(dumps.load_dump(spark, folder + "-missing")) == []
    sources.register_source("dump", dumps.load_dump)
    out = sources.ingest(spark, [sources.Source("wire", "dump", {"path": folder, "columns": columns})], "2024-02-01", since="2024-01-03")
    assert out.count() == 5


def test_rows_without_a_day_open_only_their_folder(folder):
    from pyspark.sql import types as T
    from pyspark.sql.datasource import IsNull

    reader = DumpReader({"path": folder}, T.StructType(), [("day", "date")])
    assert list(reader.pushFilters([IsNull(("day",))])) == []
    assert ["__HIVE_DEFAULT_PARTITION__" in p[0] for split in reader.partitions() for p in split.parts] == [True]


def test_dated_folders_are_not_cut_by_every_task(spark, tmp_path):
    days = [None if i % 3 == 0 else datetime.date(2024, 1, 1) + datetime.timedelta(i % 40) for i in range(2000)]
    rows = [(day, f"s{i % 2}", f"line {i}") for i, day in enumerate(days)]
    lines = spark.createDataFrame(rows, "day date, ingest_source string, value string").repartition(16)
    path = sources.write_dated(lines, str(tmp_path / "out"))
    files = [name for name, _ in dumps.list_files(path)]
    folders = {name.rsplit("/", 1)[0] for name in files}
    assert len(folders) == len({row[:2] for row in rows}) and len(files) <= len(folders) + 4
    back = spark.read.schema("value string, day date, ingest_source string").text(path)
    assert sorted(map(str, back.select("day", "ingest_source", "value").collect())) == sorted(map(str, spark.createDataFrame(rows, lines.schema).collect()))
