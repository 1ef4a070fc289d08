import json

import pytest
from pyspark.sql import functions as F

from phrasecast.operators import news
from phrasecast.plans import newsflow
from phrasecast.sources import articles as dumps

BASE = {
    "article_id": "hbr-1", "event_id": "2024-03", "source": "hbr", "headline": "Harbour board to discuss dredging",
    "body_text": "Pilots question dredging costs and dredging dates.", "published_at": "2024-03-15T12:00:00Z",
    "url": "https://x.example/1", "tags": ["a", "b"], "desk": "north",
}


def dump(folder, name, *records):
    folder.mkdir(parents=True, exist_ok=True)
    lines = [r if isinstance(r, str) else json.dumps(r) for r in records]
    (folder / f"{name}.jsonl").write_text("\n".join(lines) + "\n")


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "raw"
    dump(
        root / "one", "a",
        BASE, "", "not json", "[1]",
        {**BASE, "article_id": "hbr-1", "event_id": "other"},
        {**BASE, "article_id": ""},
        {**BASE, "article_id": "n-1", "event_id": ""},
    )
    dump(
        root / "two", "b",
        {**BASE, "article_id": "n-1", "event_id": "2024-03"},
        {**BASE, "article_id": "w-2", "source": "", "published_at": "soon", "body_text": "x"},
        {**BASE, "article_id": "w-3", "event_id": "2024-04", "published_at": 1710504000},
    )
    return root


def test_features(spark, folder):
    out = newsflow.build_features(spark, str(folder), ["dredging", "tide table"])
    rows = {r["event_id"]: r for r in out.features.collect()}
    first = rows["2024-03"]
    assert (first["news_article_count"], first["news_unique_sources"]) == (2, 2)
    assert first["news_target__dredging_count"] == 4 and first["news_target__tide_table_count"] == 0
    assert first["news_average_body_length"] == (len(BASE["body_text"]) + 1) / 2
    assert first["news_first_published_at"] == first["news_latest_published_at"] is not None
    assert set(rows) == {"2024-03", "2024-04"} and len(first["news_snapshot_hash"]) == 64
    listed = {r["event_id"]: r["news_provenance"] for r in out.provenance.collect()}
    assert [a["article_id"] for a in json.loads(listed["2024-03"])] == ["hbr-1", "w-2"]


def test_bad_lines_and_missing_path(spark, folder):
    assert sorted(r["line"] for r in dumps.bad_lines(spark, str(folder)).collect()) == ["[1]", "not json"]
    empty = newsflow.build_features(spark, str(folder / "nowhere"), ["dredging"])
    assert empty.features.count() == 0 and "news_target__dredging_count" in empty.features.columns


def test_empty_features_keep_their_schema(spark, folder, tmp_path):
    newsflow.build_features(spark, str(folder / "nowhere"), ["dredging"], str(tmp_path / "out"))
    assert "news_snapshot_hash" in spark.read.parquet(str(tmp_path / "out" / "features")).columns


def test_digest_ignores_order(spark, folder):
    lines = dumps.read_lines(spark, str(folder))
    one = news.corpus_digest(lines).first()[0]
    assert one == news.corpus_digest(lines.repartition(5).orderBy(F.rand())).first()[0]
    assert one != news.corpus_digest(lines.union(lines.limit(1))).first()[0]


def test_first_copies_do_not_depend_on_partitions(spark):
    rows = [(f"A{i % 40}", f"E{i % 7}", "s", "2024-01-01", "h", "u", f"b{i}", f"f{i % 3}", i // 10, i) for i in range(400)]
    schema = "article_id string, event_id string, source string, published_at string, headline string, url string, body_text string, file string, split_start bigint, line_no bigint"
    df = spark.createDataFrame(rows, schema)
    pick = lambda d: sorted((r["article_id"], r["file"], r["line_no"]) for r in news.first_copies(news.measure_articles(d, ["b"])).collect())
    assert pick(df) == pick(df.repartition(9))
    want = {}
    for r in sorted(rows, key=lambda r: r[7:]):
        want.setdefault(r[0], (r[0], r[7], r[9]))
    assert pick(df) == sorted(want.values())
    limited = news.first_per_source(df.withColumn("ingest_source", F.col("file")), 4).collect()
    order = sorted((r for r in rows), key=lambda r: r[7:])
    assert sorted(r["line_no"] for r in limited) == sorted(
        n for f in ("f0", "f1", "f2") for n in [r[9] for r in order if r[7] == f][:4]
    )


def test_ingest_round_trip(spark, folder, tmp_path):
    sources = [
        dumps.Source("one", params={"path": str(folder / "one")}),
        dumps.Source("two", params={"path": str(folder / "two")}),
        dumps.Source("off", "no such loader", enabled=False),
    ]
    arts = dumps.ingest(spark, sources, "2024-06-01T00:00:00+00:00")
    totals = {r[0]: r[1] for r in news.totals_per_source(arts).collect()}
    assert totals == {"one": 2, "two": 2}
    path = dumps.write_articles(arts, str(tmp_path / "out"), "run1")
    back = dumps.read_articles(spark, path).filter("article_id = 'w-3'").first()
    assert back["tags"] == ["a", "b"]
    assert back["extras"] == {"desk": "north", "ingest_source": "two", "ingested_at": "2024-06-01T00:00:00+00:00"}
    manifest = dumps.ingest_manifest(arts, "run1", "now", [path], dry_run=True).first()
    assert manifest["totals"] == {"one": 2, "two": 2} and manifest["dry_run"] is True
    rejected = news.rejected_articles(dumps.read_articles(spark, str(folder / "two"))).collect()
    assert [r["missing"] for r in rejected] == [["source"]]


def test_window_limit_and_loaders(spark, folder):
    kept = dumps.load_jsonl(spark, str(folder / "two"), since="2024-03-16T00:00:00Z")
    assert [r["article_id"] for r in kept.collect()] == ["w-2"]  # a time that cannot be read passes
    assert [r["article_id"] for r in dumps.load_jsonl(spark, str(folder / "two"), limit=1).collect()] == ["n-1"]
    with pytest.raises(TypeError):
        dumps.register_source("bad", "text")
    dumps.register_source("list", lambda s: [1])
    with pytest.raises(TypeError):
        dumps.ingest(spark, [dumps.Source("x", "list")], "now")


def test_merge_news(spark):
    base = spark.createDataFrame(
        [("evt-1", "evt-1-0001", 1), ("evt-2", "evt-2-0001", 0)], "event_id string, segment_id string, target__vantorp int"
    )
    table = spark.createDataFrame(
        [("evt-1", 3, 9, "abc123", '[{"article_id":"a1"}]')],
        "event_id string, news_article_count bigint, target__vantorp int, news_snapshot_hash string, news_provenance string",
    )
    merged = news.merge_news(base, table)
    rows = {r["event_id"]: r for r in merged.collect()}
    assert merged.columns == ["event_id", "segment_id", "target__vantorp", "news_article_count", "target__vantorp_news"]
    assert rows["evt-1"]["news_article_count"] == 3 and rows["evt-2"]["news_article_count"] is None
    assert news.snapshot_hash(table).first()[0] == "abc123"
    assert news.parse_provenance(table).first()["articles"][0]["article_id"] == "a1"
    with pytest.raises(ValueError):
        news.merge_news(base, table.drop("event_id"))


def test_provenance_parts(spark):
    rows = [("E", i, f"a{i}", "s", "h", "u", "t") for i in range(25)]
    df = spark.createDataFrame(rows, "event_id string, place bigint, article_id string, source string, headline string, url string, published_at string")
    parts = {r["part"]: json.loads(r["news_provenance"]) for r in news.provenance_json(df.repartition(4), 10).collect()}
    assert [len(parts[i]) for i in range(3)] == [10, 10, 5] and parts[1][0]["article_id"] == "a10"
