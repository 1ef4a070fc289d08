import datetime as dt

import pytest

from phrasecast.operators import inventory as iv
from phrasecast.sources import tables

CSV = """event_id,event_type,event_date,speakers,pdf_file,source_url,provenance,desk
E1,press,2024-01-31,"Ines Vantorp, Bram Oake , ",a.pdf,https://x.example,Public domain,north
E2,call,01/31/2023,,b.pdf,,,south
E3,call,20230101,One,c.pdf,,,
"""


@pytest.fixture
def raw(spark, tmp_path):
    path = tmp_path / "inv.csv"
    path.write_text(CSV)
    return tables.read_inventory(spark, str(path))


def test_projection(raw):
    out = iv.project_inventory(raw)
    assert out.columns == iv.CORE_COLUMNS + ["desk"]
    rows = {r["event_id"]: r for r in out.collect()}
    assert rows["E1"]["speakers"] == ["Ines Vantorp", "Bram Oake"] and rows["E2"]["speakers"] == []
    assert rows["E2"]["event_date"] == dt.date(2023, 1, 31) and rows["E3"]["event_date"] == dt.date(2023, 1, 1)
    flat = {r["event_id"]: r for r in iv.inventory_rows(out).collect()}
    assert flat["E1"]["speakers"] == "Ines Vantorp, Bram Oake" and flat["E3"]["event_date"] == "2023-01-01"
    assert iv.project_inventory(raw.drop("event_type")).first()["event_type"] == "unknown"


def test_json_inventories(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"event_id": "E1", "event_date": "2024-01-31", "speakers": ["A ", " "]}, {"event_id": "E2", "event_date": "bad"}]')
    (tmp_path / "b.jsonl").write_text('{"event_id": "E1", "event_date": "2024-01-31"}\n{"event_id": "E2", "event_date": "x"}\n')
    array = tables.read_inventory(spark, str(tmp_path / "a.json"))
    assert iv.project_inventory(array).filter("event_id = 'E1'").first()["speakers"] == ["A"]
    lines = tables.read_inventory(spark, str(tmp_path / "b.jsonl"))
    assert [r["event_id"] for r in iv.bad_dates(lines).collect()] == ["E2"]
    with pytest.raises(ValueError):
        tables.read_inventory(spark, "x.xlsx")


def test_overrides(spark, raw):
    over = spark.createDataFrame([("E1", "New", None, "n1"), ("E9", "No", None, "n9")], "event_id string, speakers string, desk string, note string")
    rows = {r["event_id"]: r for r in iv.apply_overrides(raw, over).collect()}
    assert rows["E1"]["speakers"] == "New" and rows["E1"]["desk"] == "north" and rows["E1"]["note"] == "n1"
    assert rows["E2"]["note"] is None and set(rows) == {"E1", "E2", "E3"}


def test_checks(spark, raw):
    assert iv.require_unique_ids(raw) is raw
    with pytest.raises(ValueError, match="E1"):
        iv.require_unique_ids(raw.union(raw.filter("event_id = 'E1'")))
    docs = spark.createDataFrame([("E1",), ("E1",), ("E3",)], "event_id string")
    assert [r["event_id"] for r in iv.events_without_document(raw, docs).collect()] == ["E2"]


def test_summary_and_filter(raw):
    got = iv.inventory_summary(raw).first()
    assert tuple(got) == (3, dt.date(2023, 1, 1), dt.date(2024, 1, 31), 2)
    assert [r[0] for r in iv.event_types(raw).collect()] == ["call", "press"]
    assert iv.filter_events(raw, ["call"], "2023-01-15").count() == 1
    assert iv.filter_events(raw, None, None, "2023-01-01").count() == 1
    renamed = raw.withColumnRenamed("event_date", "Timestamp")
    assert iv.date_column(renamed.columns) == "Timestamp"
    assert [r["count"] for r in iv.events_over_time(renamed).collect()] == [1, 1, 1]
    assert iv.inventory_summary(raw.drop("event_date")).first()["date_min"] is None


def test_tables(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("a\tb\n1\tx,y\n")
    assert tables.read_table(spark, str(tmp_path / "t.tsv")).first()["b"] == "x,y"
    spark.range(3).write.parquet(str(tmp_path / "t.parquet"))
    assert tables.read_table(spark, str(tmp_path / "t.parquet")).count() == 3
    with pytest.raises(ValueError):
        tables.read_table(spark, "t.feather")
