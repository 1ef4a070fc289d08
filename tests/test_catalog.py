"""Every registered query against its SQL twin on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import check
from catalog import registry

SF = "/root/testdata/sf0.001"
CHECKED = sorted(name for name, (_, sql) in registry.ALL.items() if sql is not None)

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the provided tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in check.TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_query(spark, duck, name):
    run, sql = registry.ALL[name]
    df = run(spark, SF)
    got = check.table_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = duck.execute(sql)
    assert got == check.table_of([d[0] for d in cursor.description], cursor.fetchall())


def test_names():
    assert all(callable(run) for run, _ in registry.ALL.values())
    assert len(registry.ALL) > 80
