"""Every query against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from speechstats.plans import registry

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
TABLES = "conversations documents embeddings events pages orders".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return f"{float(v):.9g}"
    return str(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(_cell(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, D)
    rows = [tuple(r) for r in df.collect()]
    assert rows
    if name in registry.ORACLE:
        expect = con.execute(registry.ORACLE[name])
        columns = [c[0] for c in expect.description]
        assert sorted(columns) == sorted(df.columns)
        assert _rows(df.columns, rows) == _rows(columns, expect.fetchall())


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "speech_rate" in df.columns


def test_every_query_is_registered():
    assert set(registry.ORACLE) <= set(registry.QUERIES)
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
