import os

import pytest

import __spark_entry__
from docquill import queries

SF = "/root/testdata/sf0.001"


def normal(rows, columns):
    return sorted(str([f"{x:.9g}" if isinstance(x, float) and x == x else "" if x is None or x != x else str(x) for x in (r[columns.index(c)] for c in sorted(columns))]) for r in rows)


@pytest.fixture(scope="module")
def db():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_its_sql(spark, db, name):
    df = queries.QUERIES[name](spark, SF)
    expected = db.sql(queries.SQL[name])
    assert sorted(df.columns) == sorted(expected.columns)
    got = normal([tuple(r) for r in df.collect()], df.columns)
    assert got == normal(expected.fetchall(), list(expected.columns)) and got


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
