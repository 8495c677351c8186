"""Every query with SQL gives what DuckDB gives on the smallest test tables; the others give rows."""

import math
import os
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in Path(ROOT).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def cell(x):
    if isinstance(x, float) and math.isnan(x):
        return "nan"
    if isinstance(x, (list, tuple)):
        return tuple(map(cell, x))
    return x


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, ROOT)
    rows = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        return
    rel = duck.execute(sql)
    names = [c[0] for c in rel.description]
    assert sorted(names) == sorted(df.columns)
    assert canon(df.columns, rows) == canon(names, rel.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
