"""Every query that has SQL gives the same rows in DuckDB."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from factloom.queries import ORACLE_SQL, QUERIES


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return f"{v:f}" if type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def oracle(data):
    con = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, data, oracle, name):
    got = QUERIES[name](spark, data)
    said = oracle.sql(ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(said.columns)
    at = [said.columns.index(c) for c in columns]
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in said.fetchall()), key=repr)
    assert ours == theirs


def test_entry(spark, monkeypatch, data):
    out = entry.entry(spark)
    assert out.columns == ["bucket", "packets", "contracts", "status", "level", "score"]
    assert out.count() > 0


def test_registries_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(ORACLE_SQL) <= set(QUERIES)
