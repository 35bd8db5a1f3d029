"""Every registered query against its SQL in DuckDB; those without SQL must give a stable schema."""

import decimal
import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()
NAMES = sorted(n for n in QUERIES if not n.startswith("op") or n in SQL)


def plain(v):
    if v is None or isinstance(v, bool | str):
        return v
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def test_sql_is_for_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", [n for n in NAMES if n != "pipeline"])
def test_query(spark, duck, data, name):
    df = QUERIES[name](spark, data)
    cols = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*cols).collect()), key=str)
    if name not in SQL:
        assert df.dtypes
        return
    rel = duck.execute(SQL[name])
    names = [x[0] for x in rel.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=str)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "doc_id", "score", "rank", "matched_terms"] and df.count() > 0
