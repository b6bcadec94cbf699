"""Every query with an oracle, held against DuckDB on the smallest tables; the others must run."""

import datetime
import decimal
import math

import duckdb
import pytest

from waymark import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP", "array<string>": "VARCHAR[]", "array<bigint>": "BIGINT[]", "array<int>": "INTEGER[]", "array<double>": "DOUBLE[]"}
SQL = registry.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    assert not isinstance(v, decimal.Decimal)
    return v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else v


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, SF)
    names = sorted(df.columns)
    got = [tuple(map(plain, r)) for r in df.select(*names).collect()]
    if name not in SQL:
        assert got
        return
    rel = con.sql(SQL[name])
    assert {c: KINDS[d] for c, d in df.dtypes} == dict(zip(rel.columns, map(str, rel.dtypes)))
    want = [tuple(map(plain, r)) for r in con.sql(f"select {', '.join(names)} from ({SQL[name]})").fetchall()]
    assert order(got) == order(want)
