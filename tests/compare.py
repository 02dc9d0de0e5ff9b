"""Holds a query's rows against its SQL."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "float": "FLOAT", "timestamp": "TIMESTAMP"}


def connection(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    return repr(round(v, 9)) if isinstance(v, float) else str(v)


def assert_same(df, sql, sf_dir):
    want = connection(sf_dir).sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    kinds = dict(zip(want.columns, map(str, want.types), strict=True))
    assert {n: TYPES.get(t, t) for n, t in df.dtypes} == kinds
    names = sorted(df.columns)
    got = sorted(tuple(cell(r[n]) for n in names) for r in df.collect())
    places = [want.columns.index(n) for n in names]
    assert got == sorted(tuple(cell(r[i]) for i in places) for r in want.fetchall())
