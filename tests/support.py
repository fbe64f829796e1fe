"""Comparing a query with its SQL."""

import math

import duckdb

from reelframe.plans.views import TABLES

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return bytes(v) if isinstance(v, bytearray) else v


def rows_of(df, columns):
    return sorted((tuple(plain(x) for x in r) for r in df.select(*columns).collect()), key=repr)


def assert_same(df, sql, folder):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    found = con.sql(sql)
    columns = sorted(found.columns)
    assert sorted(df.columns) == columns
    kinds = dict(zip(found.columns, map(str, found.types), strict=True))
    assert {k: TYPES.get(v, v) for k, v in df.dtypes} == kinds
    want = sorted((tuple(plain(x) for x in r) for r in found.project(", ".join(f'"{c}"' for c in columns)).fetchall()), key=repr)
    assert rows_of(df, columns) == want
