"""Compares a registered query with its SQL in DuckDB, by name of column, regardless of order."""

from __future__ import annotations

import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v


def same(spark, name: str, query, sql: str, d: str) -> None:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    out = con.execute(sql)
    names = [c[0] for c in out.description]
    df = query(spark, d)
    assert sorted(df.columns) == sorted(names), name
    want = sorted((tuple(map(plain, r)) for r in out.fetchall()), key=repr)
    got = sorted((tuple(map(plain, r)) for r in df.select(*names).collect()), key=repr)
    assert got == want, name
