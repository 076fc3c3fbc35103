"""Spark rows against DuckDB rows of the same query."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{Path(sf) / t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    return repr(v + 0.0) if isinstance(v, float) else repr(v)


def compare(df, con, sql: str) -> None:
    rows = df.collect()
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    theirs = found.fetchall()
    order = sorted(names)
    a = sorted(tuple(plain(r[c]) for c in order) for r in rows)
    b = sorted(tuple(plain(r[names.index(c)]) for c in order) for r in theirs)
    assert len(a) == len(b)
    assert a == b
