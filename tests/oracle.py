"""Comparing a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import math
from datetime import date, datetime

import duckdb
import pyarrow.dataset as ds

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.register(t, ds.dataset(f"{folder}/{t}.parquet").to_table())
    return con


def shown(x) -> str:
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    if isinstance(x, float):
        return f"{x:.9g}"
    return str(datetime.combine(x, datetime.min.time()) if isinstance(x, date) and not isinstance(x, datetime) else x)


def rows_of(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(shown(r[i]) for i in order) for r in rows)


def same(frame, con: duckdb.DuckDBPyConnection, sql: str) -> int:
    """Asserts equal columns and rows; gives their number."""
    found = con.sql(sql)
    assert sorted(frame.columns) == sorted(found.columns)
    ours, theirs = rows_of(frame.columns, frame.collect()), rows_of(found.columns, found.fetchall())
    assert ours == theirs
    return len(ours)
