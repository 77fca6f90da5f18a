"""Row-by-row comparison of a query's result with its SQL counterpart."""

from __future__ import annotations

import datetime
import math
import os

import duckdb
from pyspark.sql import DataFrame

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = os.path.join(folder, f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return datetime.datetime(value.year, value.month, value.day).isoformat()
    if value is None:
        return None
    if isinstance(value, (int, str)):
        return value
    value = float(value)
    return "nan" if math.isnan(value) else value + 0.0


def _sorted(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(plain, key=lambda r: [(v is None, str(type(v)) if isinstance(v, str) else "", v if v is not None else 0) for v in r])


def difference(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when equal, else what differs first."""
    cursor = con.execute(sql)
    want_cols, want = _sorted([c[0] for c in cursor.description], cursor.fetchall())
    got_cols, got = _sorted(df.columns, [tuple(r) for r in df.collect()])
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}; first {got[:2]} and {want[:2]}"
    for a, b in zip(got, want, strict=True):
        if a != b:
            return f"{got_cols}: {a} != {b}; {sum(x != y for x, y in zip(got, want))} of {len(got)} rows differ"
    return None
