"""Runs a catalog query in Spark and its SQL in DuckDB and compares the rows."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, float, decimal.Decimal)):
        if isinstance(value, float) and math.isnan(value):
            return "nan"
        return float(value)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(plain(row[i]) for i in order) for row in rows),
        key=lambda r: tuple((v is not None, str(type(v)), v if v is not None else "") for v in r),
    )


def compare(frame, connection, sql: str) -> str | None:
    """None when both sides agree, else a short account of the difference."""
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} and {sorted(names)}"
    ours = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    theirs = rows_of(names, result.fetchall())
    if len(ours) != len(theirs):
        return f"{len(ours)} rows and {len(theirs)} rows"
    for a, b in zip(ours, theirs):
        if a != b:
            different = sum(x != y for x, y in zip(ours, theirs))
            return f"{different} of {len(ours)} rows differ, first {a} and {b}"
    return None
