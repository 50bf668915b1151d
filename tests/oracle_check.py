"""Compare registered queries with their SQL twins: columns, types and values."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

from fleetcheck.domain import SOURCE_TABLES

_SPARK_TYPES = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE",
                "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in SOURCE_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if value is None:
        return (0, "")
    if isinstance(value, bool):
        return (1, str(value))
    if isinstance(value, decimal.Decimal):
        return (1, str(value))
    if isinstance(value, float):
        return (1, "nan" if math.isnan(value) else repr(round(value, 6)))
    if isinstance(value, (datetime.datetime, datetime.date)):
        return (1, value.isoformat())
    return (1, str(value))


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(con, frame, sql: str) -> str | None:
    """None when equal, else what differs."""
    cursor = con.execute(sql)
    duck_names = [d[0] for d in cursor.description]
    duck_types = {d[0]: str(d[1]).upper() for d in cursor.description}
    expected = _rows(duck_names, cursor.fetchall())
    if sorted(duck_names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} != {sorted(duck_names)}"
    for name, kind in frame.dtypes:
        want = kind.upper() if kind.startswith("decimal") else _SPARK_TYPES.get(kind, kind)
        if want != duck_types[name].replace(" ", ""):
            return f"type of {name}: {kind} != {duck_types[name]}"
    got = _rows(frame.columns, [tuple(r) for r in frame.collect()])
    if len(got) != len(expected):
        return f"{len(got)} rows != {len(expected)}"
    for mine, theirs in zip(got, expected):
        if mine != theirs:
            return f"{sorted(frame.columns)}\n  spark {mine}\n  sql   {theirs}"
    return None
