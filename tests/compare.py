"""Compare Spark results with DuckDB results: columns by name, rows in any order."""

from __future__ import annotations

import datetime
import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


_SQL_TYPES = {
    "int": "INTEGER",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
    "boolean": "BOOLEAN",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def _rows(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def differences(df, connection, sql: str) -> list[str]:
    """What differs, in words; empty if the results are the same."""
    described = connection.execute(f"DESCRIBE {sql}").fetchall()
    want_types = {row[0]: row[1] for row in described}
    have_types = {name: _SQL_TYPES.get(kind, kind) for name, kind in df.dtypes}
    if have_types != want_types:
        return [f"columns {have_types} against {want_types}"]
    result = connection.execute(sql)
    names = [column[0] for column in result.description]
    want = _rows(names, result.fetchall())
    have = _rows(df.columns, df.collect())
    found = []
    if have != want:
        extra, missing = have - want, want - have
        found.append(f"{have.total()} rows against {want.total()}")
        found += [f"only Spark: {row}" for row in list(extra)[:2]]
        found += [f"only SQL: {row}" for row in list(missing)[:2]]
    return found
