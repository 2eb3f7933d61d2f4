"""Runs registered queries and their SQL over one folder of tables."""

from __future__ import annotations

from functools import cache
from pathlib import Path

import duckdb

import __spark_entry__ as entry_point

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "date": "DATE",
    "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP",
}


@cache
def database(path: str, tables: tuple[str, ...] = tuple(TABLES)) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in tables:
        file = Path(path) / f"{table}.parquet"
        files = file / "*.parquet" if file.is_dir() else file
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{files}')")
    return connection


def assert_same(result, name: str, connection: duckdb.DuckDBPyConnection) -> int:
    """Equal columns, types and values; returns the number of rows."""
    expected = connection.execute(entry_point.oracle_sql()[name])
    types = {column: str(kind) for column, kind, *_ in expected.description}
    assert {column: TYPES[kind] for column, kind in result.dtypes} == types
    got = sorted(map(repr, (tuple(r) for r in result.select(*types).collect())))
    assert got == sorted(map(repr, expected.fetchall()))
    return len(got)
