"""Compares a registered query with its SQL oracle."""

from __future__ import annotations

import datetime as dt
import glob
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        table = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    return connection


def _plain(value):
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    table = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(table, key=repr)


def spark_rows(df):
    return _rows(df.columns, [tuple(r) for r in df.collect()])


def oracle_rows(connection, sql: str):
    result = connection.execute(sql)
    return _rows([d[0] for d in result.description], result.fetchall())


def difference(df, connection, sql: str) -> str | None:
    """None when both give the same rows, else a short description."""
    columns, rows = spark_rows(df)
    expected_columns, expected = oracle_rows(connection, sql)
    if columns != expected_columns:
        return f"columns {columns} != {expected_columns}"
    if rows == expected:
        return None
    ours, theirs = set(map(repr, rows)), set(map(repr, expected))
    return f"{len(rows)} rows, expected {len(expected)}; only ours {sorted(ours - theirs)[:2]}, only oracle {sorted(theirs - ours)[:2]}"
