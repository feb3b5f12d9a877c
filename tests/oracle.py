"""Run queries and their SQL side by side: column names, types, row count, values."""

from __future__ import annotations

import collections
import datetime
import decimal
import os

import duckdb

TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN",
    "double": "DOUBLE", "timestamp_ntz": "TIMESTAMP", "date": "DATE", "float": "FLOAT",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in sorted(os.listdir(sf_dir)):
        table, path = name.removesuffix(".parquet"), f"{sf_dir}/{name}"
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{files}')")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def compare(df, con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], int]:
    """Differences between a DataFrame and a SQL answer, and the row count."""
    relation = con.sql(sql)
    want_types = dict(zip(relation.columns, map(str, relation.types)))
    have_types = {c: TYPES.get(t, t) for c, t in df.dtypes}
    problems = []
    if want_types != have_types:
        problems.append(f"schema: {have_types} instead of {want_types}")
    columns = sorted(have_types)
    if sorted(want_types) != columns:
        return problems, -1
    have = collections.Counter(
        tuple(_plain(row[c]) for c in columns) for row in df.select(*columns).collect()
    )
    order = [relation.columns.index(c) for c in columns]
    want = collections.Counter(
        tuple(_plain(row[i]) for i in order) for row in relation.fetchall()
    )
    if have != want:
        problems.append(
            f"rows: {sum(have.values())} and {sum(want.values())}; "
            f"only here {list((have - want).items())[:3]}; "
            f"only SQL {list((want - have).items())[:3]}"
        )
    return problems, sum(have.values())
