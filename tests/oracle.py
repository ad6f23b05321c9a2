"""Run a registered query and its SQL over one folder and compare all values."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for file in sorted(Path(folder).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    return value


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, [tuple(_plain(row[n]) for n in names) for row in df.collect()]


def sql_rows(connection, sql: str) -> tuple[list[str], list[tuple]]:
    cursor = connection.execute(sql)
    found = [d[0] for d in cursor.description]
    names = sorted(found)
    places = [found.index(n) for n in names]
    return names, [tuple(_plain(row[i]) for i in places) for row in cursor.fetchall()]


def difference(df, connection, sql: str) -> str | None:
    """None if both give the same columns and the same rows in any order."""
    names, rows = spark_rows(df)
    sql_names, wanted = sql_rows(connection, sql)
    if names != sql_names:
        return f"columns {names} != {sql_names}"
    kinds = [{type(r[i]).__name__ for r in rows if r[i] is not None} for i in range(len(names))]
    sql_kinds = [{type(r[i]).__name__ for r in wanted if r[i] is not None} for i in range(len(names))]
    for name, a, b in zip(names, kinds, sql_kinds):
        if a != b:
            return f"types of {name}: {a} != {b}"
    left, right = sorted(map(repr, rows)), sorted(map(repr, wanted))
    if left != right:
        extra = [a for a in left if a not in set(right)][:3]
        lacking = [b for b in right if b not in set(left)][:3]
        return f"{len(left)} rows != {len(right)} rows; only Spark {extra}; only SQL {lacking}"
    return None
