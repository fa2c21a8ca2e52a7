"""Holding a query against SQL that another engine runs."""

from __future__ import annotations

import datetime
import math
import os

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for file in os.listdir(folder):
        path = f"{folder}/{file}"
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return round(float(value), 9)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return str(value)


def rows(columns: list[str], data: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


def same(query, sql: str, spark, folder: str) -> None:
    got = query(spark, folder)
    with connect(folder) as con:
        want = con.execute(sql)
        columns, data = [d[0] for d in want.description], want.fetchall()
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, data)
