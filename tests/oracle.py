"""Holds a Spark result against DuckDB, without regard to the order of rows and columns."""

from __future__ import annotations

import glob
import os

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        files = path if os.path.isfile(path) else f"{path}/*.parquet"
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{files}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if value != value else round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def rows(columns: list[str], found) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[k]) for k in order) for r in found), key=repr)


def same(df, con, sql: str) -> None:
    told = con.execute(sql)
    names = [d[0] for d in told.description]
    want = rows(names, told.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == want
