"""Comparison of a query with its SQL in DuckDB, by value and without order."""

from __future__ import annotations

import os

import duckdb


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted((tuple(_plain(r[n]) for n in names) for r in df.collect()), key=repr)


def _plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return round(v, 6) if isinstance(v, float) else v


def sql_rows(sf_dir, sql):
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
    got = con.execute(sql)
    columns = [c[0] for c in got.description]
    names = sorted(columns)
    at = [columns.index(n) for n in names]
    return names, sorted((tuple(_plain(r[i]) for i in at) for r in got.fetchall()), key=repr)
