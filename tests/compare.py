"""Rows of a query against its SQL on the same files."""

from __future__ import annotations

import glob
import os

import duckdb


def _plain(x):
    if isinstance(x, float):
        return round(x, 6)
    if isinstance(x, (list, tuple)):
        return tuple(_plain(y) for y in x)
    return x


def rows_of(df):
    order = sorted(df.columns)
    return order, sorted((tuple(_plain(r[c]) for c in order) for r in df.collect()), key=repr)


def sql_rows(folder, sql):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in cur.fetchall()), key=repr)
