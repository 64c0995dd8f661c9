"""Runs a query's SQL twin in DuckDB and compares."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def run(sql, folder):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{folder}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    rel = con.sql(sql)
    return rel.columns, rel.fetchall()


def plain(x):
    if isinstance(x, float):
        return f"{x:.9g}"
    return str(x)


def same(df, sql, folder):
    columns, rows = run(sql, folder)
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    ours = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    at = [columns.index(c) for c in order]
    theirs = sorted(tuple(plain(r[i]) for i in at) for r in rows)
    assert ours == theirs
