"""Compares a Spark result with DuckDB's over the same tables."""

import glob
import os

import duckdb

SMALL = "/root/testdata/sf0.001"


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return int(value) if value.is_integer() else round(value, 6)
    return value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in data), key=repr)


def same(df, con, sql):
    cursor = con.execute(sql)
    columns, data = [c[0] for c in cursor.description], cursor.fetchall()
    assert sorted(df.columns) == sorted(columns)
    got = rows(df.columns, df.collect())
    assert got == rows(columns, data)
    return len(got)
