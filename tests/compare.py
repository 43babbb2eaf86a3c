"""Runs a query in Spark and its SQL in DuckDB and compares the rows, whatever their order."""

import glob
import os

import duckdb
import pandas as pd


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).split(".")[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def normal(x):
    if x is None or x is pd.NaT or (isinstance(x, float) and x != x):
        return ("", "null")
    if isinstance(x, float):
        return ("f", repr(round(x, 9) + 0.0))
    if hasattr(x, "isoformat"):
        return ("t", pd.Timestamp(x).isoformat())
    if isinstance(x, list):
        return ("l", repr([normal(y) for y in x]))
    return (type(x).__name__, str(x))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(r[i]) for i in order) for r in rows), [columns[i] for i in order]


def differences(spark, con, query, sql, sf_dir):
    df = query(spark, sf_dir)
    got, names = rows_of(df.columns, df.collect())
    out = con.execute(sql)
    want, wanted = rows_of([d[0] for d in out.description], out.fetchall())
    if names != wanted:
        return f"columns {names} {wanted}"
    if got != want:
        odd = [(a, b) for a, b in zip(got, want, strict=False) if a != b][:2]
        return f"{len(got)} rows against {len(want)}: {odd}"
    return ""
