"""Comparison of a query with its SQL, as multisets of rows."""

import glob
import os
from collections import Counter

import duckdb
import pandas as pd


def views(folder):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def value(v):
    if v is None or v is pd.NA or v != v:
        return None
    if isinstance(v, (bool, str)):
        return str(v)
    try:
        return round(float(v), 5)
    except (TypeError, ValueError):
        return str(v)


def rows(frame, columns):
    return Counter(tuple(value(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False))


def same(frame, con, sql):
    other = con.sql(sql).df()
    columns = sorted(other.columns)
    assert columns == sorted(frame.columns)
    a, b = rows(frame, columns), rows(other, columns)
    assert a == b, (list((a - b).items())[:3], list((b - a).items())[:3])
