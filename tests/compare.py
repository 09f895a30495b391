"""Runs a query and its SQL over the same tables and compares all rows."""

import math
import os
from collections import Counter
from datetime import date

import duckdb

FOLDER = "/root/testdata/sf0.001"


def norm(x):
    if x is None:
        return None
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(norm(i) for i in x)
    if isinstance(x, (int, bool)):
        return float(x)
    if isinstance(x, date):
        return x.isoformat()[:10]
    return str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(norm(r[i]) for i in order) for r in rows)


def sql_rows(sql, folder=FOLDER):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(folder):
        c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{folder}/{f}'")
    out = c.sql(sql)
    return out.columns, out.fetchall()


def check(spark, query, sql, folder=FOLDER):
    df = query(spark, folder)
    columns, rows = sql_rows(sql, folder)
    assert sorted(df.columns) == sorted(columns)
    mine, theirs = rows_of(df.columns, df.collect()), rows_of(columns, rows)
    assert mine == theirs, (list((mine - theirs).items())[:3], list((theirs - mine).items())[:3])
