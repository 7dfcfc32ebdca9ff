"""A query's result against the same SQL in DuckDB."""

import glob
import math
import os

import duckdb
import pandas as pd


def views(folder):
    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def plain(x):
    if x is None or x is pd.NA or isinstance(x, float) and math.isnan(x):
        return "none"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)) or type(x).__module__ == "numpy" and not hasattr(x, "__len__"):
        return f"{float(x):.6g}" if float(x) != int(x) or abs(x) < 1e6 else str(int(x))
    return str(x)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(map(plain, r)) for r in df.astype(object).itertuples(index=False))


def check(query, sql, spark, folder, con):
    got, want = query(spark, folder).toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
