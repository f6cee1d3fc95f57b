"""Compares a query with its SQL over the same Parquet files."""

import glob
import os

import duckdb
import pandas as pd


def connect(where):
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{where}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


def _cell(v):
    if not isinstance(v, (list, dict, tuple)) and pd.isna(v):
        return None
    if isinstance(v, float) or hasattr(v, "dtype"):
        f = round(float(v), 6)
        return str(int(f)) if f == int(f) else str(f)
    return str(v)


def normal(df):
    return sorted((tuple(_cell(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=str)


def same(spark, connection, query, sql, where):
    mine, theirs = query(spark, where).toPandas(), connection.sql(sql).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert normal(mine) == normal(theirs)
