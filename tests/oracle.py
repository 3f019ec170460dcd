"""Compares a query with its SQL in DuckDB, order aside."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    if isinstance(v, (int, float)) or type(v).__name__ in ("int32", "int64", "float64", "Decimal"):
        return str(round(float(v), 6) + 0.0)
    return str(list(v)) if hasattr(v, "__len__") and not isinstance(v, (str, bytes)) else str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(([plain(v) for v in r] for r in df.astype(object).where(df.notna(), None).values.tolist()), key=str)


def same(spark, con, sf_dir, run, sql):
    a, b = run(spark, sf_dir).toPandas(), con.execute(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a) == rows(b)
