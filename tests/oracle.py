"""Runs a query and its DuckDB equivalent and compares rows without regard to order."""

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sql: str, folder: str) -> pd.DataFrame:
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c.execute(sql).df()


def plain(v):
    if v is None or v is pd.NaT or (isinstance(v, (float, np.floating)) and v != v):
        return None
    if isinstance(v, (float, np.floating)):
        return round(float(v), 6)
    if isinstance(v, np.integer):
        return int(v)
    if isinstance(v, np.bool_):
        return bool(v)
    return v


def rows(df: pd.DataFrame):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(v) for v in r) for r in df[names].itertuples(index=False, name=None)), key=str)


def assert_equal(spark_df, sql: str, folder: str) -> None:
    assert rows(spark_df.toPandas()) == rows(duck(sql, folder))
