"""Run a query in Spark and its SQL in DuckDB and compare the rows, whatever their order."""

import os

import duckdb
import pandas as pd

DATA = "/root/testdata/sf0.001"


def value(x):
    if x is None or x is pd.NaT or x is pd.NA:
        return "null"
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, bool):
        return repr(x)
    if isinstance(x, (int, float)):
        return "null" if x != x else repr(round(float(x), 7) + 0.0)
    if hasattr(x, "isoformat"):
        return x.isoformat()[:19].removesuffix("T00:00:00")
    return repr(x)


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return list(frame.columns), sorted(tuple(map(value, r)) for r in frame.itertuples(index=False, name=None))


def connect(path=DATA):
    c = duckdb.connect()
    for file in os.listdir(path):
        source = f"{path}/{file}/*.parquet" if os.path.isdir(f"{path}/{file}") else f"{path}/{file}"
        c.execute(f"create view {file.split('.')[0]} as select * from read_parquet('{source}')")
    return c


def same(spark, query, sql, path=DATA):
    assert rows(query(spark, path).toPandas()) == rows(connect(path).execute(sql).df())
