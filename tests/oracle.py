"""Rows of a query and of its SQL, in a form that compares."""

import duckdb
import numpy as np
import pandas as pd


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def cell(v) -> str:
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and np.isnan(v):
        return "NULL"
    if isinstance(v, float | np.floating):
        return "%.9g" % (v + 0.0)
    if isinstance(v, bool | np.bool_):
        return str(bool(v))
    return str(v)


def rows(frame: pd.DataFrame) -> list[str]:
    cols = sorted(frame.columns)
    return sorted("|".join(map(cell, r)) for r in frame[cols].itertuples(index=False, name=None))


def same(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> None:
    assert sorted(spark_frame.columns) == sorted(sql_frame.columns)
    a, b = rows(spark_frame), rows(sql_frame)
    differing = [(x, y) for x, y in zip(a, b, strict=False) if x != y][:3]
    assert len(a) == len(b) and not differing, differing
