"""Spark and DuckDB results side by side."""

from __future__ import annotations

import decimal
import glob
import os

import duckdb
import pandas as pd


def normal(df) -> list[tuple]:
    def value(x):
        if x is None or x is pd.NA or x is pd.NaT or x != x:
            return None
        if isinstance(x, decimal.Decimal):
            x = float(x)
        x = x.item() if hasattr(x, "item") else x
        return int(x) if isinstance(x, bool) else round(x, 6) + 0.0 if isinstance(x, float) else x

    return sorted(tuple(repr(value(v)) for v in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


def same(spark, folder: str, query, sql: str) -> None:
    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    ours, theirs = query(spark, folder).toPandas(), con.execute(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert normal(ours) == normal(theirs)
