"""Compare a query with its SQL in DuckDB."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def text(value: object) -> str:
    if value is None or (isinstance(value, float) and value != value) or value is pd.NaT or value is pd.NA:
        return "None"
    if isinstance(value, float):
        return str(round(value, 6))
    if hasattr(value, "tolist"):
        value = value.tolist()
    return str(value).replace("+00:00", "")


def rows(frame: pd.DataFrame) -> list[tuple]:
    names = sorted(frame.columns)
    columns = []
    for n in names:
        whole = frame[n].map(lambda v: int(v) if isinstance(v, float) and v == v and v.is_integer() else v)
        columns.append([text(v) for v in whole])
    return sorted(zip(*columns, strict=True))
