"""Compare a query with its SQL on the same Parquet files."""

from __future__ import annotations

import glob
import os

import duckdb
import numpy as np
import pandas as pd


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET threads=16")  # more than the cores of a small machine: some plans fail only beyond their number
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def cell(x) -> str:
    if isinstance(x, (list, np.ndarray)):
        return str([cell(v) for v in x])
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and np.isnan(x)):
        return "null"
    if isinstance(x, (bool, np.bool_)):
        return str(bool(x))
    if isinstance(x, (int, float, np.integer, np.floating)):
        return f"{float(x):.9g}"
    return str(x)


def rows_of(frame: pd.DataFrame) -> list[tuple[str, ...]]:
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(cell(v) for v in row) for row in frame.itertuples(index=False, name=None))


def differences(spark, con, query, sql: str, sf_dir: str) -> str:
    """Empty if both give the same columns and rows."""
    ours, theirs = query(spark, sf_dir).toPandas(), con.execute(sql).df()
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} and {sorted(theirs.columns)}"
    a, b = rows_of(ours), rows_of(theirs)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows; {[x for x in a if x not in b][:2]} {[x for x in b if x not in a][:2]}"
    found = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return f"{len(found)} rows differ: {found[:2]}" if found else ""
