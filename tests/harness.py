"""Run a query on both engines and compare rows, whatever their order."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def second_engine(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{files}')")
    return con


def shown(value) -> str:
    if value is None or isinstance(value, float) and math.isnan(value):
        return "-"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return repr(round(value, 6))
    return str(value)


def differences(spark_rows, columns: list[str], con: duckdb.DuckDBPyConnection, text: str) -> str:
    """Empty if both have the same columns and rows."""
    rel = con.sql(text)
    if sorted(rel.columns) != sorted(columns):
        return f"columns {sorted(columns)} and {sorted(rel.columns)}"
    order = [rel.columns.index(c) for c in columns]
    theirs = sorted(tuple(shown(r[i]) for i in order) for r in rel.fetchall())
    ours = sorted(tuple(shown(v) for v in r) for r in spark_rows)
    if ours == theirs:
        return ""
    extra = [r for r in ours if r not in set(theirs)][:3], [r for r in theirs if r not in set(ours)][:3]
    return f"{len(ours)} and {len(theirs)} rows; only here {extra[0]}; only there {extra[1]}"
