"""Runs queries beside their SQL and compares what they return."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{files}'")
    return con


def plain(x):
    return float(f"{x:.9g}") if isinstance(x, float) and not math.isnan(x) else x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted([tuple(plain(r[i]) for i in order) for r in rows], key=repr)


def compare(spark, con, query, sql: str, sf_dir: str) -> str:
    """Empty if they agree, else what differs."""
    df = query(spark, sf_dir)
    cursor = con.execute(sql)
    wanted = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    got = rows_of(df.columns, df.collect())
    if got[0] != wanted[0]:
        return f"columns {got[0]} and {wanted[0]}"
    if len(got[1]) != len(wanted[1]):
        return f"{len(got[1])} and {len(wanted[1])} rows"
    odd = [(a, b) for a, b in zip(got[1], wanted[1]) if a != b]
    return f"{len(odd)} rows differ, as {odd[0]}" if odd else ""
