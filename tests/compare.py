"""Rows of Spark and of DuckDB in one form."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        v = float(v)
        return v if math.isinf(v) else round(v, 6) + 0.0
    if isinstance(v, (bool, int, str)):
        return v
    return str(v)


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=lambda r: tuple((x is None, str(type(x)), x) if not isinstance(x, (int, float)) else (False, "n", float(x)) for x in r))


def difference(df, con, sql: str) -> str | None:
    """None if the rows are the same; otherwise what differs."""
    got = rows(df.columns, df.collect())
    rel = con.sql(sql)
    want = rows(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} and {sorted(rel.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows, not {len(want)}; {got[:2]} {want[:2]}"
    for g, w in zip(got, want):
        if any(a != b and not (isinstance(a, (int, float)) and isinstance(b, (int, float)) and abs(a - b) < 1.5e-6) for a, b in zip(g, w)):
            return f"{g} is not {w}"
    return None
