"""Runs a query on Spark and its SQL on DuckDB, and compares the rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir) / f"{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p if p.is_file() else str(p) + '/*.parquet'}'")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if hasattr(v, "item"):
        return norm(v.item())
    if isinstance(v, list | tuple):
        return tuple(norm(x) for x in v)
    return v


def difference(df, sql: str, sf_dir: str, names: bool = True) -> str:
    """Empty, or what differs."""
    cur = duck(sf_dir).execute(sql)
    cols = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(cols)}"
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    key = lambda r: tuple((x is not None, str(type(x)), x) for x in r)
    a = sorted((tuple(norm(r[i]) for i in order) for r in want), key=key)
    b = sorted((tuple(norm(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=key)
    if len(a) != len(b):
        return f"{len(b)} rows against {len(a)}"
    bad = [(x, y) for x, y in zip(b, a, strict=True) if x != y]
    return f"{len(bad)} of {len(a)} rows differ, first {bad[0]}" if bad else ""
