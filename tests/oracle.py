"""Runs a query and its oracle side by side."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(rows: list[dict]) -> list[tuple]:
    def one(v):
        if isinstance(v, float):
            return None if math.isnan(v) else float(f"{v:.9g}")
        return v

    return sorted((tuple(one(r[c]) for c in sorted(r)) for r in rows), key=lambda t: tuple((x is None, str(x)) for x in t))


def differences(spark, sf_dir: str, query, sql: str) -> str:
    """Empty if the query and the oracle agree in columns and rows."""
    got = query(spark, sf_dir)
    rows = canonical([r.asDict() for r in got.collect()])
    con = connect(sf_dir)
    found = con.execute(sql)
    names = [x[0] for x in found.description]
    want = canonical([dict(zip(names, r)) for r in found.fetchall()])
    con.close()
    if sorted(names) != sorted(got.columns):
        return f"columns {sorted(got.columns)} and {sorted(names)}"
    if rows != want:
        only = [r for r in rows if r not in want[:20000]][:3], [r for r in want if r not in rows[:20000]][:3]
        return f"{len(rows)} and {len(want)} rows; {only}"
    return "" if rows else "no rows"
