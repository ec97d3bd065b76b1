"""Run a registered query in Spark and its SQL in DuckDB and compare the results."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else f"{value:.6f}"
    return None if value is None else str(value)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(_cell(row[i]) for i in order) for row in rows),
        key=lambda r: tuple((v is not None, v or "") for v in r),
    )


def check(df, con, sql):
    """Names and rows of both; returns an error text or None."""
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    wanted = canonical(columns, cursor.fetchall())
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    if len(got) != len(wanted):
        return f"{len(got)} rows, expected {len(wanted)}"
    wrong = [(g, w) for g, w in zip(got, wanted) if g != w]
    return f"{len(wrong)} rows differ, first {wrong[0]}" if wrong else None
