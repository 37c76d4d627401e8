"""Run registered queries next to their SQL in DuckDB and compare whole results."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return value


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, con, build, sql: str, sf_dir: str) -> str:
    """'' when columns, types and rows agree, else what differs."""
    df = build(spark, sf_dir)
    rel = con.sql(sql)
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} vs {sorted(rel.columns)}"
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
             "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "date": "DATE"}
    types = dict(zip(rel.columns, map(str, rel.types)))
    odd = {c: (t, types[c]) for c, t in df.dtypes if kinds.get(t) != types[c]}
    got = rows_of(df.columns, df.collect())
    want = rows_of(rel.columns, rel.fetchall())
    if got != want:
        extra, missing = got - want, want - got
        return (
            f"rows {sum(got.values())} vs {sum(want.values())}; only spark "
            f"{list(extra.items())[:3]}; only sql {list(missing.items())[:3]}"
        )
    return f"types {odd}" if odd else ""
