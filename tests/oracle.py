"""Compare a query with its SQL twin in DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = Path(folder) / f"{name}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def normal(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql: str) -> tuple[int, list]:
    """Row count and the first differences (empty when equal)."""
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    relation = con.sql(sql)
    theirs = rows_of(relation.columns, relation.fetchall())
    if sorted(df.columns) != sorted(relation.columns):
        return len(ours), [("columns", sorted(df.columns), sorted(relation.columns))]
    if len(ours) != len(theirs):
        return len(ours), [("rows", len(ours), len(theirs), ours[:2], theirs[:2])]
    # a value may differ in type only through int against float
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b or [type(x) for x in a] != [type(y) for y in b]]
    return len(ours), bad[:3]
