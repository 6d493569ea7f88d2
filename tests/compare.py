"""Compare a registered query with its DuckDB SQL, row by row."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return f"{type(value).__name__}:{value}"


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def differences(spark_df, con, sql: str, show: int = 5) -> list[str]:
    """Human-readable differences; empty when both sides agree exactly."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    expected, actual = cursor.fetchall(), [tuple(r) for r in spark_df.collect()]
    if sorted(names) != sorted(spark_df.columns):
        return [f"columns: spark {sorted(spark_df.columns)} sql {sorted(names)}"]
    if not actual:
        return ["no rows"]
    left, right = _rows(spark_df.columns, actual), _rows(names, expected)
    if left == right:
        return []
    found = [f"rows: spark {len(left)} sql {len(right)}"]
    only_left, only_right = sorted(set(left) - set(right)), sorted(set(right) - set(left))
    columns = sorted(names)
    for a, b in list(zip(only_left, only_right))[:show]:
        found.append(str([(c, x, y) for c, x, y in zip(columns, a, b) if x != y][:8]))
    return found
