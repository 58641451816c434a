"""Run a registered query and its SQL twin on the same tables and compare the rows."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        path = os.path.join(folder, f"{name}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return ("nan",)
        return value + 0.0
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    key = lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r)
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=key)


def spark_rows(df):
    return sorted(df.columns), rows_of(df.columns, [tuple(r) for r in df.collect()])


def oracle_rows(con, sql: str):
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    return sorted(columns), rows_of(columns, cur.fetchall())


def difference(left, right, tolerance: float = 0.0) -> str | None:
    """None when equal, else the first difference."""
    if left[0] != right[0]:
        return f"columns {set(left[0]) ^ set(right[0])}"
    if len(left[1]) != len(right[1]):
        return f"rows {len(left[1])} against {len(right[1])}"
    for a, b in zip(left[1], right[1]):
        for name, x, y in zip(left[0], a, b):
            same = x == y
            if not same and isinstance(x, float) and isinstance(y, float):
                same = abs(x - y) <= tolerance
            if not same or type(x) is not type(y):
                return f"{name}: {x!r} against {y!r} in {a} / {b}"
    return None
