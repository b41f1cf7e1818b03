"""Runs queries in Spark and their SQL in DuckDB and compares the rows."""

from __future__ import annotations

import math
import os

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect(directory: str):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for name in sorted(os.listdir(directory)):
        if name.endswith(".parquet"):
            c.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM read_parquet('{directory}/{name}')")
    return c


def canonical(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if hasattr(v, "asDict"):
        return tuple(canonical(x) for x in v)
    if isinstance(v, dict):
        return tuple(canonical(x) for x in v.values())
    if isinstance(v, (list, tuple)):
        return tuple(canonical(x) for x in v)
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return round(float(v), 6)
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(canonical(r[i]) for i in order) for r in data), key=repr)


def compare(spark, name, query, sql, directory=SF):
    df = query(spark, directory)
    c = connect(directory)
    cur = c.execute(sql)
    cols = [x[0] for x in cur.description]
    assert sorted(df.columns) == sorted(cols), (name, df.columns, cols)
    got, want = rows(df.columns, df.collect()), rows(cols, cur.fetchall())
    if got != want:
        extra = [r for r in got if r not in want][:3]
        missing = [r for r in want if r not in got][:3]
        raise AssertionError(f"{name}: {len(got)} and {len(want)} rows; only in Spark {extra}; only in SQL {missing}")
    return len(got)
