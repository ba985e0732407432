"""Runs a registered query in Spark and its oracle in DuckDB and compares the rows."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, queries, oracles, name: str, sf_dir: str) -> str:
    df = queries[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    rel = connect(sf_dir).execute(oracles[name])
    names = [c[0] for c in rel.description]
    want = rows_of(names, rel.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if got != want:
        odd = set(map(repr, got)) ^ set(map(repr, want))
        return f"{len(got)} and {len(want)} rows, {len(odd)} differ: {sorted(odd)[:4]}"
    return "" if got else "no rows"
