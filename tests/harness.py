"""Run a query on Spark and its SQL on DuckDB over the same tables and compare the rows."""

from __future__ import annotations

import math
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, sql: str, sf_dir: str) -> str:
    """Empty if both sides agree, else what differs first."""
    t = time.time()
    got = rows_of(df.columns, df.collect())
    t1 = time.time()
    rel = duck(sf_dir).execute(sql)
    names = [d[0] for d in rel.description]
    want = rows_of(names, rel.fetchall())
    print(f"spark {t1 - t:.1f}s duckdb {time.time() - t1:.1f}s rows {len(got)}")
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} {sorted(names)}"
    if len(got) != len(want):
        return f"rows {len(got)} {len(want)}"
    return next((f"{a} != {b}" for a, b in zip(got, want) if a != b), "")
