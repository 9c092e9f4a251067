"""Compare a Spark result with DuckDB on the same tables, ignoring row order."""

from __future__ import annotations

import glob
import math
import os

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect(folder: str):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return round(v, 9) + 0.0
    return v


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(norm(r[i]) for i in order) for r in values]
    return [columns[i] for i in order], sorted(out, key=repr)


def differences(df, con, sql: str) -> str | None:
    """None when equal, else a short description."""
    rel = con.execute(sql)
    want_cols, want = rows([d[0] for d in rel.description], rel.fetchall())
    got_cols, got = rows(df.columns, [tuple(r) for r in df.collect()])
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"{len(got)} rows, oracle {len(want)}"
    kinds = [(c, type(a), type(b)) for g, w in zip(got, want)
             for c, a, b in zip(got_cols, g, w)
             if a is not None and b is not None and type(a) is not type(b)]
    if kinds:
        return f"types differ: {kinds[0]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, first {got_cols}: {bad[0]}"
    return None
