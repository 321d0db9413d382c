"""Run registered queries beside their check SQL and compare the results."""

from __future__ import annotations

import math
import os
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf_dir) -> dict:
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    out = {"name": name, "rows": len(got), "spark_s": round(t1 - t0, 2), "columns": sorted(df.columns)}
    if sql is None:
        return out | {"ok": len(got) > 0, "why": "rows only"}
    rel = con.sql(sql)
    want_columns = list(rel.columns)
    want = rows_of(want_columns, rel.fetchall())
    out["duck_s"] = round(time.time() - t1, 2)
    if sorted(want_columns) != sorted(df.columns):
        return out | {"ok": False, "why": f"columns {sorted(want_columns)} != {sorted(df.columns)}"}
    if got != want:
        only_got = [r for r in got if r not in set(want)][:3]
        only_want = [r for r in want if r not in set(got)][:3]
        return out | {"ok": False, "why": f"{len(got)} vs {len(want)} rows; spark {only_got} check {only_want}"}
    return out | {"ok": True, "why": ""}
