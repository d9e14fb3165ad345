"""Compare registered queries with their SQL in DuckDB, value by value."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(row[i]) for i in order) for row in rows]
    return [names[i] for i in order], sorted(out, key=lambda t: tuple((v is None, str(type(v)), v if v is not None else 0) for v in t))


def compare(spark, con, sf: str, name: str, fn, sql: str) -> str:
    """Empty when equal, else what differs."""
    df = fn(spark, sf)
    got = table(df.columns, [tuple(x) for x in df.collect()])
    cur = con.execute(sql)
    want = table([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}"
    bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b or list(map(type, a)) != list(map(type, b))]
    return "" if not bad else f"{len(bad)} of {len(got[1])} rows differ, e.g. {bad[0]}"


if __name__ == "__main__":
    import __spark_entry__ as e
    from linkcast.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    spark, con = local_session(8), duck(sf)
    for name, fn in e.queries().items():
        if only and not any(o in name for o in only):
            continue
        t = time.time()
        try:
            sql = e.oracle_sql().get(name)
            if sql is None:
                df = fn(spark, sf)
                msg = f"rows only: {df.count()} {df.columns[:8]}"
            else:
                msg = compare(spark, con, sf, name, fn, sql) or "ok"
        except Exception as exc:
            msg = f"FAILED {type(exc).__name__}: {str(exc)[:600]}"
        print(f"{name:34s} {time.time() - t:6.2f}s {msg[:900]}", flush=True)
