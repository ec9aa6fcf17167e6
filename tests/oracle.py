"""Run registered jobs next to their SQL check. `python tests/oracle.py sf0.01 [name ...]`."""

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from firn.catalog import CHECKS, JOBS
from firn.catalog.views import TABLES

DATA = "/root/testdata"


def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{sf}/{t}.parquet')")
    return con


def canon(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(v + 0.0)
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(canon(r[i]) for i in order) for r in rows)


def compare(spark, con, sf, name):
    """None when equal, else a short description of the first difference."""
    df = JOBS[name](spark, f"{DATA}/{sf}")
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in CHECKS:
        return None if got[1] else "no rows"
    cur = con.execute(CHECKS[name])
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}"
    for a, b in zip(got[1], want[1]):
        if a != b:
            return f"{got[0]}: spark {a} != sql {b}"
    if not got[1]:
        return "no rows"
    return None


if __name__ == "__main__":
    from firn.session import local_session

    sf, names = sys.argv[1], sys.argv[2:]
    names = [n for n in JOBS if not names or any(n.startswith(p) for p in names)]
    spark, con = local_session(8), duck(sf)
    bad = 0
    for n in names:
        t = time.time()
        try:
            diff = compare(spark, con, sf, n)
        except Exception as e:
            diff = f"{type(e).__name__}: {str(e)[:600]}"
        bad += diff is not None
        print(f"{'ok ' if diff is None else 'BAD'} {n} {time.time() - t:.1f}s"
              f"{'' if n in CHECKS else ' (rows only)'} {diff or ''}", flush=True)
    print(f"{len(names)} jobs, {bad} bad")
