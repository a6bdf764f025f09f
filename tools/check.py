"""Compare registered queries with their oracle SQL, as an independent check.

usage: python tools/check.py [--sf DIR] [prefix ...]
"""

from __future__ import annotations

import importlib
import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(v)
    return f"{type(v).__name__}:{v}"


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def compare(cols, rows, con, sql):
    """None when the rows equal the oracle's as a multiset, else a description of the difference."""
    cur = con.execute(sql)
    theirs = [c[0] for c in cur.description]
    other = cur.fetchall()
    if sorted(cols) != sorted(theirs):
        return f"columns {sorted(cols)} vs {sorted(theirs)}"
    mine, yours = [cols.index(c) for c in sorted(cols)], [theirs.index(c) for c in sorted(cols)]
    a = Counter(tuple(norm(r[i]) for i in mine) for r in rows)
    b = Counter(tuple(norm(r[i]) for i in yours) for r in other)
    if a == b:
        return None
    show = lambda c: "\n      ".join(map(str, sorted(c.elements())[:3]))
    return f"{len(rows)} vs {len(other)} rows; {sorted(cols)}\n   spark only\n      {show(a - b)}\n   oracle only\n      {show(b - a)}"


def main():
    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if "--sf" in args:
        i = args.index("--sf")
        sf = args[i + 1]
        del args[i : i + 2]
    from voxelcohort.session import local_session, scratch_scope

    entry = importlib.import_module("__spark_entry__")
    queries, oracles = entry.queries(), entry.oracle_sql()
    spark = local_session(8, 8)
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf), []
    for name, fn in queries.items():
        if args and not any(name.startswith(a) for a in args):
            continue
        start = time.time()
        try:
            with scratch_scope(spark):
                df = fn(spark, sf)
                rows = [tuple(r) for r in df.collect()]
            took = f"{len(rows)} rows {time.time() - start:.2f}s"
            problem = compare(df.columns, rows, con, oracles[name]) if name in oracles else None
        except Exception as e:
            took, problem = "", f"{type(e).__name__} {str(e).strip()[:900]}"
        if problem:
            bad.append(name)
        print(f"FAIL {name}: {problem}" if problem else f"{'ok  ' if name in oracles else 'rows'} {name}: {took}", flush=True)
    print(f"{len(bad)} bad: {bad}")
    spark.stop()


if __name__ == "__main__":
    main()
