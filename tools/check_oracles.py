"""Run every registered query and its DuckDB oracle on one scale factor and compare exact values.

Usage: python tools/check_oracles.py [/root/testdata/sf0.01] [query ...]
Rows are compared as multisets after each side's own rounding, columns sorted by name.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from triplematch.plans.registry import load_all  # noqa: E402
from triplematch.session import local_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def _norm(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    try:
        return float(v)
    except (TypeError, ValueError):
        return v


def main() -> int:
    args = sys.argv[1:]
    sf = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    spark = local_session()
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    failed = 0
    for name, q in load_all().items():
        if args and name not in args:
            continue
        t0 = time.time()
        df = q.fn(spark, sf)
        cols = sorted(df.columns)
        got = sorted((tuple(_norm(x) for x in r) for r in df.select(*cols).collect()), key=repr)
        if q.oracle is None:
            print(f"{name:28s} rows={len(got):8d} (no oracle)")
            continue
        rel = con.sql(q.oracle)
        if sorted(rel.columns) != cols:
            print(f"{name:28s} COLUMNS {cols} vs {sorted(rel.columns)}")
            failed += 1
            continue
        idx = [rel.columns.index(c) for c in cols]
        want = sorted((tuple(_norm(r[i]) for i in idx) for r in rel.fetchall()), key=repr)
        ok = got == want
        failed += not ok
        print(f"{name:28s} rows={len(got):8d}/{len(want):8d} {time.time() - t0:6.1f}s {'OK' if ok else 'MISMATCH'}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
