"""Compare registered queries with DuckDB; also a command line: python tests/oracle.py DIR [prefix...]."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    out = [tuple(_norm(r[k]) for k in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def compare(spark, sf_dir: str, name: str, con=None) -> tuple[bool, str]:
    from plumeflux.plans import ORACLES, QUERIES

    start = time.time()
    df = QUERIES[name](spark, sf_dir)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    spent = time.time() - start
    if name not in ORACLES:
        return len(got) > 0, f"rows={len(got)} {spent:.1f}s (no SQL)"
    start = time.time()
    cur = (con or duck(sf_dir)).execute(ORACLES[name])
    cols = [d[0] for d in cur.description]
    want = _rows(cols, cur.fetchall())
    if sorted(cols) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(cols)}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    note = f"rows={len(got)}/{len(want)} spark={spent:.1f}s duck={time.time() - start:.1f}s"
    if len(got) != len(want) or bad:
        return False, f"{note} diff={len(bad)} first={bad[:2]}"
    return True, note


def main(argv: list[str]) -> int:
    from plumeflux.plans import QUERIES
    from plumeflux.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(argv[0])
    failed = []
    for name in QUERIES:
        if len(argv) > 1 and not any(name.startswith(p) for p in argv[1:]):
            continue
        try:
            ok, note = compare(spark, argv[0], name, con)
        except Exception as e:  # report and go on with the rest
            ok, note = False, f"{type(e).__name__}: {str(e)[:600]}"
        print("ok  " if ok else "FAIL", name, note, flush=True)
        if not ok:
            failed.append(name)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
