"""Compare registered queries with their SQL twins: ``python tools/check.py [prefix ...] [--sf DIR]``."""

from __future__ import annotations

import math
import sys
import time
import traceback
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from knownat import plans  # noqa: E402
from knownat.session import build_session  # noqa: E402

STRICT = "--strict" in sys.argv
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else (v if STRICT else round(v, 5)) + 0.0
    if isinstance(v, int):
        return float(v)
    if hasattr(v, "as_tuple"):
        return round(float(v), 5)
    return str(v)


def key(row):
    return tuple((x is None, str(type(x)), str(x)) for x in row)


def compare(spark, con, name, run, sql, sf):
    started = time.time()
    df = run(spark, sf)
    cols = sorted(df.columns)
    got = [tuple(norm(r[c]) for c in cols) for r in df.collect()]
    took = time.time() - started
    if sql is None:
        return f"ok   {name} rows={len(got)} (no SQL) {took:.1f}s", True
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"FAIL {name} columns {cols} vs {sorted(names)}", False
    order = [names.index(c) for c in cols]
    want = [tuple(norm(r[i]) for i in order) for r in cur.fetchall()]
    got.sort(key=key), want.sort(key=key)
    if got == want:
        return f"ok   {name} rows={len(got)} {took:.1f}s", True
    bad = [(g, w) for g, w in zip(got, want) if g != w][:2]
    only_g = [g for g in got if g not in set(want)][:3]
    only_w = [w for w in want if w not in set(got)][:3]
    return f"FAIL {name} rows {len(got)} vs {len(want)}\n   cols {cols}\n   spark {only_g or bad}\n   sql   {only_w}", False


def main(argv):
    sf = "/root/testdata/sf0.01"
    if "--sf" in argv:
        at = argv.index("--sf")
        sf = argv[at + 1]
        argv = argv[:at] + argv[at + 2:]
    argv = [a for a in argv if a != "--strict"]
    spark = build_session("local[8]")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    queries, oracles = plans.queries(), plans.oracle_sql()
    failed = 0
    for name, run in queries.items():
        if argv and not any(name.startswith(p) for p in argv):
            continue
        try:
            text, good = compare(spark, con, name, run, oracles.get(name), sf)
        except Exception as e:  # report and go on with the next query
            text, good = f"FAIL {name} {type(e).__name__}: {str(e)[:700]}", False
            if "-v" in argv:
                traceback.print_exc()
        failed += not good
        print(text[:2500], flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    raise SystemExit(1 if main(sys.argv[1:]) else 0)
