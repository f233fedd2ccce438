"""Run registered queries next to their checking SQL and compare the rows.

usage: python tools/check.py [--dir DIR] [--only name,name | --module part]
"""

from __future__ import annotations

import argparse
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from marginalia.catalog import load  # noqa: E402
from marginalia.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def normal(value):
    if value is None:
        return None
    if hasattr(value, "isoformat"):
        return str(value)
    if isinstance(value, float):
        return repr(round(value, 6) + 0.0)
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, int):
        return repr(float(value)) if abs(value) < 2**53 else str(value)
    if isinstance(value, (list, tuple)):
        return str([normal(v) for v in value])
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(normal(r[i])) for i in order) for r in rows)


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--dir", default="/root/testdata/sf0.01")
    ap.add_argument("--only")
    ap.add_argument("--module")
    args = ap.parse_args()
    entries = load()
    names = args.only.split(",") if args.only else list(entries)
    if args.module:
        names = [n for n in names if entries[n].run.__module__.endswith(args.module)]
    spark = build_session("check", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{args.dir}/{t}.parquet'")
    bad = 0
    for name in names:
        e = entries[name]
        t0 = time.time()
        try:
            df = e.run(spark, args.dir)
            got = [tuple(r) for r in df.collect()]
            t1 = time.time()
            if e.sql is None:
                print(f"rows  {name}: {len(got)} rows, {t1 - t0:.1f}s")
                continue
            cur = con.execute(e.sql)
            cols = [d[0] for d in cur.description]
            want = cur.fetchall()
            t2 = time.time()
            if sorted(cols) != sorted(df.columns):
                bad += 1
                print(f"BAD   {name}: columns {sorted(df.columns)} vs {sorted(cols)}")
                continue
            a, b = rows_of(df.columns, got), rows_of(cols, want)
            state = "ok  " if a == b else "BAD "
            kinds = {c[0]: str(c[1]) for c in cur.description}
            mixed = [
                (f.name, f.dataType.simpleString(), kinds[f.name])
                for f in df.schema.fields
                if {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
                    "date": "DATE", "timestamp": "TIMESTAMP"}.get(f.dataType.simpleString()) != kinds[f.name].split("(")[0]
            ]
            note = f" types {mixed}" if mixed else ""
            print(f"{state}  {name}: {len(a)}/{len(b)} rows, spark {t1 - t0:.1f}s, duckdb {t2 - t1:.1f}s{note}")
            if a != b:
                bad += 1
                sa, sb = set(a), set(b)
                print("   cols ", sorted(cols))
                for label, part in (("spark", sorted(sa - sb)[:3]), ("sql  ", sorted(sb - sa)[:3])):
                    for r in part:
                        print("   only", label, str(r)[:400])
        except Exception as exc:  # report and go on with the next query
            bad += 1
            print(f"FAIL  {name}: {type(exc).__name__} {str(exc)[:700]}")
            if os.environ.get("TRACE"):
                traceback.print_exc()
    print(f"{len(names)} queries, {bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
