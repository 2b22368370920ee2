"""Run registered queries on Spark and their SQL twins on DuckDB and compare all rows.

usage: python check_queries.py [--sf 0.01] [name or prefix ...]
"""

from __future__ import annotations

import argparse
import sys
import time

import duckdb

from sparkbars.plans import catalogue
from sparkbars.session import build_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def norm(v):
    if v is None or v != v:
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int,)):
        return repr(float(v))
    return repr(v) if isinstance(v, float) else str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows), [columns[i] for i in order]


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--show", type=int, default=3)
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    folder = f"/root/testdata/sf{args.sf}"
    spark = build_session("check", "local[8]", 8, "12g")
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    bad = []
    for name, q in catalogue().items():
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        try:
            t0 = time.time()
            df = q.run(spark, folder)
            got = [tuple(r) for r in df.collect()]
            t1 = time.time()
            if q.sql() is None:
                print(f"rows  {name}: {len(got)} rows, spark {t1 - t0:.1f}s", flush=True)
                continue
            con.execute(q.sql())
            names = [c[0] for c in con.description]
            want = con.fetchall()
            t2 = time.time()
            a, ca = rows_of(df.columns, got)
            b, cb = rows_of(names, want)
            nulls = sum(1 for r in a for v in r if v == "")
            cells = max(1, len(a) * len(ca))
            if ca == cb and a == b and a:
                print(f"ok    {name}: {len(a)} rows, null {100 * nulls // cells}%, spark {t1 - t0:.1f}s duckdb {t2 - t1:.1f}s", flush=True)
            else:
                bad.append(name)
                print(f"DIFF  {name}: spark {len(a)} duckdb {len(b)} rows; columns {ca} {'' if ca == cb else cb}", flush=True)
                sa, sb = set(a), set(b)
                x, y = sorted(sa - sb), sorted(sb - sa)
                print(f"      only spark {len(x)}, only duckdb {len(y)}")
                for r in x[: args.show]:
                    print("      S", r)
                for r in y[: args.show]:
                    print("      D", r)
        except Exception as e:  # keep going: this is a report
            bad.append(name)
            print(f"ERROR {name}: {str(e)[:1500]}", flush=True)
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
