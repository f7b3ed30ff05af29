"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

usage: python tests/oracle_check.py [sf_dir] [name ...]
"""
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

import __spark_entry__ as se  # noqa: E402
from tabprobe.session import get_session  # noqa: E402
from tabprobe.sources.tables import TABLES  # noqa: E402


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 5)
    return v


def canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


def main():
    args = sys.argv[1:]
    sf = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")]
    spark = get_session()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    qs, sql = se.queries(), se.oracle_sql()
    bad = []
    for name in names or list(qs):
        t0 = time.time()
        try:
            df = qs[name](spark, sf)
            rows = [tuple(r) for r in df.collect()]
            cols = df.columns
        except Exception as exc:  # noqa: BLE001
            print(f"FAIL  {name}: spark error {str(exc)[:300]}")
            bad.append(name)
            continue
        ts = time.time() - t0
        if name not in sql:
            print(f"rows  {name}: {len(rows)} rows ({ts:.1f}s, no oracle)")
            continue
        try:
            cur = con.execute(sql[name])
            orows = cur.fetchall()
            ocols = [d[0] for d in cur.description]
        except Exception as exc:  # noqa: BLE001
            print(f"FAIL  {name}: duckdb error {str(exc)[:300]}")
            bad.append(name)
            continue
        if sorted(cols) != sorted(ocols):
            print(f"FAIL  {name}: columns {sorted(cols)} vs {sorted(ocols)}")
            bad.append(name)
            continue
        a, b = canon(rows, cols), canon(orows, ocols)
        if len(a) != len(b):
            print(f"FAIL  {name}: rows {len(a)} vs {len(b)}")
            bad.append(name)
            continue
        if a != b:
            diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
            print(f"FAIL  {name}: values differ, e.g. {diff}")
            bad.append(name)
            continue
        print(f"ok    {name}: {len(rows)} rows ({ts:.1f}s)")
    print("FAILED:", bad)


if __name__ == "__main__":
    main()
