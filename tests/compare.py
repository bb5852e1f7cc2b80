"""Run queries and their SQL side by side: python tests/compare.py [--sf DIR] [NAME...]"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def canonical(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, dict):
        return str(sorted((canonical(k), canonical(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return str([canonical(x) for x in v])
    if hasattr(v, "asDict"):
        return canonical(v.asDict())
    if type(v).__name__ == "Decimal":
        return f"{float(v):.6g}"
    return str(v)


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        at = p if os.path.isfile(p) else f"{p}/*.parquet"
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{at}'")
    return con


def main(args: list[str]) -> int:
    from graphmill.session import build_session
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.01"
    if args[:1] == ["--sf"]:
        sf, args = args[1], args[2:]
    spark = build_session("local[8]")
    spark.sparkContext.setLogLevel("ERROR")
    sql, con, bad = entry.oracle_sql(), duck(sf), 0
    for name, query in entry.queries().items():
        if args and not any(name == a or (a.endswith("*") and name.startswith(a[:-1])) for a in args):
            continue
        t = time.time()
        try:
            df = query(spark, sf)
            rows = [tuple(r) for r in df.collect()]
            took = time.time() - t
            if name not in sql:
                print(f"rows  {name} {len(rows)} rows {took:.1f} s", flush=True)
                continue
            cur = con.execute(sql[name])
            cols = [d[0] for d in cur.description]
            want = cur.fetchall()
            order = sorted(range(len(cols)), key=lambda i: cols[i])
            mine = sorted(range(len(df.columns)), key=lambda i: df.columns[i])
            a = sorted(tuple(canonical(r[i]) for i in mine) for r in rows)
            b = sorted(tuple(canonical(r[i]) for i in order) for r in want)
            same = a == b and sorted(df.columns) == sorted(cols)
            bad += not same
            print(f"{'ok   ' if same else 'DIFF '} {name} {len(a)} {len(b)} rows {took:.1f} s", flush=True)
            if not same:
                print("   columns", sorted(df.columns), sorted(cols))
                left, right = sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3]
                print("   only Spark", left, "\n   only SQL", right, flush=True)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"ERROR {name} {type(e).__name__} {str(e)[:1500]}", flush=True)
    return bad


if __name__ == "__main__":
    code = main(sys.argv[1:])
    sys.stdout.flush()
    os._exit(min(code, 1))
