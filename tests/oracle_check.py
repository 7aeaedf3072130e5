"""Run every registered query in Spark and its oracle SQL in DuckDB; compare results.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    return v


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(repr(_norm(r[i])) for i in order) for r in rows))


def compare(spark, sf_dir: str, names=None, verbose=True):
    import __spark_entry__ as e
    qs, sqls = e.queries(), e.oracle_sql()
    con = duck(sf_dir)
    results = {}
    for name in (names or qs):
        t0 = time.time()
        try:
            sdf = qs[name](spark, sf_dir)
            srows = [tuple(r) for r in sdf.collect()]
            scols = sdf.columns
        except Exception as exc:  # report and go on with the next query
            print(f"{name:28s} SPARK ERROR {str(exc).splitlines()[0][:300]}", flush=True)
            results[name] = ("error", 0, 0)
            continue
        t1 = time.time()
        if name not in sqls:
            results[name] = ("rows-only", len(srows), None)
            continue
        try:
            rel = con.execute(sqls[name])
        except Exception as exc:
            print(f"{name:28s} DUCKDB ERROR {str(exc).splitlines()[0][:300]}", flush=True)
            results[name] = ("error", len(srows), 0)
            continue
        dcols = [d[0] for d in rel.description]
        drows = rel.fetchall()
        ok_schema = sorted(scols) == sorted(dcols)
        ok_rows = len(srows) == len(drows)
        ok_vals = ok_schema and canon(scols, srows) == canon(dcols, drows)
        results[name] = (ok_schema and ok_rows and ok_vals, len(srows), len(drows))
        if verbose:
            print(f"{name:28s} spark={len(srows):6d} duck={len(drows):6d} schema={ok_schema} values={ok_vals} "
                  f"({t1 - t0:.2f}s)", flush=True)
            if not ok_vals and ok_schema:
                a, b = canon(scols, srows), canon(dcols, drows)
                diff_a = [x for x in a if x not in set(b)][:3]
                diff_b = [x for x in b if x not in set(a)][:3]
                print("   spark-only:", diff_a, "\n   duck-only: ", diff_b)
            if not ok_schema:
                print("   cols:", scols, dcols)
    return results


if __name__ == "__main__":
    from spendlens.session import get_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = get_session()
    res = compare(spark, sf, names)
    bad = [k for k, v in res.items() if v[0] is not True]
    print("FAILED:", bad if bad else "none", f"({len(res) - len(bad)}/{len(res)} ok)")
