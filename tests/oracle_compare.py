"""Compare registered Spark queries with their DuckDB oracle.

Usage: python tests/oracle_compare.py [sf_dir] [name ...]
Prints one line per query: rows, columns and an order-insensitive value hash.
"""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import math
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(HERE))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


STRICT = os.environ.get("ORACLE_STRICT") == "1"


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v) if STRICT else repr(round(v, 9))
    if isinstance(v, decimal.Decimal):
        return str(v.normalize()) if v == v else "nan"
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, bool):
        return int(v)
    return v


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    hashes = sorted(hashlib.md5(repr(tuple(norm(r[i]) for i in order)).encode()).hexdigest() for r in rows)
    return hashlib.md5("".join(hashes).encode()).hexdigest()


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def run(sf_dir, names=None, spark=None):
    import __spark_entry__ as E
    from cohortlab.session import build_session
    spark = spark or build_session("local[8]", shuffle_partitions=8, conf={"spark.driver.memory": "8g"})
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    results = {}
    for name in (names or sorted(qs)):
        t0 = time.time()
        try:
            sdf = qs[name](spark, sf_dir)
            srows = [tuple(r) for r in sdf.collect()]
            scols = sdf.columns
        except Exception as e:  # report and go on
            results[name] = ("spark-error", str(e).splitlines()[0][:300])
            print(f"{name:40s} SPARK ERROR {str(e).splitlines()[0][:300]}", flush=True)
            continue
        ts = time.time() - t0
        if name not in sqls:
            results[name] = ("rows-only", len(srows))
            print(f"{name:40s} rows-only rows={len(srows)} {ts:.1f}s", flush=True)
            continue
        try:
            cur = con.execute(sqls[name])
            dcols = [d[0] for d in cur.description]
            drows = cur.fetchall()
        except Exception as e:
            results[name] = ("oracle-error", str(e)[:300])
            print(f"{name:40s} ORACLE ERROR {str(e)[:300]}", flush=True)
            continue
        ok_cols = sorted(scols) == sorted(dcols)
        ok_rows = len(srows) == len(drows)
        ok_hash = ok_cols and digest(scols, srows) == digest(dcols, drows)
        status = "OK" if (ok_cols and ok_rows and ok_hash) else "MISMATCH"
        results[name] = (status, len(srows), len(drows))
        print(f"{name:40s} {status} rows={len(srows)}/{len(drows)} cols={'ok' if ok_cols else (scols, dcols)} "
              f"hash={'ok' if ok_hash else 'DIFF'} {ts:.1f}s", flush=True)
    return results


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    run(sf, sys.argv[2:] or None)
