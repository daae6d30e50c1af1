"""Run Spark queries next to their DuckDB oracles (as the external check does)."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 9))
    if hasattr(v, "item"):
        return _norm(v.item())
    return repr(v)


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, name, fn, sql, sf_dir, con=None):
    con = con or duck(sf_dir)
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    rel = con.sql(sql)
    d_rows = rel.fetchall()
    d_cols = rel.columns
    sc, sv = canon(sdf.columns, s_rows)
    dc, dv = canon(d_cols, d_rows)
    ok = sc == dc and sv == dv
    detail = ""
    if not ok:
        if sc != dc:
            detail = f"cols spark={sc} duck={dc}"
        elif len(sv) != len(dv):
            detail = f"rows spark={len(sv)} duck={len(dv)}"
        else:
            diff = [(a, b) for a, b in zip(sv, dv) if a != b]
            detail = f"{len(diff)} differing rows, e.g. {diff[:2]}"
    return ok, len(s_rows), t1 - t0, detail


if __name__ == "__main__":
    sys.path.insert(0, ".")
    import __spark_entry__ as E
    from labelpool.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = set(sys.argv[2:])
    spark = local_session(8)
    con = duck(sf)
    sqls = E.oracle_sql()
    for name, fn in E.queries().items():
        if only and name not in only:
            continue
        if name not in sqls:
            t0 = time.time()
            n = fn(spark, sf).count()
            print(f"ROWS {name}: {n} rows {time.time() - t0:.1f}s", flush=True)
            continue
        try:
            ok, n, sec, detail = compare(spark, name, fn, sqls[name], sf, con)
            print(f"{'OK  ' if ok else 'FAIL'} {name}: {n} rows {sec:.1f}s {detail}", flush=True)
        except Exception as e:  # noqa: BLE001
            print(f"ERR  {name}: {type(e).__name__}: {str(e)[:400]}", flush=True)
