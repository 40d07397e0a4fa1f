"""Spark-vs-DuckDB comparison used by the tests (and runnable by hand):

    python -m tests.oracle [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v if os.environ.get("ORACLE_EXACT") else round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def canon(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)
    rows = [tuple(_norm(v) for v in r) for r in pdf[cols].itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), x) if x is not None else (True, "", 0) for x in r))


def compare(spark, con, name: str, build, sql: str, sf_dir: str) -> tuple[bool, str]:
    t0 = time.time()
    sdf = build(spark, sf_dir)
    s_pdf = sdf.toPandas()
    t1 = time.time()
    d_pdf = con.execute(sql).fetchdf()
    if sorted(s_pdf.columns) != sorted(d_pdf.columns):
        return False, f"columns differ: spark={sorted(s_pdf.columns)} duck={sorted(d_pdf.columns)}"
    if len(s_pdf) != len(d_pdf):
        return False, f"row count spark={len(s_pdf)} duck={len(d_pdf)}"
    a, b = canon(s_pdf), canon(d_pdf)
    if a != b:
        for x, y in zip(a, b):
            if x != y:
                return False, f"first diff (cols {sorted(s_pdf.columns)}):\n spark={x}\n duck ={y}"
    return True, f"ok rows={len(a)} spark={t1 - t0:.2f}s"


def main(argv):
    sys.path.insert(0, ".")
    import __spark_entry__ as E
    from tabforge.session import build_session

    sf_dir = argv[0] if argv and argv[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv if not a.startswith("/")]
    spark = build_session("local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory=os.environ.get("ORACLE_DRIVER_MEMORY", "8g"))
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for n in names or list(qs):
        if n not in sqls:
            t0 = time.time()
            try:
                rows = qs[n](spark, sf_dir).count()
                print(f"[rows-only] {n}: rows={rows} {time.time() - t0:.1f}s")
            except Exception as e:  # noqa: BLE001
                bad += 1
                print(f"[FAIL] {n}: {type(e).__name__}: {str(e)[:500]}")
            continue
        try:
            ok, msg = compare(spark, con, n, qs[n], sqls[n], sf_dir)
        except Exception as e:  # noqa: BLE001
            ok, msg = False, f"{type(e).__name__}: {str(e)[:800]}"
        bad += not ok
        print(f"[{'ok' if ok else 'FAIL'}] {n}: {msg}")
    print(f"failures: {bad}")


if __name__ == "__main__":
    main(sys.argv[1:])
