"""Run queries and their SQL checks on the same tables and compare the results."""

from __future__ import annotations

import datetime
import glob
import os
import sys
import time
from collections import Counter

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(value):
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def spark_rows(df) -> Counter:
    names = sorted(df.columns)
    return Counter(tuple(plain(r[n]) for n in names) for r in df.collect())


def check_rows(con, sql: str) -> tuple[list[str], Counter]:
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = cursor.fetchall()
    return sorted(names), Counter(tuple(plain(r[i]) for i in order) for r in rows)


def main() -> None:
    from lakekeep.plans.catalog import CHECKS, QUERIES
    from lakekeep.session import build_session

    sf = os.environ.get("CHECK_SF", "/root/testdata/sf0.01")
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    for name in sys.argv[1:] or QUERIES:
        begin = time.time()
        try:
            df = QUERIES[name](spark, sf)
            got = spark_rows(df)
        except Exception as e:  # report and go on
            print(f"{name:26} ERROR {str(e)[:600]}")
            continue
        took = time.time() - begin
        if name not in CHECKS:
            print(f"{name:26} rows {sum(got.values()):8} {took:6.2f}s  (no check)")
            continue
        try:
            columns, want = check_rows(con, CHECKS[name])
        except Exception as e:
            print(f"{name:26} SQL ERROR {str(e)[:400]}")
            continue
        ok = columns == sorted(df.columns) and got == want
        print(f"{name:26} {'ok' if ok else 'DIFFERS':8} {sum(got.values()):8} {sum(want.values()):8} {took:6.2f}s")
        if not ok:
            print("   columns", sorted(df.columns), columns)
            print("   spark only", list((got - want).items())[:3])
            print("   check only", list((want - got).items())[:3])


if __name__ == "__main__":
    main()
