"""Compare registered queries with their SQL: row count, columns, and sorted values.

Usage: python -m tools.check_queries [-d FOLDER] [name or prefix ...]
"""

from __future__ import annotations

import argparse
import sys
import time

import duckdb
import pandas as pd

from probcast.catalog import load
from probcast.session import build_session
from probcast.sources.testtables import RAW_TABLES


def normal(value):
    if value is None or value is pd.NaT:
        return None
    if isinstance(value, float):
        return None if value != value else round(value, 6)
    if hasattr(value, "isoformat"):
        text = value.isoformat()
        return text[:10] if text.endswith("T00:00:00") else text
    return value


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in data), key=repr)


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("-d", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = build_session("check", "local[8]", spark_sql_shuffle_partitions="8",
                          spark_ui_enabled="false", spark_driver_memory="12g",
                          spark_ui_showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name, query in load().items():
        if args.names and not any(name.startswith(x) or x in name for x in args.names):
            continue
        con = duckdb.connect()
        for t in RAW_TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{args.d}/{t}.parquet'")
        start = time.time()
        try:
            df = query.run(spark, args.d)
            got = [tuple(r) for r in df.collect()]
        except Exception as error:
            print(f"FAIL {name}: SPARK {repr(error)[:1500]}", flush=True)
            bad += 1
            continue
        took = time.time() - start
        if query.sql is None:
            print(f"rows {name}: {len(got)} rows, {took:.1f}s", flush=True)
            continue
        start = time.time()
        try:
            cursor = con.execute(query.sql)
            names = [c[0] for c in cursor.description]
            want = cursor.fetchall()
        except Exception as error:
            print(f"FAIL {name}: SQL {str(error)[:1200]}", flush=True)
            bad += 1
            continue
        sql_took = time.time() - start
        if sorted(names) != sorted(df.columns):
            print(f"FAIL {name}: columns {sorted(df.columns)} vs {sorted(names)}", flush=True)
            bad += 1
            continue
        a, b = rows_of(df.columns, got), rows_of(names, want)
        if a == b:
            print(f"ok   {name}: {len(a)} rows, spark {took:.1f}s, sql {sql_took:.1f}s", flush=True)
        else:
            bad += 1
            left, right = set(map(repr, a)), set(map(repr, b))
            print(f"FAIL {name}: {len(a)} vs {len(b)} rows", flush=True)
            print("   only spark:", sorted(left - right)[:3])
            print("   only sql:  ", sorted(right - left)[:3], flush=True)
    print(f"{bad} failures")
    return bad


if __name__ == "__main__":
    sys.exit(main())
