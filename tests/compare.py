"""Runs registered queries beside their SQL and compares columns and values.

    python -m tests.compare [--sf DIR] [name or prefix ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time

import duckdb
import pandas as pd

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def canon(v: object) -> object:
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    if isinstance(v, (int, float)) or hasattr(v, "dtype"):
        return repr(float(v))
    return str(v)


def rows(columns: list[str], data: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canon(rec[i]) for i in order) for rec in data)


def compare(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    got = spark_df.collect()
    rel = con.execute(sql)
    want_cols = [c[0] for c in rel.description]
    want = rel.fetchall()
    if sorted(want_cols) != sorted(spark_df.columns):
        return f"columns differ: {sorted(spark_df.columns)} / {sorted(want_cols)}"
    if len(got) != len(want):
        return f"row counts differ: {len(got)} / {len(want)}"
    a, b = rows(spark_df.columns, got), rows(want_cols, want)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows differ, e.g. {bad[0]}" if bad else "ok"


def main() -> int:
    from macrospark.plans.registry import CATALOGUE
    from macrospark.session import local_session

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(args.sf), 0
    for name, query in CATALOGUE.items():
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        start = time.time()
        try:
            df = query.run(spark, args.sf)
            if query.sql is None:
                state = f"rows {len(df.collect())}"
            else:
                state = compare(df, con, query.sql)
        except Exception as e:  # noqa: BLE001 - reported, not hidden
            state = f"error {type(e).__name__}: {str(e)[:600]}"
        good = state == "ok" or (state.startswith("rows ") and state != "rows 0")
        failed += not good
        print(f"{'PASS' if good else 'FAIL'} {name} {time.time() - start:.2f}s {state}", flush=True)
    print(f"failed: {failed}")
    return failed


if __name__ == "__main__":
    sys.exit(main())
