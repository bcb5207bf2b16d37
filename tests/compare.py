"""Runs registered queries against their oracle: ``python -m tests.compare [sf] [key ...]``."""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return "∅" if value is None else str(value)


def normalized(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def oracle_rows(con, sql: str):
    cursor = con.execute(sql)
    return normalized([d[0] for d in cursor.description], cursor.fetchall())


def spark_rows(df):
    return normalized(df.columns, [tuple(r) for r in df.collect()])


def main(argv: list[str]) -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = argv[0] if argv else "0.001"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", os.environ.get("COMPARE_PARTITIONS", "8"))
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(f"/root/testdata/sf{sf}")
    bad = 0
    oracles, queries = entry.oracle_sql(), entry.queries()
    for key in argv[1:] or queries:
        try:
            t0 = time.time()
            columns, rows = spark_rows(queries[key](spark, f"/root/testdata/sf{sf}"))
            t1 = time.time()
            if key not in oracles:
                print(f"rows  {key}: {len(rows)} rows {t1 - t0:.2f}s")
                continue
            want_columns, want = oracle_rows(con, oracles[key])
            t2 = time.time()
        except Exception as error:
            bad += 1
            print(f"ERROR {key}: {str(error)[:600]}")
            continue
        if columns == want_columns and rows == want:
            print(f"ok    {key}: {len(rows)} rows, spark {t1 - t0:.2f}s, duckdb {t2 - t1:.2f}s")
            continue
        bad += 1
        print(f"DIFF  {key}: {len(rows)} vs {len(want)} rows")
        if columns != want_columns:
            print("   columns", set(columns) ^ set(want_columns))
        else:
            left, right = sorted(set(rows) - set(want))[:2], sorted(set(want) - set(rows))[:2]
            print("   spark ", left)
            print("   duckdb", right)
    print("unknown oracle keys:", sorted(set(oracles) - set(queries)))
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
