"""Run registered queries next to their SQL, as the correctness check does."""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, float):
        return 0.0 if value == 0 else value
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def spark_rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def sql_rows(con, sql):
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    return rows_of(names, cursor.fetchall())


def main(sf_dir: str, only: list[str]) -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    sqls = entry.oracle_sql()
    for name, run in entry.queries().items():
        if only and name not in only:
            continue
        try:
            t0 = time.time()
            got = spark_rows(run(spark, sf_dir))
            t1 = time.time()
            want = sql_rows(con, sqls[name]) if name in sqls else None
            t2 = time.time()
        except Exception:
            bad += 1
            print(f"ERROR {name}")
            traceback.print_exc(limit=4)
            continue
        same = want is None or got == want
        bad += not same
        print(f"{'ok  ' if same else 'DIFF'} {name}: rows {len(got[1])} spark {t1 - t0:.2f}s sql {t2 - t1:.2f}s", flush=True)
        if not same:
            print("  columns", got[0], want[0], "rows", len(got[1]), len(want[1]))
            for a, b in [(a, b) for a, b in zip(got[1], want[1], strict=False) if a != b][:3]:
                print("   spark", str(a)[:600])
                print("   sql  ", str(b)[:600])
    return bad


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1], sys.argv[2:]))
