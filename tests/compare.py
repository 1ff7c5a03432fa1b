"""Spark query results against SQL on the same files: names, rows and values."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALLEST = "/root/testdata/sf0.001"  # of the given tables


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        value = float(value)
        return None if math.isnan(value) else value + 0.0
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(row[i]) for i in order) for row in rows]
    return [names[i] for i in order], sorted(out, key=repr)


def difference(spark_names, spark_rows, sql_names, sql_rows) -> str | None:
    a_names, a = rows_of(spark_names, spark_rows)
    b_names, b = rows_of(sql_names, sql_rows)
    if a_names != b_names:
        return f"columns {a_names} != {b_names}"
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)} rows"
    odd = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(odd)} of {len(a)} rows differ, first {odd[0]}" if odd else None


def compare(spark, con, name, query, sql, sf_dir):
    t = time.time()
    df = query(spark, sf_dir)
    rows = df.collect()
    seconds = time.time() - t
    if sql is None:
        return None, len(rows), seconds
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return difference(df.columns, rows, names, cur.fetchall()), len(rows), seconds


if __name__ == "__main__":
    import __spark_entry__ as entry
    from cellgrid.session import get_spark

    sf = sys.argv[1] if len(sys.argv) > 1 else SMALLEST
    only = sys.argv[2:]
    spark = get_spark(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles = database(sf), entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if only and name not in only:
            continue
        try:
            diff, n, seconds = compare(spark, con, name, query, oracles.get(name), sf)
        except Exception as exc:  # noqa: BLE001
            diff, n, seconds = f"{type(exc).__name__}: {str(exc)[:700]}", -1, 0.0
        bad += diff is not None
        mark = "FAIL" if diff else ("ok" if name in oracles else "rows-only")
        print(f"{mark:9} {name:24} {n:7} rows {seconds:6.2f}s {diff or ''}"[:900], flush=True)
    print("failures:", bad)
