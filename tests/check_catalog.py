"""Compare registered queries with their SQL on DuckDB: python tests/check_catalog.py [sf_dir] [name ...]"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return v


def _kind(rows, i):
    kinds = {type(r[i]).__name__ for r in rows if r[i] is not None}
    return sorted(kinds)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    data = sorted((tuple(_value(r[i]) for i in order) for r in rows), key=repr)
    return [columns[i] for i in order], data, [_kind(rows, i) for i in order]


def difference(spark_df, con, sql, size: list | None = None) -> str | None:
    got = normal(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if size is not None:
        size[:] = [len(got[1]), time.time()]
    res = con.execute(sql)
    want = normal([d[0] for d in res.description], res.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}"
    if got[1] != want[1]:
        bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
        return f"{len(bad)} rows differ, first: {bad[0]}"
    if got[2] != want[2]:
        return f"types {got[2]} != {want[2]}"
    return None


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", os.environ.get("CHECK_MEMORY", "8g")).getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle_connection(sf_dir)
    failed = 0
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name, fn in queries.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        start, name_note = time.time(), name
        try:
            df = fn(spark, sf_dir)
            size: list = []
            diff = difference(df, con, oracles[name], size) if name in oracles else f"rows {df.count()} (no oracle)"
            if size:
                name_note = f"{name} [{size[0]} rows, spark {size[1] - start:.2f}s]"
        except Exception as error:  # report and go on
            diff = f"{type(error).__name__}: {str(error)[:700]}"
        bad = diff is not None and name in oracles or (diff or "").find("Error") >= 0 or (diff or "").find("Exception") >= 0
        failed += bool(bad)
        print(f"{'FAIL' if bad else 'ok  '} {name_note} {time.time() - start:.2f}s {diff or ''}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main())
