"""Compare a registered query with its SQL twin on DuckDB."""

from __future__ import annotations

import math
import os
import sys
import time
from decimal import Decimal

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(_cell(v) for v in value)
    if hasattr(value, "tzinfo"):
        return value.replace(tzinfo=None)
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr), sorted(names)


def compare(spark, con, folder, query, sql):
    """(rows, problem or None, seconds)."""
    start = time.time()
    df = query(spark, folder)
    got, got_names = _rows(df.columns, [tuple(r) for r in df.collect()])
    seconds = time.time() - start
    if sql is None:
        return len(got), None, seconds
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want, want_names = _rows(names, cursor.fetchall())
    if got_names != want_names:
        return len(got), f"columns {got_names} != {want_names}", seconds
    if got == want:
        return len(got), None, seconds
    missing = [r for r in want if r not in set(got)][:2] if len(want) < 200_000 else []
    extra = [r for r in got if r not in set(want)][:2] if len(got) < 200_000 else []
    return len(got), f"rows {len(got)} vs {len(want)}; only sql {missing}; only spark {extra}", seconds


def main():
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, sql = entry.queries(), entry.oracle_sql()
    wanted = sys.argv[1:]
    bad = 0
    for name, query in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            rows, problem, seconds = compare(spark, con, folder, query, sql.get(name))
        except Exception as error:  # report and go on with the next query
            rows, problem, seconds = -1, f"{type(error).__name__}: {str(error)[:900]}", 0.0
        bad += problem is not None
        state = "ok  " if problem is None else "FAIL"
        print(f"{state} {name:34s} rows={rows:<8d} {seconds:6.2f}s {'' if name in sql else '(no sql)'} {problem or ''}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
