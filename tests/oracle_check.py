"""Run registered queries and their SQL side by side: ``python tests/oracle_check.py SF_DIR [names...]``."""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from decimal import Decimal

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return repr(value)
    return str(value)


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def spark_rows(df):
    return df.columns, [tuple(r) for r in df.collect()]


def duck_rows(con, sql):
    cursor = con.execute(sql)
    return [d[0] for d in cursor.description], cursor.fetchall()


def compare(df, con, sql):
    """None when equal, else a short description of the first difference."""
    left = table_of(*spark_rows(df))
    right = table_of(*duck_rows(con, sql))
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}"
    if len(left[1]) != len(right[1]):
        return f"rows {len(left[1])} != {len(right[1])}"
    if not left[1]:
        return "no rows"
    bad = [(a, b) for a, b in zip(left[1], right[1]) if a != b]
    return f"{len(bad)} rows differ: {left[0]} {bad[:2]}" if bad else None


def main():
    import __spark_entry__ as entry
    from fieldframe.session import get_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = get_session("oracle", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    if names and names[0].startswith("@"):
        import importlib
        module = importlib.import_module(f"fieldframe.plans.{names[0][1:]}")
        names = [n for n, f in queries.items() if f.__module__ == module.__name__]
    failed = 0
    for name in names or queries:
        started = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracles:
                problem = compare(df, con, oracles[name])
            else:
                rows = df.collect()
                problem = None if rows else "no rows"
                print("   ", name, len(rows), "rows, e.g.", rows[:1])
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        failed += problem is not None
        print("FAIL" if problem else "ok  ", name, f"{time.time() - started:.1f}s", problem or "", flush=True)
    print("failed", failed)


if __name__ == "__main__":
    main()
