"""Runs every query on Spark and its SQL on DuckDB over one data folder and compares them.

usage: python tests/check_oracles.py DATA_DIR [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

import __spark_entry__ as contract

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(data_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data_dir}/{t}.parquet')")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, bool) or v is None:
        return str(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, list):
        return "[" + ",".join(_cell(x) for x in v) + "]"
    return str(v)


def _kind(v):
    return {bool: "bool", int: "int", float: "float", str: "str"}.get(type(v), type(v).__name__)


def compare(spark, con, name: str, data_dir: str) -> str:
    """Empty when Spark and SQL agree, else what differs."""
    df = contract.queries()[name](spark, data_dir)
    columns = sorted(df.columns)
    rows = sorted(tuple(_cell(r[c]) for c in columns) for r in df.collect())
    sql = contract.oracle_sql().get(name)
    if sql is None:
        return f"rows only: {len(rows)}" if rows else "no rows"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    fetched = cur.fetchall()
    if sorted(names) != columns:
        return f"columns {columns} vs {sorted(names)}"
    at = [names.index(c) for c in columns]
    expected = sorted(tuple(_cell(r[i]) for i in at) for r in fetched)
    if rows == expected:
        return ""
    if len(rows) != len(expected):
        return f"{len(rows)} rows vs {len(expected)}"
    bad = [(a, b) for a, b in zip(rows, expected) if a != b]
    fields = sorted({columns[i] for a, b in bad for i in range(len(columns)) if a[i] != b[i]})
    return f"{len(bad)} of {len(rows)} rows differ in {fields}: {bad[0]}"


def main(argv):
    from credilake.session import build_session

    data_dir = argv[0]
    spark = build_session(
        master="local[8]", **{"spark_sql_shuffle_partitions": "8", "spark_ui_enabled": "false", "spark_driver_memory": "12g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(data_dir)
    failed = 0
    for name in argv[1:] or contract.queries():
        start = time.time()
        try:
            verdict = compare(spark, con, name, data_dir)
        except Exception as e:  # report every query
            verdict = f"{type(e).__name__}: {str(e)[:1500]}"
        ok = not verdict or verdict.startswith("rows only")
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {verdict}", flush=True)
    spark.stop()
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
