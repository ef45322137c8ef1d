"""Runs registered queries next to their SQL twins: python tests/compare.py [--sf 0.01] [names...]"""

from __future__ import annotations

import math
import os
import sys
import time
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
DATA = os.environ.get("TESTDATA", "/root/testdata")


def plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, int):
        return f"{float(value):.9g}" if abs(value) < 1e8 else str(value)
    if isinstance(value, dict):
        return str(sorted((plain(k), plain(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    return str(value)


def duck(sf: str):
    connection = duckdb.connect()
    for path in Path(f"{DATA}/sf{sf}").glob("*.parquet"):
        connection.execute(f"create view {path.stem} as select * from '{path}'")
    return connection


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, connection, sf: str, build, sql: str | None):
    """(problem or None, rows)"""
    df = build(spark, f"{DATA}/sf{sf}")
    found = df.collect()
    if len({c.lower() for c in df.columns}) < len(df.columns):
        return "duplicate columns", len(found)
    if sql is None:
        return None, len(found)
    result = connection.execute(sql)
    columns = [d[0] for d in result.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(columns)}", len(found)
    ours, theirs = rows_of(df.columns, found), rows_of(columns, result.fetchall())
    if ours != theirs:
        a, b = set(ours) - set(theirs), set(theirs) - set(ours)
        return f"{len(ours)} vs {len(theirs)} rows; only ours {sorted(a)[:2]}; only theirs {sorted(b)[:2]}", len(found)
    return None, len(found)


if __name__ == "__main__":
    from maskline.session import local_session

    import __spark_entry__ as entry

    args = sys.argv[1:]
    sf = "0.01"
    if "--sf" in args:
        at = args.index("--sf")
        sf = args[at + 1]
        del args[at : at + 2]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    connection = duck(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    chosen = [n for n in queries if not args or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in args)]
    bad = 0
    for name in chosen:
        started = time.time()
        try:
            problem, n = compare(spark, connection, sf, queries[name], oracles.get(name))
        except Exception as error:  # noqa: BLE001
            problem, n = f"{type(error).__name__}: {str(error)[:900]}", -1
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name:28s} {n:7d} rows {time.time() - started:6.2f}s "
              f"{'' if name in oracles else '(no SQL)'} {problem or ''}", flush=True)
    print(f"{len(chosen)} queries, {bad} bad")
