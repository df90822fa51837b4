"""Compare registered queries with their SQL: rows, columns, types and values."""

from __future__ import annotations

import glob
import math
import os
import sys
import threading
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
DATA = os.environ.get("LINEAMIX_TESTDATA", "/root/testdata")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from '{path}'")
    return con


def _sortable(row):
    return tuple((v is not None, str(type(v)), v if v is not None else 0) for v in row)


def _clean(value):
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    return value


def normalised(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_clean(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=_sortable)


KINDS = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "date": "DATE",
    "boolean": "BOOLEAN",
}


def differences(frame, con, statement) -> list[str]:
    problems = []
    left_cols, left = normalised(frame.columns, [tuple(r) for r in frame.collect()])
    watch = threading.Timer(120, con.interrupt)
    watch.start()
    try:
        cursor = con.execute(statement)
    finally:
        watch.cancel()
    names = [c[0] for c in cursor.description]
    types = {c[0]: str(c[1]) for c in cursor.description}
    right_cols, right = normalised(names, cursor.fetchall())
    if left_cols != right_cols:
        return [f"columns {left_cols} / {right_cols}"]
    for name, kind in frame.dtypes:
        if KINDS.get(kind) != types[name]:
            problems.append(f"type of {name}: {kind} / {types[name]}")
    if len(left) != len(right):
        problems.append(f"rows {len(left)} / {len(right)}")
    if left != right:
        pairs = [(a, b) for a, b in zip(left, right) if a != b]
        problems.append(f"{len(pairs)} rows differ, first {pairs[:1]}")
    if not left:
        problems.append("no rows")
    return problems


if __name__ == "__main__":
    from lineamix.session import local_session

    from __spark_entry__ import oracle_sql, queries

    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    wanted = sys.argv[2:]
    spark = local_session("8")
    con = connect(f"{DATA}/{sf}")
    oracle, failed = oracle_sql(), 0
    for key, run in queries().items():
        if wanted and key not in wanted:
            continue
        begin = time.time()
        try:
            frame = run(spark, f"{DATA}/{sf}")
            frame.cache()
            n = frame.count()
            took = time.time() - begin
            problems = differences(frame, con, oracle[key]) if key in oracle else ["no SQL"]
            frame.unpersist()
        except Exception as error:  # noqa: BLE001
            took, n, problems = time.time() - begin, -1, [str(error)[:1500]]
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {key:28s} {n:8d} rows {took:6.2f}s", *problems, flush=True)
    print("failed:", failed)
