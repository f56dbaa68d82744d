"""Compare registered queries with their SQL twins: python tests/check_oracle.py SF [NAME...]."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = "region nation customer supplier part orders lineitem events".split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def _cell(value) -> str:
    if value is None or value is pd.NaT:
        return "NULL"
    if isinstance(value, float):
        return "NULL" if value != value else repr(float(value) + 0.0)
    if hasattr(value, "tolist"):
        return _cell(value.tolist())
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(_cell(v) for v in value) + "]"
    return str(value)


def normalize(rows: list[tuple], names: list[str]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, query, sf: str) -> str:
    """Empty when equal, else what differs."""
    df = query.run(spark, sf)
    got = normalize([tuple(r) for r in df.collect()], df.columns)
    if query.oracle is None:
        return ""
    cursor = con.execute(query.oracle)
    names = [c[0] for c in cursor.description]
    want = normalize(cursor.fetchall(), names)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if got == want:
        return "" if got else "both empty"
    missing = [r for r in want if r not in set(got)][:2]
    extra = [r for r in got if r not in set(want)][:2]
    return f"{len(got)} vs {len(want)} rows; only sql {missing}; only spark {extra}"


def main() -> int:
    from barloom.session import build_session
    from workload.registry import registered

    sf = sys.argv[1]
    names = sys.argv[2:]
    spark = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    failed = 0
    for name, q in registered().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            problem = compare(spark, con, q, sf)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {time.time() - start:5.1f}s {name} {problem}",
              flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
