"""Compare named queries with their SQL on the driver tables.

python tests/check.py [sf] [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from decimal import Decimal

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def _value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.12g}")
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, Decimal)):
        return float(v)
    return str(v)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    flat = [tuple(_value(row[i]) for i in order) for row in rows]
    return sorted(columns), sorted(flat, key=lambda r: [(v is None, str(type(v)), v) if v is not None else (True, "", 0) for v in r])


def expected(folder: str, sql: str):
    with duckdb.connect() as db:
        for table in TABLES:
            db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
        result = db.execute(sql)
        return normal([d[0] for d in result.description], result.fetchall())


def compare(spark, folder: str, build, sql: str | None) -> str:
    df = build(spark, folder)
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return f"rows only: {len(got[1])}"
    want = expected(folder, sql)
    if got[0] != want[0]:
        return f"DIFF columns {got[0]} / {want[0]}"
    if got[1] != want[1]:
        extra = [r for r in got[1] if r not in set(want[1])][:3]
        missing = [r for r in want[1] if r not in set(got[1])][:3]
        return f"DIFF {len(got[1])} / {len(want[1])} rows\n   got  {extra}\n   want {missing}"
    return f"ok {len(got[1])}"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from webloom.session import build_session

    scale, names = sys.argv[1] if len(sys.argv) > 1 else "0.01", sys.argv[2:]
    session = build_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
    })
    session.sparkContext.setLogLevel("ERROR")
    checks = entry.oracle_sql()
    for name, build in entry.queries().items():
        if names and name not in names:
            continue
        begin = time.time()
        try:
            outcome = compare(session, f"/root/testdata/sf{scale}", build, checks.get(name))
        except Exception as error:  # report and go on
            outcome = f"FAIL {type(error).__name__}: {str(error)[:900]}"
        print(f"{name:26s} {time.time() - begin:6.2f}s {outcome}", flush=True)
