"""Compare every query with its SQL statement on the same tables.

Also runs alone: ``python tests/oracle_check.py [sf_dir] [name ...]``.
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _kind(value):
    """Value with its type class, so that 1 and 1.0 or a date and a timestamp differ."""
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, int):
        return ("int", value)
    if isinstance(value, float):
        return ("float", "nan" if math.isnan(value) else value + 0.0)
    if isinstance(value, Decimal):
        return ("decimal", value)
    if isinstance(value, datetime):
        return ("ts", value.replace(tzinfo=None))
    if isinstance(value, date):
        return ("date", value)
    return value


def _bag(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_kind(r[i]) for i in order) for r in rows)


def compare(spark, con, query, sql: str, sf_dir: str) -> str | None:
    """None when columns and rows agree, else what differs."""
    got = query(spark, sf_dir)
    want = con.sql(sql)
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} <> {sorted(want.columns)}"
    a, b = _bag(got.columns, got.collect()), _bag(want.columns, want.fetchall())
    if a == b:
        return None
    left, right = list((a - b).items())[:2], list((b - a).items())[:2]
    return f"rows {sum(a.values())} <> {sum(b.values())}\n   spark {left}\n   sql   {right}"


def main() -> int:
    import __spark_entry__ as entry
    from kerbline.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark = build_session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, sqls = connect(sf_dir), entry.queries(), entry.oracle_sql()
    failed = 0
    for name in names:
        start = time.time()
        try:
            if name in sqls:
                problem = compare(spark, con, queries[name], sqls[name], sf_dir)
            else:
                problem = None if queries[name](spark, sf_dir).count() else "no rows"
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        failed += problem is not None
        kind = "sql " if name in sqls else "rows"
        print(f"{'ok  ' if problem is None else 'FAIL'} {kind} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{len(names)} queries, {failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
