"""Compare named queries with their SQL in DuckDB, column by column.

Command line: python -m tests.oracle_check [sf_dir] [name part ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, (dt.datetime, dt.date)):
        return str(v)
    return v


def table_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    data = [tuple(plain(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], data


def compare(left, right) -> str:
    """Empty text when both hold the same rows in any order, else what differs first."""
    (ln, lrows), (rn, rrows) = left, right
    if ln != rn:
        return f"columns {set(ln) ^ set(rn)}"
    if len(lrows) != len(rrows):
        return f"rows {len(lrows)} vs {len(rrows)}"

    def number(v):
        return isinstance(v, (int, float))

    def key(row):
        near = tuple((v is None, number(v), 0 if v is None else round(float(v), 6) if number(v)
                      else str(v)) for v in row)
        return near, tuple(float(v) for v in row if number(v))

    a, b = sorted(lrows, key=key), sorted(rrows, key=key)
    bad = 0
    first = ""
    for x, y in zip(a, b):
        for name, p, q in zip(ln, x, y):
            if p == q:
                continue
            if isinstance(p, (int, float)) and isinstance(q, (int, float)):
                if type(p) is not type(q) and float(p) == float(q):
                    continue
            bad += 1
            first = first or f"{name}: {p!r} vs {q!r} in {dict(zip(ln, x))}"
    return f"{bad} values, first {first}" if bad else ""


KINDS = {
    "int": "int", "bigint": "int", "smallint": "int", "tinyint": "int", "integer": "int",
    "double": "float", "string": "text", "varchar": "text", "boolean": "bool", "date": "date",
}


def kinds(pairs) -> dict[str, str]:
    return {name: KINDS.get(str(kind).lower(), str(kind).lower()) for name, kind in pairs}


def check(spark, con, sf_dir, name, function, sql) -> tuple[str, int, float]:
    start = time.time()
    df = function(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if sql is None:
        return "", len(rows), took
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    left, right = kinds(df.dtypes), kinds((d[0], d[1]) for d in result.description)
    if left != right:
        odd = {n: (left.get(n), right.get(n)) for n in {*left, *right} if left.get(n) != right.get(n)}
        return f"types {odd}", len(rows), took
    return compare(table_of(df.columns, rows), table_of(names, result.fetchall())), len(rows), took


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from tidewatch.session import local_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark, con = local_session("8"), connect(sf_dir)
    oracles, failed = oracle_sql(), 0
    for name, function in queries().items():
        if args and not any(a in name for a in args):
            continue
        try:
            diff, rows, took = check(spark, con, sf_dir, name, function, oracles.get(name))
        except Exception as e:  # the run should report every query
            diff, rows, took = f"{type(e).__name__}: {str(e)[:600]}", -1, 0.0
        failed += bool(diff)
        mark = "FAIL" if diff else ("ok  " if name in oracles else "rows")
        print(f"{mark} {name:40s} rows={rows:<7d} {took:6.2f}s {diff}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
