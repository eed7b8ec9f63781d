"""Run queries on Spark and their oracle SQL on DuckDB and compare the rows.

``python -m tests.compare [--sf 0.01] [names…]`` prints one line per query.
"""

from __future__ import annotations

import datetime
import math
import sys
import time

import duckdb

from panelspark.plans.fixtures import DRIVER_TABLES


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def differences(spark_cols, spark_rows, duck_cols, duck_rows) -> str:
    a_names, a = rows_of(spark_cols, spark_rows)
    b_names, b = rows_of(duck_cols, duck_rows)
    if a_names != b_names:
        return f"columns {a_names} vs {b_names}"
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return "" if not bad else f"{len(bad)} of {len(a)} rows differ, first {bad[0]}"


def compare(spark, con, name, fn, sql, sf_dir) -> tuple[str, int, float, float]:
    start = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    spark_s = time.time() - start
    if sql is None:
        return "", len(got), spark_s, 0.0
    start = time.time()
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    return differences(df.columns, got, cols, want), len(got), spark_s, time.time() - start


def main(argv):
    import __spark_entry__ as entry
    from panelspark.session import local_session

    sf = "0.01"
    if argv[:1] == ["--sf"]:
        sf, argv = argv[1], argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session()
    con = duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not argv or any(n.startswith(a) for a in argv)]
    failed = 0
    for name in names:
        try:
            diff, n, a, b = compare(spark, con, name, queries[name], oracles.get(name), sf_dir)
        except Exception as exc:  # noqa: BLE001
            diff, n, a, b = f"{type(exc).__name__}: {str(exc)[:1500]}", 0, 0.0, 0.0
        failed += bool(diff)
        mark = "FAIL" if diff else ("ok" if name in oracles else "rows-only")
        print(f"{mark:9s} {name:45s} rows={n:<7d} spark={a:5.1f}s duck={b:5.1f}s {diff}", flush=True)
    print(f"{len(names)} queries, {failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
