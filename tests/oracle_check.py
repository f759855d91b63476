"""Run every registered query on Spark and its statement on the oracle, and compare the rows.

    python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from offerlens.plans import derived, registry  # noqa: E402
from offerlens.session import local_session  # noqa: E402


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, decimal.Decimal):
        return float(f"{float(value):.9g}")
    if isinstance(value, (dt.datetime, dt.date)):
        return str(value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in rows], key=repr)


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in derived.BASE:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def compare(spark, con, sf_dir, name):
    started = time.time()
    df = registry.queries()[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    spent = time.time() - started
    sql = registry.oracle_sql().get(name)
    if sql is None:
        return "rows-only", len(got), spent, ""
    cursor = con.execute(sql)
    columns = [c[0] for c in cursor.description]
    want = rows_of(columns, cursor.fetchall())
    have = rows_of(df.columns, got)
    if sorted(columns) != sorted(df.columns):
        return "COLUMNS", len(got), spent, f"{sorted(df.columns)} / {sorted(columns)}"
    if have != want:
        only = [r for r in have if r not in set(want)][:2], [r for r in want if r not in set(have)][:2]
        return "DIFFERS", len(got), spent, f"{len(have)} / {len(want)} rows {only}"
    return "ok", len(got), spent, ""


def main(argv):
    sf_dir = argv[0] if argv and "/" in argv[0] else "/root/testdata/sf0.01"
    names = [a for a in argv if "/" not in a] or list(registry.queries())
    spark, con, bad = local_session(), connect(sf_dir), 0
    for name in names:
        try:
            status, rows, spent, note = compare(spark, con, sf_dir, name)
        except Exception as error:  # noqa: BLE001
            status, rows, spent, note = "ERROR", 0, 0.0, str(error).replace("\n", " ")[:420]
        bad += status not in ("ok", "rows-only")
        print(f"{status:10} {name:35} {rows:7} rows {spent:6.2f}s {note}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
