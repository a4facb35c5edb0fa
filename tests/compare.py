"""Run registered queries next to their reference SQL.

    python tests/compare.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from decimal import Decimal

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def oracle_connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from '{path}'")
    return con


def normal(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float, Decimal)):
        return round(float(value), 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    return str(value)


def sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(normal(r[i]) for i in order) for r in rows], key=lambda r: [(v is None, str(type(v)), str(v)) for v in r])


def compare(name, spark_query, sql, spark, sf_dir, con) -> tuple[bool, str]:
    start = time.time()
    df = spark_query(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if sql is None:
        return True, f"rows={len(rows)} (no SQL) {took:.1f}s"
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    wanted = cursor.fetchall()
    if sorted(names) != sorted(df.columns):
        return False, f"columns differ: only spark {sorted(set(df.columns) - set(names))}, only sql {sorted(set(names) - set(df.columns))}"
    left, right = sorted_rows(df.columns, rows), sorted_rows(names, wanted)
    if left == right:
        return True, f"rows={len(rows)} {took:.1f}s" + ("  EMPTY" if not rows else "")
    different = [(a, b) for a, b in zip(left, right) if a != b]
    return False, f"rows {len(left)} vs {len(right)}, {len(different)} differ; {sorted(names)} first: {different[:1]}"


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle_connection(sf_dir)
    oracles, bad = entry.oracle_sql(), []
    for name, q in sorted(entry.queries().items()):
        if prefixes and not name.startswith(prefixes):
            continue
        try:
            ok, note = compare(name, q, oracles.get(name), spark, sf_dir, con)
        except Exception as exc:  # noqa: BLE001
            ok, note = False, f"{type(exc).__name__}: {str(exc)[:600]}"
        print("ok  " if ok else "FAIL", name, note, flush=True)
        if not ok:
            bad.append(name)
    print("failed:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
