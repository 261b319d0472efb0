"""Compare queries with their DuckDB statements on one data folder.

``python tests/oracle.py [folder] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def session() -> SparkSession:
    from plumbline.session import configure

    spark = (
        configure(SparkSession.builder.master("local[8]").appName("plumbline-checks"))
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _rows(columns: list[str], rows: list) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(r[i] for i in order) for r in rows), key=lambda r: tuple((v is None, str(type(v)), v) for v in r)
    )


def compare(spark: SparkSession, con, name: str, fn, sql: str | None, folder: str) -> str:
    """Empty when equal, else what differs."""
    df = fn(spark, folder)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return "" if got[1] else "no rows"
    result = con.execute(sql)
    want = _rows([c[0] for c in result.description], result.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        extra = next((r for r in got[1] if r not in set(want[1])), None) if len(got[1]) < 50000 else None
        return f"rows {len(got[1])} != {len(want[1])}; only in Spark: {extra}"
    if not got[1]:
        return "no rows on either side"
    for a, b in zip(got[1], want[1]):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{a} != {b}"
    return ""


def main() -> None:
    import __spark_entry__ as entry

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = sys.argv[2:] or list(entry.queries())
    spark, con = session(), connect(folder)
    sql = entry.oracle_sql()
    bad = 0
    for name in names:
        began = time.time()
        try:
            diff = compare(spark, con, name, entry.queries()[name], sql.get(name), folder)
        except Exception as exc:  # noqa: BLE001 - the report goes on with the next query
            diff = "ERROR " + str(exc)[:600]
        bad += bool(diff)
        print(f"{'ok  ' if not diff else 'FAIL'} {name} {time.time() - began:.1f}s {diff}", flush=True)
    print(f"{len(names) - bad} of {len(names)} equal")


if __name__ == "__main__":
    main()
