"""Compares registered queries with their DuckDB statements: rows, column types and values.

    python tests/check_oracles.py [scale] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry  # noqa: E402

from pagesift.session import build_session  # noqa: E402

TABLES = ["documents", "labels", "pages", "benchmark", "embeddings"]
SAME_TYPE = {
    "int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE",
    "boolean": "BOOLEAN",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS FROM '{folder}/{name}.parquet'")
    return connection


def _key(row: tuple) -> tuple:
    return tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in row)


def compare(spark, connection, folder: str, name: str) -> str:
    """'' when both agree, else what differs."""
    start = time.perf_counter()
    frame = entry.queries()[name](spark, folder)
    columns = sorted(frame.columns)
    ours = Counter(_key(tuple(r)) for r in frame.select(*columns).collect())
    print(f"  spark {time.perf_counter() - start:.1f}s", end=" ", flush=True)
    types = {f.name: f.dataType.simpleString() for f in frame.schema}
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return "" if sum(ours.values()) else "no rows"
    result = connection.sql(sql)
    if sorted(result.columns) != columns:
        return f"columns {columns} / {sorted(result.columns)}"
    for column, kind in zip(result.columns, result.types):
        if SAME_TYPE.get(types[column]) != str(kind):
            return f"type of {column}: {types[column]} / {kind}"
    theirs = Counter(
        _key(r) for r in result.select(*[f'"{c}"' for c in columns]).fetchall()
    )
    if ours != theirs:
        return (
            f"rows {sum(ours.values())} / {sum(theirs.values())}; only ours "
            f"{list((ours - theirs).items())[:2]}; only theirs {list((theirs - ours).items())[:2]}"
        )[:900]
    return ""


def main(scale: str, names: list[str]) -> int:
    folder = f"/root/testdata/sf{scale}"
    spark = build_session(
        master="local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    failed = 0
    for name in names or list(entry.queries()):
        start = time.perf_counter()
        try:
            difference = compare(spark, connection, folder, name)
        except Exception as error:  # noqa: BLE001
            difference = f"{type(error).__name__}: {str(error)[:700]}"
        failed += bool(difference)
        kind = "sql" if name in entry.oracle_sql() else "rows"
        seconds = time.perf_counter() - start
        print(f"{'FAIL' if difference else 'ok'} {kind} {name} {seconds:.1f}s {difference}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1] if len(sys.argv) > 1 else "0.01", sys.argv[2:]) else 0)
