"""Run every registered query and its SQL on one folder and compare rows and columns.

    python -m verification.compare [folder] [query ...]
"""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

from taquilla.session import build_session
from verification.oracle_sql import oracle_sql
from verification.registry import queries


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, float, Decimal)):
        number = float(value)
        return "nan" if math.isnan(number) else float(f"{number:.12g}")
    if isinstance(value, (dt.date, dt.datetime)):
        return str(value)
    return value


def spark_rows(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(plain(r[n]) for n in names) for r in df.collect())


def duck_connection(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for file in Path(folder).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return connection


def duck_rows(connection, sql: str) -> tuple[list[str], Counter]:
    cursor = connection.execute(sql)
    columns = [d[0] for d in cursor.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = Counter(tuple(plain(r[i]) for i in order) for r in cursor.fetchall())
    return [columns[i] for i in order], rows


def differences(spark: SparkSession, connection, folder: str, name: str) -> str | None:
    """What differs between the query and its SQL, or None."""
    names, got = spark_rows(queries()[name](spark, folder))
    expected_names, expected = duck_rows(connection, oracle_sql()[name])
    if names != expected_names:
        return f"columns {names} against {expected_names}"
    if got != expected:
        extra, lost = list((got - expected).items())[:2], list((expected - got).items())[:2]
        return (
            f"{sum(got.values())} rows against {sum(expected.values())}; only Spark {extra}; "
            f"only SQL {lost}"
        )
    return None


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(queries())
    spark = build_session(
        master="local[8]",
        extra={"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = duck_connection(folder)
    failed = 0
    for name in wanted:
        started = time.time()
        try:
            found = differences(spark, connection, folder, name)
        except Exception as error:  # report and go on with the others
            found = f"{type(error).__name__}: {str(error)[:600]}"
        failed += found is not None
        print(f"{'ok  ' if found is None else 'FAIL'} {name} {time.time() - started:.1f}s {found or ''}")
    print(f"{len(wanted) - failed} of {len(wanted)} equal")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
