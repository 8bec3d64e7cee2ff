"""Runs registered queries in Spark and their expected results in DuckDB, and compares rows."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, bool):
        return value
    if isinstance(value, int):
        return float(value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def difference(spark_df, connection, sql):
    """None when both hold the same columns and rows, else what differs."""
    cursor = connection.execute(sql)
    expected_columns = [d[0] for d in cursor.description]
    expected = rows_of(expected_columns, cursor.fetchall())
    if sorted(spark_df.columns) != sorted(expected_columns):
        return f"columns {sorted(spark_df.columns)} against {sorted(expected_columns)}"
    found = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if len(found) != len(expected):
        return f"{len(found)} rows against {len(expected)}"
    wrong = [(a, b) for a, b in zip(found, expected) if a != b]
    if wrong:
        return f"{len(wrong)} rows differ, first {wrong[0][0]!r} against {wrong[0][1]!r}"
    return None


def main(folder: str, *names: str) -> None:
    from __spark_entry__ import oracle_sql, queries
    from lodgetier.runtime import session

    spark = session("compare", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    connection, expected = duck(folder), oracle_sql()
    for name, run in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = run(spark, folder)
            if name in expected:
                problem = difference(df, connection, expected[name]) or "same"
            else:
                problem = f"{df.count()} rows, no SQL"
        except Exception as error:  # noqa: BLE001
            problem = f"FAILED {type(error).__name__}: {str(error)[:600]}"
        print(f"{name:30} {time.time() - start:6.1f}s  {problem}", flush=True)


if __name__ == "__main__":
    main(*sys.argv[1:])
