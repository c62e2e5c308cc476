"""Compare a Spark result with the SQL result of the same name, order aside.

Run `python tests/compare.py <folder> [names...]` to check queries one by one.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return connection


def _cell(value) -> str:
    if value is None or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, bool):
        return str(int(value))
    if isinstance(value, float):
        return repr(0.0 if value == 0 else value)
    return str(value)


def rows(columns: list[str], data: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in data)


def differences(spark_df, connection, sql: str) -> list[str]:
    """Messages; empty if names, kinds, counts and values agree."""
    relation = connection.execute(sql)
    names = [c[0] for c in relation.description]
    expected_rows = relation.fetchall()
    actual_rows = [tuple(r) for r in spark_df.collect()]
    if sorted(names) != sorted(spark_df.columns):
        return [f"columns {sorted(spark_df.columns)} expected {sorted(names)}"]
    messages = []
    kinds = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "int": "INTEGER", "boolean": "BOOLEAN"}
    spark_kinds = {f.name: f.dataType.simpleString() for f in spark_df.schema.fields}
    for name, kind in zip(names, [str(c[1]) for c in relation.description]):
        if kinds.get(spark_kinds[name]) != kind:
            messages.append(f"column {name}: {spark_kinds[name]} expected {kind}")
    expected, actual = rows(names, expected_rows), rows(spark_df.columns, actual_rows)
    if len(expected) != len(actual):
        messages.append(f"{len(actual)} rows expected {len(expected)}")
    wrong = [(a, e) for a, e in zip(actual, expected) if a != e]
    if wrong:
        messages.append(f"{len(wrong)} rows differ, first {wrong[0][0]} expected {wrong[0][1]}")
    return messages


def main(folder: str, names: list[str]) -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from __spark_entry__ import oracle_sql, queries
    from methmix.session import local_session
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    connection, sql, bad = connect(folder), oracle_sql(), 0
    for name, function in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = function(spark, folder)
            if name in sql:
                messages = differences(df, connection, sql[name])
                note = "ok"
            else:
                messages, note = [], f"rows only: {df.count()}"
        except Exception as error:  # report and go on with the next query
            messages = [f"{type(error).__name__}: {' '.join(str(error).split())[-400:]}"]
        bad += bool(messages)
        print(f"{name}: {time.time() - start:.1f}s {'; '.join(messages) or note}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
