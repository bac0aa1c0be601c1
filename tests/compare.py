"""Run registered queries and their SQL on the same tables and compare the rows."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return connection


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value


def _sorted(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    table = [tuple(_cell(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(table, key=repr)


# Spark's and DuckDB's names of the types that results are made of.
KINDS = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}


def differences(spark_df, connection, sql: str) -> list[str]:
    """Empty if both sides have the same columns, kinds of types and rows."""
    result = connection.execute(sql)
    their_columns = [d[0] for d in result.description]
    theirs = _sorted(their_columns, result.fetchall())
    ours = _sorted(spark_df.columns, [tuple(row) for row in spark_df.collect()])
    if ours[0] != theirs[0]:
        return [f"columns {ours[0]} != {theirs[0]}"]
    kinds = {f.name: KINDS.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in spark_df.schema.fields}
    their_kinds = {d[0]: str(d[1]) for d in result.description}
    if kinds != their_kinds:
        return [f"types {name}: {kinds[name]} != {their_kinds[name]}" for name in kinds if kinds[name] != their_kinds[name]]
    if len(ours[1]) != len(theirs[1]):
        return [f"{len(ours[1])} rows != {len(theirs[1])}"]
    wrong = [(a, b) for a, b in zip(ours[1], theirs[1]) if a != b or _types(a) != _types(b)]
    return [f"{len(wrong)} rows differ: {str(pair)[:600]}" for pair in wrong[:2]]


def _types(row) -> list[str]:
    return ["null" if v is None else type(v).__name__ for v in row]


def main(sf: str, names: list[str]) -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as entry
    from affectframe import get_spark

    spark = get_spark(
        master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="8g", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection, failed, oracles = connect(sf), 0, entry.oracle_sql()
    for name, run in entry.queries().items():
        if names and name not in names:
            continue
        try:
            start = time.time()
            if name in oracles:
                connection.execute(oracles[name]).fetchall()
            middle = time.time()
            frame = run(spark, sf)
            problems = differences(frame, connection, oracles[name]) if name in oracles else []
            took = f"sql {middle - start:6.2f}s, both {time.time() - middle:6.2f}s"
        except Exception as problem:
            problems, took = [f"{type(problem).__name__}: {str(problem)[:900]}"], ""
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok':5}{name:34}{took}", *problems, sep="\n      " if problems else " ", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
