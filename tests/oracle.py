"""Runs a registered query on Spark and its SQL on DuckDB and compares the rows.

``python -m tests.oracle [--sf DIR] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import sys
import time

import duckdb
from pyspark.sql import DataFrame

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        if value == int(value) and abs(value) < 1e15:
            return int(value)
        return value
    return value


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


def difference(df: DataFrame, db: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when both sides hold the same rows, else what differs first."""
    left_columns, left = canonical(df.columns, [tuple(r) for r in df.collect()])
    result = db.execute(sql)
    right_columns, right = canonical([d[0] for d in result.description], result.fetchall())
    if left_columns != right_columns:
        return f"columns {left_columns} and {right_columns}"
    if len(left) != len(right):
        extra = [r for r in left if r not in set(right)][:2] if len(left) < 20000 else []
        return f"{len(left)} rows and {len(right)} rows, e.g. {str(extra)[:400]}"
    for a, b in zip(left, right):
        if a != b:
            return f"row {str(a)[:500]} and {str(b)[:500]}"
    return None


def main(arguments: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from folioflow.session import local_session

    sf_dir = "/root/testdata/sf0.01"
    if arguments[:1] == ["--sf"]:
        sf_dir, arguments = arguments[1], arguments[2:]
    spark, db = local_session(), connect(sf_dir)
    builds, oracles = queries(), oracle_sql()
    wrong = 0
    for name in arguments or builds:
        start = time.time()
        try:
            df = builds[name](spark, sf_dir)
            if name in oracles:
                found = difference(df, db, oracles[name])
                state = "ok" if found is None else f"DIFFERS: {found}"
            else:
                state = f"no SQL, {df.count()} rows"
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            state = f"FAILED: {type(error).__name__}: {str(error)[:600]}"
        wrong += state.startswith(("DIFFERS", "FAILED"))
        print(f"{name:28s} {time.time() - start:6.2f}s {state}", flush=True)
    print(f"{wrong} wrong")
    return wrong


if __name__ == "__main__":
    sys.exit(min(main(sys.argv[1:]), 1))
