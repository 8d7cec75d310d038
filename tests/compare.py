"""Runs registered queries against their SQL on one folder of test tables.

    python -m tests.compare /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from collections import Counter

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def duck(sf_dir: str):
    import duckdb

    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')"
        )
    return connection


def canonical(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(canonical(row[i]) for i in order) for row in rows)


def differences(spark_df, connection, sql: str) -> str | None:
    """None when both hold the same rows, else what differs."""
    cursor = connection.execute(sql)
    expected_columns = [c[0] for c in cursor.description]
    if sorted(expected_columns) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(expected_columns)}"
    expected = bag(expected_columns, cursor.fetchall())
    actual = bag(spark_df.columns, spark_df.collect())
    if expected == actual:
        return None
    missing, surplus = expected - actual, actual - expected
    return (
        f"rows {sum(actual.values())} vs {sum(expected.values())}; "
        f"missing {sum(missing.values())} e.g. {list(missing)[:2]}; "
        f"surplus {sum(surplus.values())} e.g. {list(surplus)[:2]}"
    )


def main(sf_dir: str, names: list[str]) -> int:
    import __spark_entry__ as entry
    from silvermart.session import local_session

    spark = local_session("compare")
    connection = duck(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in names or [n for n in queries if n in oracle]:
        start = time.time()
        problem = differences(queries[name](spark, sf_dir), connection, oracle[name])
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s {problem or ''}")
        sys.stdout.flush()
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]) > 0)
