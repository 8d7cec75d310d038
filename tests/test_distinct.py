"""The two-step distinct against Spark's own."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from silvermart.operators import distinct
from silvermart.operators.distinct import distinct_by_digest

SCHEMA = "`a.b` string, n int, x double"
ROWS = [
    ("p", 1, 0.5), ("p", 1, 0.5), ("p", None, 0.5), ("p", None, 0.5), (None, 1, 0.5), (None, None, None),
    (None, None, None), ("q", 2, 0.0), ("q", 2, -0.0), ("r", 3, float("nan")), ("r", 3, float("nan")),
    ("", 1, 0.5), ("only", 9, 1.0), ("t" * 50_000, 1, 2.0), ("t" * 50_000, 1, 2.0),
]


def bag(df) -> Counter:
    return Counter(repr(tuple(0.0 if v == 0 else v for v in r)) for r in df.collect())


def both(spark, store, rows) -> tuple[Counter, Counter]:
    table = store.write("rows", spark.createDataFrame(rows, SCHEMA))
    return bag(distinct_by_digest(table, store)), bag(store.open(table).distinct())


def test_each_row_stays_once(spark, store):
    found, expected = both(spark, store, ROWS)
    assert found == expected and set(found.values()) == {1}


@pytest.mark.parametrize("rows", [[], ROWS[:1], [ROWS[0]] * 200, [(str(i), i, 0.0) for i in range(50)]])
def test_empty_single_equal_and_different_rows(spark, store, rows):
    found, expected = both(spark, store, rows)
    assert found == expected


def test_rows_that_share_a_digest_both_stay(spark, store, monkeypatch):
    class Coarse:
        """The functions with a digest of one bit."""

        def __getattr__(self, name):
            return getattr(distinct_functions, name)

        def xxhash64(self, *columns):
            return distinct_functions.xxhash64(*columns) % 2

    distinct_functions = distinct.F
    monkeypatch.setattr(distinct, "F", Coarse())
    found, expected = both(spark, store, ROWS)
    assert found == expected


def test_only_repeated_rows_are_shuffled_and_too_many_digests_take_the_plain_way(spark, store):
    table = store.write("rows", spark.createDataFrame(ROWS, SCHEMA))
    plan = distinct_by_digest(table, store)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "LeftSemi" in plan
    expected = bag(store.open(table).distinct())
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plain = distinct_by_digest(table, store)
        assert "Join" not in plain._jdf.queryExecution().optimizedPlan().toString()
        assert bag(plain) == expected
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_too_many_repeated_digests_are_marked_by_bits(spark, store):
    """More than can be broadcast: only rows whose bit is set go through the distinct."""
    i = F.col("id")
    text = F.concat(F.lit("t"), i % 10_000)
    rows = spark.range(15_000).select(text.alias("a.b"), F.when(i % 7 > 0, i % 10_000).alias("n"))
    rows = rows.withColumn("n", F.when(F.col("`a.b`") == "t3", None).otherwise(F.col("n")))
    table = store.write("rows", rows.unionByName(rows.where("n < 1000")))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "16k")
    try:
        found = distinct_by_digest(table, store)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "LeftOuter" in plan and "getbit" in plan
        assert bag(found) == bag(store.open(table).distinct())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_each_repeated_digest_has_its_bit_and_few_others(spark, store):
    tagged = spark.range(20_000).select("id", F.xxhash64("id").alias(distinct.DIGEST))
    repeated = tagged.where("id < 4000").select(distinct.DIGEST)
    marked = distinct._marked(tagged, repeated, 4 * distinct.SLOT_BITS, store)
    assert marked.columns == tagged.columns
    by_kind = marked.groupBy(F.col("id") < 4000, distinct.DIGEST).count().collect()
    counts = {(r[0], r[1]): r["count"] for r in by_kind}
    assert counts[True, True] == 4000 and (True, False) not in counts
    # 4000 of 131,072 bits.
    assert counts[False, True] < 0.05 * 16_000
