from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from silvermart.operators import attach as A
from silvermart.operators.dense_key import dense_key
from silvermart.operators.donors import max_donors, mode_donors
from silvermart.sources.store import TableStore
from tests.conftest import rows_of, stored

ROWS = 30_000


def skewed(store):
    """A third of the rows under one key, a tenth without a key, the rest spread."""
    n = F.col("id")
    key = (
        F.when(n % 10 < 3, "hot").when(n % 10 == 3, None).otherwise(F.concat(F.lit("k"), n % 5000))
    )
    rows = store.spark.range(ROWS).select(
        key.alias("k"), F.when(n % 2 == 0, "a").alias("part"), n.alias("n")
    )
    return A.with_row_tag(store.materialize("rows", rows))


def lookup_rows(store):
    keys = store.spark.range(5000).select(F.concat(F.lit("k"), "id").alias("k"))
    hot = store.spark.createDataFrame([("hot",), ("unused",)], "k string")
    return keys.filter("id % 3 <> 0").unionByName(hot).select(
        "k", F.concat(F.lit("value of "), "k").alias("value"), F.lit(1).alias("flag")
    )


def attached(store):
    rows = skewed(store)
    lookup = A.store_lookup(store, "l", lookup_rows(store), ["k"])
    return A.attach(rows, lookup, lambda: A.hot_keys(rows, ["k"]))


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_small_lookup_is_broadcast_and_the_rows_stay(store):
    df = attached(store)
    assert "BroadcastHashJoin" in plan(df) and "hashpartitioning" not in plan(df)


def test_large_lookup_gives_the_same_rows(store, no_broadcast):
    df = attached(store)
    rows = skewed(store)
    expected = rows.join(lookup_rows(store), "k", "left")
    columns = ["k", "n", "value", "flag"]
    assert df.count() == ROWS
    assert df.select(columns).exceptAll(expected.select(columns)).isEmpty()
    assert expected.select(columns).exceptAll(df.select(columns)).isEmpty()


def test_no_task_gets_the_hot_key_or_the_missing_keys(store, no_broadcast, spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = attached(store)
        assert "SortMergeJoin" in plan(df) and "hashpartitioning(k#" in plan(df)
        sizes = [r[0] for r in df.groupBy(F.spark_partition_id()).count().select("count").collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == ROWS
    assert max(sizes) < ROWS / 4 * 1.3


def test_hot_keys_are_few_and_leave_null_out(store):
    # Four shuffle partitions of eight pieces: a key is hot above a thirty-second of the rows.
    assert rows_of(A.hot_keys(skewed(store), ["k"])) == [("hot", 10)]


@pytest.mark.parametrize("entries", [1, 400])
def test_hot_keys_just_above_the_share_spread_evenly(store, no_broadcast, spark, entries):
    """Keys of a few per cent each, one with many lookup rows, and a third without a key."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        n = F.col("id")
        key = F.when(n % 3 == 0, None).when(n % 3 == 1, F.concat(F.lit("h"), n % 7)).otherwise(
            F.concat(F.lit("k"), n)
        )
        rows = A.with_row_tag(
            store.materialize("even", spark.range(40_000).select(key.alias("k"), n.alias("n")))
        )
        hot = spark.range(entries).select(F.lit("h1").alias("k"), F.col("id").alias("v"))
        rest = spark.range(40_000).select(F.concat(F.lit("k"), "id").alias("k"), F.lit(0).alias("v"))
        lookup = A.store_lookup(store, "even", hot.unionByName(rest), ["k"])
        df = A.attach(rows, lookup, lambda: A.hot_keys(rows, ["k"]))
        in_tasks = df.dropDuplicates(["n"]).count(), df.where("k = 'h1'").count()
        inputs = df.where("v = 0 or v is null").groupBy(F.spark_partition_id()).count()
        sizes = [r["count"] for r in inputs.collect()]
        h1 = rows.where("k = 'h1'").count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert in_tasks == (40_000, h1 * entries)
    assert max(sizes) <= 1.6 * sum(sizes) / 40


def test_repeated_lookup_keys_repeat_the_rows(store, no_broadcast):
    rows = A.with_row_tag(stored(store, "r", [("x", 1), ("y", 2), (None, 3)], "k string, n int"))
    entries = store.spark.createDataFrame([("x", "a"), ("x", "b")], "k string, v string")
    lookup = A.store_lookup(store, "l", entries, ["k"])
    df = A.attach(rows, lookup, lambda: A.hot_keys(rows, ["k"]))
    assert rows_of(df, "n", "v") == [(1, "a"), (1, "b"), (2, None), (3, None)]


@pytest.mark.parametrize(
    "text, size",
    [("10485760b", 10 << 20), ("-1", -1), ("10MB", 10 << 20), ("1g", 1 << 30), ("64k", 64 << 10), ("1pb", 1 << 50)],
)
def test_broadcast_limit(spark, text, size):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, text)
    try:
        assert A.broadcast_limit(spark) == size
    finally:
        spark.conf.set(name, before)


# -- dense keys ------------------------------------------------------------------------------


def test_dense_key_equals_the_global_row_number(store, spark):
    n = F.col("id")
    members = spark.range(15_000).select(
        F.when(n % 100 != 0, F.concat(F.lit("c"), n % 300)).alias("a"), n.cast("string").alias("b")
    )
    order = [F.col("a").asc_nulls_last(), F.col("b").asc_nulls_last()]
    expected = members.withColumn("key", F.row_number().over(Window.orderBy(*order)))
    numbered = dense_key(members.repartition(16), ["a", "b"], "key", store, "m")
    columns = ["key", "a", "b"]
    assert numbered.columns == columns
    assert numbered.exceptAll(expected.select(columns)).isEmpty()
    assert numbered.count() == 15_000


def test_dense_key_of_nothing(store, spark):
    empty = spark.createDataFrame([], "a string")
    assert dense_key(empty, ["a"], "key", store, "m").count() == 0


# -- donors ----------------------------------------------------------------------------------


def test_max_donors_keep_only_what_repairs_something(spark):
    rows = [
        ("both", None), ("both", "A"), ("both", "B"), ("full", "A"), ("empty", None), (None, "Z"),
        (None, None),
    ]
    df = spark.createDataFrame(rows, "k string, v string")
    assert rows_of(max_donors(df, ["k"], ["v"])) == [("both", "B")]


def test_mode_donors(spark):
    rows = [
        ("tie", "b"), ("tie", "a"), ("tie", None), ("most", "x"), ("most", "y"), ("most", "y"),
        ("one", "x"), ("gap", "q"), ("gap", None), ("empty", None), (None, "x"), (None, None),
    ]
    df = spark.createDataFrame(rows, "k string, v string")
    assert rows_of(mode_donors(df, ["k"], "v")) == [("gap", "q"), ("tie", "a")]
    assert rows_of(mode_donors(df, ["k"], "v", overwrite=True)) == [
        ("gap", "q"), ("most", "y"), ("tie", "a"),
    ]


def test_mode_counts_rows_across_the_other_columns(spark):
    """The name is counted over all its rows, not once per category it appears with."""
    rows = [
        ("p", "x", "c1"), ("p", "x", "c2"), ("p", "x", None), ("p", "y", "c1"), ("p", "y", "c1"),
    ]
    df = spark.createDataFrame(rows, "k string, v string, c string")
    donors = mode_donors(df, ["k"], "v", overwrite=True, max_columns=("c",))
    assert rows_of(donors) == [("p", "x", "c2")]


def test_several_lookups_at_once_equal_one_after_the_other(store, spark):
    """Small and large, unique and repeated, one and two key columns, hot and missing keys."""
    n = F.col("id")
    rows = A.with_row_tag(
        store.materialize(
            "many",
            spark.range(6000).select(
                F.when(n % 3 == 0, "hot").when(n % 3 == 1, F.concat(F.lit("k"), n % 50)).alias("a"),
                F.when(n % 7 > 0, F.concat(F.lit("1:"), n % 4)).alias("b"),
                F.concat(F.lit("x"), n % 5).alias("c"),
                n.alias("n"),
            ),
        )
    )
    tables = {
        "a": spark.createDataFrame([("hot", "h", "H"), ("k7", "s", None)], "a string, p string, q string"),
        "bc": spark.createDataFrame(
            [("1:1", "x2", 1), ("1:1", "x2", 2), ("1:2", "x0", 3)], "b string, c string, r int"
        ),
        "c": spark.createDataFrame([("x1", "one")], "c string, s string"),
    }
    keys = {"a": ["a"], "bc": ["b", "c"], "c": ["c"]}
    lookups = [A.store_lookup(store, name, df, keys[name]) for name, df in tables.items()]
    expected = rows
    for name, df in tables.items():
        expected = expected.join(df, keys[name], "left")
    columns = ["n", "p", "q", "r", "s"]
    for shuffled in (False, True):
        df = A.attach_all(rows, lookups, lambda x: A.hot_keys(rows, x.on, store), shuffled)
        assert rows_of(df, *columns) == rows_of(expected, *columns)


def test_neighbours_move_together_to_what_several_lookups_have_found(store, spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        n = F.col("id")
        scan = spark.range(0, 4000, 1, 1).select(F.concat(F.lit("k"), n % 700).alias("k"), n.alias("n"))
        rows = A.with_row_tag(store.materialize("rows", scan))
        entries = spark.range(600).select(F.concat(F.lit("k"), "id").alias("k"), F.col("id").alias("v"))
        more = entries.where("id < 50").unionByName(entries)
        lookup = A.store_lookup(store, "v", more.select("k", "v"), ["k"])
        df = A.attach_all(rows, [lookup], lambda x: A.hot_keys(rows, x.on), shuffled=True)
        got = df.select("row_tag", "n", "v", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    expected = [(i, i, i % 700 if i % 700 < 600 else None) for i in range(4000)]
    expected += [x for x in expected if x[2] is not None and x[2] < 50]
    assert sorted((r.row_tag, r.n, str(r.v)) for r in got) == sorted((t, i, str(v)) for t, i, v in expected)
    blocks = {(r.row_tag >> A.BLOCK_BITS, r.task) for r in got}
    assert len(blocks) == 4000 >> A.BLOCK_BITS and len({task for _, task in blocks}) == 16


def test_kinds_are_counted_in_one_pass(store, spark):
    from silvermart.operators.donors import count_kinds

    rows = stored(
        store, "kinds", [("a", "x", "1"), ("a", "x", None), ("a", None, "1"), (None, "x", "2")],
        "a string, b string, v string",
    )
    kinds = {"a": (["a"], ["v"]), "ab": (["a", "b"], ["v"]), "none": (["b"], [])}
    found = count_kinds(rows, kinds, store, "counted")
    assert rows_of(found["a"]) == [("a", None, 1), ("a", "1", 2)]
    assert rows_of(found["none"]) == [("x", 3)]
    assert rows_of(found["ab"]) == [("a", "x", None, 1), ("a", "x", "1", 1)]


def test_entries_of_lookups_are_compiled(store, no_broadcast, monkeypatch):
    """No function with a lambda in the passes over all rows; those are interpreted row by row."""
    from silvermart.operators.donors import count_kinds

    plans = []
    write = TableStore.write

    def watched(self, name, df, *args, **kwargs):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(self, name, df, *args, **kwargs)

    monkeypatch.setattr(TableStore, "write", watched)
    rows = A.with_row_tag(
        store.materialize("rows", store.spark.createDataFrame([("a", None), (None, "b")], "k string, m string"))
    )
    counted = count_kinds(rows, {"k": (["k"], ["m"]), "m": (["m"], [])}, store, "counted")
    assert rows_of(counted["k"]) == [("a", None, 1)] and rows_of(counted["m"]) == [("b", 1)]
    entries = store.spark.createDataFrame([("a", 1)], "k string, n int")
    lookup = A.store_lookup(store, "n", entries, ["k"])
    df = A.attach_all(rows, [lookup], lambda x: A.hot_keys(rows, x.on), shuffled=True)
    assert rows_of(df, "k", "n") == [(None, None), ("a", 1)]
    assert len(plans) > 3 and not any("lambda" in plan for plan in plans)
