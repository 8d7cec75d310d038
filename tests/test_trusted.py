from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from silvermart import schemas
from silvermart.operators.attach import with_row_tag
from silvermart.plans import trusted as layer
from silvermart.plans.workspace import workspace
from silvermart.sources.store import TableStore
from tests.conftest import DATA, raw_orders, raw_people, raw_returns, rows_of, trusted_rows


def test_schema_and_types(store):
    df = trusted_rows(store, [{}])
    assert [(f.name, f.dataType) for f in df.schema] == [
        (f.name, f.dataType) for f in schemas.TRUSTED_ORDERS
    ]


def test_one_clean_row(store):
    row = trusted_rows(store, [{}]).first().asDict()
    assert (row["order_id"], row["ship_mode"], row["category"]) == ("O-1", "FIRST CLASS", "CHAIRS")
    assert (row["region"], row["regional_manager"], row["is_returned"]) == ("US-East", "Mia", 0)
    assert (row["sales"], row["quantity"], row["discount"], row["profit"]) == (10.0, 2, 0.1, 1.5)


def test_rows_without_an_order_id_go(store):
    df = trusted_rows(store, [{"Order ID": t} for t in ("nan", "", "  ", "NaN", "O-2")])
    assert rows_of(df, "order_id") == [("NaN",), ("O-2",)]


def test_tabs_around_text(store):
    df = trusted_rows(store, [{"Order ID": "\tO-9\n", "Order Date": "2020-02-03\t"}])
    assert rows_of(df, "order_id", F.col("order_date").cast("string")) == [("O-9", "2020-02-03")]


def test_ship_mode_comes_from_the_same_order(store):
    df = trusted_rows(
        store,
        [
            {"Ship Mode": "nan", "Product ID": "P-1"},
            {"Ship Mode": "A", "Product ID": "P-2"},
            {"Ship Mode": "B", "Product ID": "P-3"},
            {"Ship Mode": "", "Product ID": "P-4", "Order ID": "O-2"},
        ],
    )
    assert rows_of(df, "product_id", "ship_mode") == [
        ("P-1", "B"), ("P-2", "A"), ("P-3", "B"), ("P-4", None),
    ]


def test_a_missing_key_finds_no_donor(store):
    df = trusted_rows(
        store,
        [
            {"Customer ID": "nan", "Customer Name": "nan", "Sales": "1"},
            {"Customer ID": "nan", "Customer Name": "Bob", "Sales": "2"},
            {"Customer ID": "C-7", "Customer Name": "nan", "Sales": "3"},
            {"Customer ID": "C-7", "Customer Name": "Cid", "Sales": "4"},
        ],
    )
    assert rows_of(df, "sales", "customer_name") == [
        (1.0, None), (2.0, "Bob"), (3.0, "Cid"), (4.0, "Cid"),
    ]


def test_postal_code_is_the_mode_of_the_place(store):
    place = [("9", 2), ("8", 2), ("7", 1), ("nan", 1)]
    changes = [
        {"Postal Code": code, "Sales": f"{code if code != 'nan' else 0}{i}"}
        for code, times in place
        for i in range(times)
    ] + [{"Postal Code": "nan", "City": "nan", "Sales": "99"}]
    df = trusted_rows(store, changes)
    assert rows_of(df.filter("sales = 0"), "postal_code") == [("8",)]
    assert rows_of(df.filter("sales = 99"), "postal_code") == [(None,)]


def test_the_most_frequent_name_replaces_the_others(store):
    df = trusted_rows(
        store,
        [{"Product Name": n, "Sales": str(i)} for i, n in enumerate(["X", "X", "Y", "nan"])],
    )
    assert rows_of(df, "sales", "product_name", "product_name_original") == [
        (0.0, "X", "X"), (1.0, "X", "X"), (2.0, "X", "Y"), (3.0, "X", None),
    ]


def test_category_and_sub_category_are_repaired_apart(store):
    df = trusted_rows(
        store,
        [
            {"Category": "a", "Sub-Category": "nan", "Sales": "1"},
            {"Category": "b", "Sub-Category": "t", "Sales": "2"},
            {"Category": "NaN", "Sub-Category": " ", "Sales": "3"},
        ],
    )
    assert rows_of(df, "sales", "category", "sub_category") == [
        (1.0, "A", "T"), (2.0, "B", "T"), (3.0, "B", "T"),
    ]


def test_returns_do_not_multiply_rows(store):
    df = trusted_rows(
        store,
        [{"Order ID": o} for o in ("O-1", "O-2", "O-3")],
        returns=[("Yes", "O-1"), ("yes ", " O-1"), ("No", "O-2"), ("YES", "nan")],
    )
    assert rows_of(df, "order_id", "is_returned") == [("O-1", 1), ("O-2", 0), ("O-3", 0)]


def test_two_managers_double_the_rows_of_their_region(store):
    people = [("Mia", "East"), ("Max", "EAST REGION"), ("Temporary Manager", "East"),
              ("nan", "East"), ("Zoe", "nan"), ("Wes", "wst")]
    df = trusted_rows(store, [{}, {"Region": "Wst", "Order ID": "O-2"}], people=people)
    assert rows_of(df, "order_id", "regional_manager") == [
        ("O-1", "Max"), ("O-1", "Mia"), ("O-2", "Wes"),
    ]
    cleaned = layer.clean_people(raw_people(store, *people))
    assert rows_of(layer.one_manager_per_region(cleaned)) == [("East", "Max"), ("West", "Wes")]


def test_exact_duplicates_go_but_not_other_quantities(store):
    df = trusted_rows(
        store,
        [{"Row ID": str(i), "Quantity": q, "Segment": "nan"}
         for i, q in enumerate(["2", "2.0", "2.4", "2"])],
    )
    assert rows_of(df, "quantity") == [(2,), (2,)]


def test_rows_that_a_repair_makes_equal_are_one(store):
    df = trusted_rows(store, [{"Ship Mode": "nan"}, {}, {"Discount": "-0.1"}, {"Region": "EAST"}])
    assert df.count() == 1


def test_large_lookups_give_the_same_table(spark, store, no_broadcast):
    w = workspace(spark, DATA)
    raw = w.raw
    large = layer.trusted_orders(raw["Orders"], raw["Returns"], raw["People"], store)
    assert "SortMergeJoin" in large._jdf.queryExecution().toString()
    assert large.exceptAll(w.trusted).isEmpty() and w.trusted.exceptAll(large).isEmpty()


def test_row_order_changes_nothing(spark, store):
    w = workspace(spark, DATA)
    shuffled = store.materialize("again", w.raw["Orders"].orderBy(F.xxhash64("Row ID")))
    again = layer.trusted_orders(shuffled, w.raw["Returns"], w.raw["People"], store)
    assert again.exceptAll(w.trusted).isEmpty() and w.trusted.exceptAll(again).isEmpty()
    assert w.trusted.distinct().count() == w.trusted.count()


@pytest.mark.parametrize(
    "keys, column",
    [(["order_id"], "ship_mode"), (["customer_id"], "customer_name"), (["product_id"], "category")],
)
def test_lookups_scan_their_own_columns_only(spark, store, keys, column):
    from silvermart.operators.donors import max_donors

    donors = max_donors(layer.clean_orders(workspace(spark, DATA).raw["Orders"]), keys, [column])
    schema = donors._jdf.queryExecution().toString().split("ReadSchema: struct<")[-1].split(">")[0]
    assert len(schema.split(",")) == len({"order_id", *keys, column})


def test_generated_code_stays_below_what_the_jvm_compiles(spark, store):
    """Methods beyond 8000 bytes are only interpreted, many times slower."""
    import re

    w = workspace(spark, DATA)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = layer.trusted_orders(w.raw["Orders"], w.raw["Returns"], w.raw["People"], w.scratch)
        debug = getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package")
        text = debug.codegenString(df._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)]
    assert sizes and max(sizes) < 8000


def test_flag_returns_alone(store):
    rows = with_row_tag(
        layer.clean_orders(raw_orders(store, {}, {"Order ID": "O-2", "Region": "nan"}))
    )
    returned = layer.clean_returns(raw_returns(store, ("Yes", "O-2")))
    people = layer.clean_people(raw_people(store, ("Mia", "East")))
    df = layer.flag_returns(rows, returned, people, store)
    assert rows_of(df, "order_id", "is_returned", "regional_manager") == [
        ("O-1", 0, "Mia"), ("O-2", 1, None),
    ]


@pytest.mark.parametrize("shuffled, scans", [(False, 2), (True, 3)])
def test_raw_orders_are_scanned_once_for_all_lookups(spark, store, monkeypatch, shuffled, scans):
    """One pass counts for all lookups, one makes the rows; large lookups need one for the keys."""
    raw = raw_orders(store, {}, {"Ship Mode": "nan"}, {})
    plans = []
    write = TableStore.write

    def watched(self, name, df, *args, **kwargs):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(self, name, df, *args, **kwargs)

    monkeypatch.setattr(TableStore, "write", watched)
    rows = layer.repaired_orders(
        raw, raw_returns(store), raw_people(store, ("Mia", "East")), store, shuffled
    )
    plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
    assert sum(plan.count("Row ID#") for plan in plans) == scans


def test_whole_rows_are_shuffled_once_for_all_large_lookups(spark, store):
    w = workspace(spark, DATA)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = layer.repaired_orders(
            w.raw["Orders"], w.raw["Returns"], w.raw["People"], store, shuffled=True
        )
        plan = rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("SortMergeJoin") == 5 and "BroadcastHashJoin" not in plan
    wide = [line for line in plan.splitlines() if "Exchange" in line]
    # Five narrow sides, by kind, and the rows themselves.
    assert len(wide) == 6 and all("hashpartitioning(row_tag#" in line for line in wide)


def test_trusted_rows_move_once_for_large_lookups_and_the_distinct(spark, store):
    """The distinct finds equal rows together already: rows are shuffled by their tag and not again."""
    w = workspace(spark, DATA)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = layer.trusted_orders(
            w.raw["Orders"], w.raw["Returns"], w.raw["People"], store, shuffled=True
        )
        plan = rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    above = plan.split("SortMergeJoin")[0]
    assert "HashAggregate" in above and "Exchange" not in above


def test_repaired_rows_with_their_tag_are_not_moved_again_by_the_distinct(spark, store):
    w = workspace(spark, DATA)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        repaired = layer.repaired_orders(
            w.raw["Orders"], w.raw["Returns"], w.raw["People"], store, shuffled=True, tagged=True
        )
        rows = layer.dedup_exact(repaired)
        plan = rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    above = plan.split("SortMergeJoin")[0]
    assert "HashAggregate" in above and "Exchange" not in above
    small = layer.repaired_orders(w.raw["Orders"], w.raw["Returns"], w.raw["People"], store)
    assert rows.columns == small.columns
    assert Counter(rows.collect()) == Counter(layer.dedup_exact(small).collect())


def test_shared_tags_take_what_was_found_by_the_key(store):
    """Rows with one tag and different keys, as a hash may give them, get each its own entry."""
    from silvermart.operators import attach as A

    rows = store.materialize(
        "rows",
        store.spark.createDataFrame(
            [(7, "a", "x"), (7, "a", "x"), (7, "b", "y"), (7, None, "z"), (8, "c", None)],
            "row_tag long, k string, m string",
        ),
    )
    entries = store.spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, n int")
    more = store.spark.createDataFrame([("y", 5), ("y", 6), ("z", 7)], "m string, o int")
    lookups = [A.store_lookup(store, "n", entries, ["k"]), A.store_lookup(store, "o", more, ["m"])]
    df = A.attach_all(
        rows, lookups, lambda x: A.hot_keys(rows, x.on), shuffled=True, shared_tags=True
    )
    assert sorted(map(str, df.select("k", "n", "o").collect())) == sorted(map(str, [
        Row(k="a", n=1, o=None), Row(k="a", n=1, o=None), Row(k="b", n=2, o=5),
        Row(k="b", n=2, o=6), Row(k=None, n=None, o=7), Row(k="c", n=3, o=None),
    ]))


def test_keys_that_are_missing_in_other_places_have_other_tags(spark):
    from silvermart.operators.attach import key_tag

    df = spark.createDataFrame([("a", None), (None, "a")], "k string, m string")
    assert df.select(key_tag(["k", "m"])).distinct().count() == 2


def test_the_feed_is_compiled(spark):
    """Its steps stay below 8000 bytes of code, beyond which the JVM only interprets them."""
    import re

    from silvermart.sources import feed
    from silvermart.sources.landing import stringify

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        debug = getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package")
        plan = stringify(feed.raw_orders(spark, DATA))._jdf.queryExecution().executedPlan()
        sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", debug.codegenString(plan))]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sizes and max(sizes) < 8000


@pytest.mark.parametrize("heavy", [False, True])
def test_the_lookup_that_places_the_rows_is_not_searched(store, heavy):
    """Its entries carry the rows' numbers; equal rows of a heavy key keep one number."""
    from silvermart.operators import attach as A

    data = [("a", str(i % 4)) for i in range(40)] + [("b", "x"), (None, "y")]
    rows = store.materialize("rows", store.spark.createDataFrame(data, "k string, m string"))
    entries = store.spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int")
    lookup = A.store_lookup(store, "n", entries, ["k"])
    salts = store.spark.createDataFrame([("a", 8)], "k string, salts long") if heavy else None
    numbered, tagged = A.tag_by(rows, lookup, salts, ["k", "m"])
    df = A.attach_all(
        numbered, [lookup], None, shuffled=True, shared_tags=True, tagged={"n": tagged}
    )
    found = [(r.k, r.m, r.n) for r in df.collect()]
    expected = [(k, m, {"a": 1, "b": 2}.get(k)) for k, m in data]
    assert sorted(map(str, found)) == sorted(map(str, expected))
    tags = numbered.where("k = 'a'").groupBy("m").agg(F.count_distinct("row_tag").alias("n"))
    assert [r.n for r in tags.collect()] == [1] * 4
    assert (numbered.where("k = 'a'").select("row_tag").distinct().count() > 1) == heavy


def test_what_small_lookups_add_does_not_move(spark, store):
    """The manager, and the rows that a second manager doubles, come after the move of whole rows."""
    w = workspace(spark, DATA)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "4000")
    try:
        rows = layer.trusted_orders(w.raw["Orders"], w.raw["Returns"], w.raw["People"], store)
        plan = rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" in plan
    assert plan.index("BroadcastHashJoin") < plan.index("SortMergeJoin")
    assert w.trusted.exceptAll(rows).isEmpty() and w.trusted.count() == rows.count()
