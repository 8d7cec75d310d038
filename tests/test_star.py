from __future__ import annotations

import datetime

import pytest

from silvermart import schemas
from silvermart.plans import star
from silvermart.plans.workspace import workspace
from tests.conftest import DATA, rows_of, trusted_rows


def build(store, changes, **feeds):
    trusted = store.materialize("trusted", trusted_rows(store, changes, **feeds))
    dims = {
        name: store.materialize(name, make(trusted, store))
        for name, make in star.DIMENSIONS.items()
    }
    return trusted, dims, star.fact_orders(trusted, dims, store)


@pytest.mark.parametrize(
    "name, schema",
    [
        ("dim_customer", schemas.DIM_CUSTOMER), ("dim_product", schemas.DIM_PRODUCT),
        ("dim_geography", schemas.DIM_GEOGRAPHY), ("dim_shipping", schemas.DIM_SHIPPING),
        ("dim_date", schemas.DIM_DATE),
    ],
)
def test_dimension_schemas(spark, name, schema):
    w = workspace(spark, DATA)
    found = star.DIMENSIONS[name](w.trusted, w.scratch).schema
    assert [(f.name, f.dataType) for f in found] == [(f.name, f.dataType) for f in schema]


def test_fact_schema(spark):
    found = workspace(spark, DATA).fact.schema
    assert [(f.name, f.dataType) for f in found] == [
        (f.name, f.dataType) for f in schemas.FACT_ORDERS
    ]


def test_a_customer_with_two_segments_has_two_keys(store):
    _, dims, fact = build(store, [{"Segment": "B"}, {"Segment": "A"}, {"Customer ID": "C-0"}])
    assert rows_of(dims["dim_customer"]) == [
        (1, "C-0", "Ann", "Home"), (2, "C-1", "Ann", "A"), (3, "C-1", "Ann", "B"),
    ]
    assert rows_of(fact, "customer_key") == [(1,), (2,), (3,)]


def test_missing_attributes_drop_the_row_but_postal_code_and_ship_mode_do_not(store):
    required = [
        "Customer Name", "Segment", "Product Name", "Category", "Sub-Category", "Country/Region",
        "Region", "State/Province", "City", "Customer ID", "Product ID",
    ]
    changes = [
        {c: "nan", "Order ID": f"O-{c}", "Customer ID": f"C-{c}", "Product ID": f"P-{c}"} | {c: "nan"}
        for c in [*required, "Postal Code", "Ship Mode"]
    ]
    for change in changes:
        change["City"] = change.get("City", change["Order ID"])
    trusted, dims, fact = build(store, [{}, *changes])
    assert trusted.count() == len(changes) + 1
    assert rows_of(fact, "order_id") == [("O-1",), ("O-Postal Code",), ("O-Ship Mode",)]
    assert "N/A" in [m for _, m in rows_of(dims["dim_shipping"])]


def test_missing_dates_stay_missing(store):
    _, _, fact = build(store, [{"Order Date": "NaT"}, {"Ship Date": "2020-01-01", "Order ID": "O-2"}])
    assert rows_of(fact, "order_id", "order_date_key", "ship_date_key", "delivery_days") == [
        ("O-1", None, 20200107, None), ("O-2", 20200105, 20200101, -4),
    ]


def test_discount_amount(store):
    _, _, fact = build(store, [{"Sales": "2.85", "Discount": "-0.1"}])
    assert rows_of(fact, "sales", "discount", "discount_amount") == [(2.85, 0.1, 0.29)]


def test_two_managers_double_the_fact_rows_again(store):
    people = [("Mia", "East"), ("Max", "East")]
    trusted, dims, fact = build(store, [{}], people=people)
    assert (trusted.count(), dims["dim_geography"].count(), fact.count()) == (2, 2, 4)


def test_calendar_is_contiguous(store):
    _, dims, _ = build(store, [{"Order Date": "2023-12-30", "Ship Date": "2024-01-02"}])
    found = rows_of(
        dims["dim_date"], "date_key", "full_date", "day_of_week", "day_name", "week_of_year",
        "month_name", "quarter_label", "year_month", "is_weekend",
    )
    d = datetime.date
    assert found == [
        (20231230, d(2023, 12, 30), 6, "Saturday", 52, "December", "Q4 2023", "2023-12", True),
        (20231231, d(2023, 12, 31), 7, "Sunday", 52, "December", "Q4 2023", "2023-12", True),
        (20240101, d(2024, 1, 1), 1, "Monday", 1, "January", "Q1 2024", "2024-01", False),
        (20240102, d(2024, 1, 2), 2, "Tuesday", 1, "January", "Q1 2024", "2024-01", False),
    ]


def test_a_feed_without_any_date_has_no_calendar(store):
    _, dims, fact = build(store, [{"Order Date": "nan", "Ship Date": "nan"}])
    assert dims["dim_date"].count() == 0 and fact.count() == 1


def test_large_dimensions_give_the_same_fact(spark, store, no_broadcast):
    w = workspace(spark, DATA)
    large = star.fact_orders(w.trusted, w.dims, store)
    assert "SortMergeJoin" in large._jdf.queryExecution().toString()
    assert large.exceptAll(w.fact).isEmpty() and w.fact.exceptAll(large).isEmpty()


def test_keys_are_the_same_on_every_run(spark, store):
    w = workspace(spark, DATA)
    for name, make in star.DIMENSIONS.items():
        again = make(w.trusted.repartition(7), store)
        assert again.exceptAll(w.dims[name]).isEmpty(), name
        assert again.count() == w.dims[name].count()


def test_fact_rows_are_shuffled_once_for_all_large_dimensions(spark, store):
    w = workspace(spark, DATA)
    trusted, dims = w.trusted, w.dims
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        fact = star.fact_orders(trusted, dims, store, shuffled=True, sizes=w.dim_sizes)
        plan = fact._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # Four narrow sides, by dimension, and the rows themselves.
    wide = [line for line in plan.splitlines() if "Exchange" in line]
    assert len(wide) == 5 and all("hashpartitioning(row_tag#" in line for line in wide)


def test_weights_of_members_come_from_their_build(spark, store, no_broadcast, monkeypatch):
    """The fact counts no keys of its own where the dimensions have counted theirs."""
    w = workspace(spark, DATA)
    monkeypatch.setattr(star, "hot_keys", lambda *args: pytest.fail("counted again"))
    counts: star.Counts = {}
    dims = {
        n: store.materialize(n, build(w.trusted, store, counts))
        for n, build in star.DIMENSIONS.items()
    }
    assert set(counts) == set(star.KEYED)
    fact = star.fact_orders(w.trusted, dims, store, shuffled=True, counts=counts)
    assert fact.exceptAll(w.fact).isEmpty() and w.fact.exceptAll(fact).isEmpty()


def test_a_check_of_one_dimension_builds_no_other(spark, tmp_path, monkeypatch):
    from silvermart.plans import workspace as ws

    w = ws.Workspace(spark, DATA)
    asked = []
    build = ws.build_dimensions

    def watched(trusted, store, scratch, counts, names):
        asked.extend(names)
        return build(trusted, store, scratch, counts, names)

    monkeypatch.setattr(ws, "build_dimensions", watched)
    w.__dict__["trusted"] = workspace(spark, DATA).trusted
    assert w.dim("dim_date").count() > 0 and asked == ["dim_date"]
    assert "fact" not in w.__dict__
    assert w.fact.count() > 0 and sorted(asked) == sorted(star.DIMENSIONS)
    assert list(w.dims) == list(star.DIMENSIONS) and len(asked) == len(star.DIMENSIONS)
