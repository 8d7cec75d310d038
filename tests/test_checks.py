from __future__ import annotations

import random
from decimal import Decimal

import pytest

from silvermart.plans import checks, reports
from silvermart.plans.star import CUSTOMER, LOCATION, PRODUCT
from silvermart.plans.workspace import workspace
from tests.conftest import DATA, raw_orders, raw_returns, rows_of, trusted_rows


def sales(spark, *rows):
    return spark.createDataFrame(list(rows), "order_id string, sales double")


def test_conflicts_list_the_values(store):
    raw = raw_orders(
        store,
        {"Category": "a "}, {"Category": "A"}, {"Category": "B"}, {"Category": "NaN"},
        {"Product ID": "P-2", "Category": "x"}, {"Product ID": "P-2", "Category": ""},
    )
    assert rows_of(checks.category_conflict(raw)) == [("P-1", 2, ["A", "B"])]
    raw = raw_orders(store, {"Customer Name": "Ann"}, {"Customer Name": "Ann "}, {"Customer ID": "2"})
    assert rows_of(checks.customer_conflict(raw)) == [("C-1", 2, ["Ann", "Ann "])]
    raw = raw_orders(store, {"Product Name": "s"}, {"Product Name": "S"}, {"Product Name": "nan"})
    assert rows_of(checks.product_conflict(raw)) == [("P-1", 2, ["S", "s"])]


def test_nan_profile_counts_any_case_and_leaves_clean_columns_out(store):
    raw = raw_orders(store, {"City": "nan"}, {"City": " NaN", "Profit": "nan"}, {"City": ""})
    found = [tuple(r) for r in checks.nan_profile(raw).collect()]
    assert found == [("city", 2), ("profit", 1)]


def test_returned_quantities(store):
    raw = raw_orders(store, {"Quantity": "-1"}, {"Quantity": "3"}, {"Order ID": " O-2", "Quantity": "5"})
    returns = raw_returns(store, ("Yes", "O-1"), ("No", "O-1"), ("Yes", "O-2"), ("Yes", "O-9"))
    assert rows_of(checks.returned_quantities(raw, returns)) == [("-1",), ("3",)]
    assert rows_of(checks.returned_quantities_clean(raw, returns)) == [("-1",), ("3",), ("5",)]


def test_valid_subcategories_need_a_gap_and_a_value_in_the_same_pair(store):
    raw = raw_orders(
        store,
        {"Sub-Category": "nan"}, {"Sub-Category": "b"}, {"Sub-Category": "a"},
        {"Product ID": "P-2", "Sub-Category": " "},
        {"Product ID": "P-3", "Sub-Category": "a"},
        {"Product ID": "P-4", "Sub-Category": "nan", "Category": "x"},
        {"Product ID": "P-4", "Sub-Category": "a", "Category": "y"},
    )
    found = checks.valid_subcategories(raw)
    assert found.columns == [
        "Product ID", "Category", "found_subcategories", "valid_options_count",
    ]
    assert rows_of(found) == [("P-1", "Chairs", ["a", "b"], 2)]


def test_reconciliation_over_the_full_join_misses_what_the_sibling_sees(spark):
    trusted, fact = sales(spark, ("o", 10.0), ("o", 10.0)), sales(spark, ("o", 10.0))
    assert rows_of(checks.sales_faithful(trusted, fact)) == [(20.0, 20.0, 0.0)]
    assert rows_of(checks.sales_by_order(trusted, fact)) == [("o", 2, 1, 20.0, 10.0, 10.0)]
    assert rows_of(checks.sales_total(trusted, fact)) == [(20.0, 10.0, 10.0)]
    same = sales(spark, ("o", 10.0), ("o", 30.0))
    assert rows_of(checks.sales_faithful(same, same)) == [(80.0, 80.0, 0.0)]
    assert rows_of(checks.sales_by_order(same, same)) == []


def test_reconciliation_equals_the_real_full_join(spark):
    pick = random.Random(7)

    def some():
        return [
            (pick.choice(["a", "b", "c", "d", None]), pick.choice([None, 1.25, 3.5, -2.0]))
            for _ in range(pick.randint(0, 12))
        ]

    for _ in range(6):
        t, f = some(), some()
        pairs = [(x, y) for x in t for y in f if x[0] is not None and x[0] == y[0]]
        matched_t = {x[0] for x, _ in pairs}
        matched_f = {y[0] for _, y in pairs}
        left = [x[1] for x, _ in pairs] + [x[1] for x in t if x[0] not in matched_t]
        right = [y[1] for _, y in pairs] + [y[1] for y in f if y[0] not in matched_f]

        def total(values):
            known = [Decimal(str(v)) for v in values if v is not None]
            return float(sum(known)) if known else None

        expected = (total(left), total(right))
        found = checks.sales_faithful(sales(spark, *t), sales(spark, *f)).first()
        assert (found.total_sales_trusted, found.total_sales_fact) == expected


def test_orphans_count_rows(spark):
    fact = spark.createDataFrame([(1,), (2,), (2,), (None,)], "customer_key int")
    dim = spark.createDataFrame([(1,), (3,)], "customer_key int")
    assert rows_of(checks.orphan_customers(fact, dim)) == [(3,)]
    assert rows_of(checks.orphan_customers(fact.limit(0), dim)) == [(0,)]


def test_fact_nulls(spark):
    schema = "order_date_key int, ship_date_key int, delivery_days long, discount_amount double"
    fact = spark.createDataFrame([(None, 1, -1, None), (1, None, 0, 1.0), (1, 1, None, 2.0)], schema)
    assert rows_of(checks.fact_nulls(fact)) == [(3, 1, 1, 1, 1)]
    assert rows_of(checks.fact_nulls(fact.limit(0))) == [(0, None, None, None, None)]


def test_repeated_natural_key(spark):
    dim = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "customer_key int, customer_id string")
    assert rows_of(checks.unique_customer_key(dim)) == []
    assert rows_of(checks.natural_key_customer(dim)) == [("a", 2)]


def test_run_checks_on_the_feed(spark):
    w = workspace(spark, DATA)
    table = checks.run_checks(
        spark, w.raw["Orders"], w.raw["Returns"], w.trusted, w.dims, w.fact
    )
    found = {(r["check"], r["metric"]): (r["value"], r["passed"]) for r in table.collect()}
    assert len(found) == table.count()
    assert found["orphans", "orphan_customers"] == (0.0, True)
    assert found["unique_product_key", "rows"] == (0.0, True)
    for check in ("category_conflict", "customer_conflict", "negative_returned_quantities"):
        assert found[check, "rows"][0] > 0 and found[check, "rows"][1] is False
    for check in ("natural_key_customer", "natural_key_product", "natural_key_geography"):
        assert found[check, "rows"][1] is False
    assert found["money_range", "rows"] == (0.0, True)
    assert found["product_conflict", "rows"][1] is False
    assert found["fact_nulls", "null_order_dates"][1] is False
    assert found["nan_profile", "rows"][1] is None
    assert found["volume", "fact_orders"] == (float(w.fact.count()), None)
    dropped = found["dropped_by_star_join", "rows"]
    assert dropped[0] > 0 and dropped[1] is False


def test_fact_holds_exactly_the_trusted_rows_with_all_attributes(spark):
    """Each row of a region with two managers finds both members of its location."""
    w = workspace(spark, DATA)
    lost = {r["missing"]: r["rows"] for r in checks.dropped_by_star_join(w.trusted).collect()}
    required = [c for c in [*CUSTOMER, *PRODUCT, *LOCATION] if c != "postal_code"]
    doubled = w.trusted.dropna(subset=required).where("region like '%West'").count()
    assert doubled > 0
    assert w.fact.count() == w.trusted.count() - lost["any"] + doubled
    gap = checks.sales_by_order(w.trusted, w.fact).agg({"trusted_rows": "sum", "fact_rows": "sum"})
    trusted_rows, fact_rows = (gap.first()[f"sum({c})"] for c in ("trusted_rows", "fact_rows"))
    assert trusted_rows - fact_rows == lost["any"] - doubled


# -- reports ---------------------------------------------------------------------------------


@pytest.fixture
def shop(spark):
    products = spark.createDataFrame(
        [(i, f"P-{i:02}", f"n{i}", "A" if i % 3 else "B", "s") for i in range(1, 15)],
        "product_key int, product_id string, product_name string, category string, "
        "sub_category string",
    )
    fact = spark.createDataFrame(
        [(i, 20200131 if i % 2 else 20200701, 10.0 * i, float(i - 13), i % 2) for i in range(1, 15)],
        "product_key int, order_date_key int, sales double, profit double, is_returned int",
    )
    return fact, products


def test_top_loss(shop):
    found = [(r.product_id, r.profit) for r in reports.top_loss_products(*shop).collect()]
    assert found == [(f"P-{i:02}", float(i - 13)) for i in range(1, 11)]
    assert rows_of(reports.top_loss_by_category(*shop)) == [("A", 7), ("B", 3)]


def test_profit_makers_are_no_loss(shop):
    fact, products = shop
    found = reports.top_loss_products(fact.filter("product_key > 11"), products)
    assert rows_of(found, "product_id", "profit") == [("P-12", -1.0)]


def test_margin_and_returns(shop):
    assert rows_of(reports.margin_by_category(*shop)) == [
        ("A", 750.0, -55.0, -55.0 / 750.0), ("B", 300.0, -22.0, -22.0 / 300.0),
    ]
    assert rows_of(reports.return_rate(*shop)) == [
        ("A", 10, 5, 0.5, 370.0), ("B", 4, 2, 0.5, 120.0),
    ]


def test_sales_by_month_and_half_year(shop, spark):
    days = spark.createDataFrame(
        [(20200131, "2020-01", 2020, 1), (20200701, "2020-07", 2020, 7)],
        "date_key int, year_month string, year int, month_number int",
    )
    fact, _ = shop
    assert rows_of(reports.monthly_sales(fact, days), "year_month", "sales", "lines") == [
        ("2020-01", 490.0, 7), ("2020-07", 560.0, 7),
    ]
    assert rows_of(reports.half_year_sales(fact, days)) == [
        (2020, "H1", 490.0, 7), (2020, "H2", 560.0, 7),
    ]


def test_what_cannot_be_computed_has_not_passed(spark, store):
    """A star schema that lost everything does not look healthy."""
    from silvermart.plans import star

    trusted = store.materialize("trusted", trusted_rows(store, [{}, {"Order ID": "O-2"}]))
    dims = {n: store.materialize(n, build(trusted, store)) for n, build in star.DIMENSIONS.items()}
    fact = store.materialize("fact", star.fact_orders(trusted, dims, store))
    raw, returns = raw_orders(store, {}), raw_returns(store)

    def failed(trusted, dims, fact) -> set[str]:
        table = checks.run_checks(spark, raw, returns, trusted, dims, fact)
        return {r["check"] for r in table.where("not passed").collect()}

    assert failed(trusted, dims, fact) == set()
    lost = failed(trusted, dims, fact.limit(0))
    assert {"fact_nulls", "sales_faithful", "sales_total", "sales_by_order"} <= lost
    assert {"sales_total", "sales_by_order"} <= failed(trusted.limit(0), dims, fact)
    no_products = {**dims, "dim_product": dims["dim_product"].limit(0)}
    assert "orphans" in failed(trusted, no_products, fact)


def test_differences_below_a_cent_are_found(spark, store):
    trusted = spark.createDataFrame([("O-1", 10.004), ("O-2", 5.0)], "order_id string, sales double")
    fact = spark.createDataFrame([("O-1", 10.0), ("O-2", 5.0)], "order_id string, sales double")
    assert [r.order_id for r in checks.sales_by_order(trusted, fact).collect()] == ["O-1"]


def test_one_huge_amount_does_not_end_the_sums(spark):
    rows = spark.createDataFrame(
        [("O-1", 1e30, 1.0), ("O-2", 5.0, 2.0)], "order_id string, sales double, profit double"
    )
    assert checks.sales_total(rows, rows).first().total_sales_fact == 5.0
    found = checks.money_range(rows, rows).collect()
    assert [(r.sales_beyond, r.profit_beyond) for r in found] == [(1, 0), (1, 0)]


def test_the_whole_total_counts_amounts_of_any_size(spark):
    schema = "order_id string, sales double"
    trusted = spark.createDataFrame([("O-1", 1e30), ("O-2", 5.0), ("O-3", None)], schema)
    fact = spark.createDataFrame([("O-1", 1e30), ("O-2", 4.75)], schema)
    assert tuple(checks.sales_total_whole(trusted, fact).first()) == (1e30, 1e30, 0.25)
    assert tuple(checks.sales_total_whole(trusted.limit(0), fact.limit(0)).first()) == (0.0, 0.0, 0.0)


def test_conflicts_in_long_form(store):
    raw = raw_orders(
        store,
        {"Category": "a "}, {"Category": "A"}, {"Category": "B"}, {"Category": "NaN"},
        {"Product ID": "P-2", "Category": "x"}, {"Product ID": "P-2", "Category": ""},
        {"Product ID": "nan", "Category": "x"}, {"Product ID": "nan", "Category": "y"},
    )
    assert rows_of(checks.category_conflict_rows(raw)) == [
        ("P-1", "A", 2), ("P-1", "B", 1), ("nan", "X", 1), ("nan", "Y", 1),
    ]
    assert "collect_list" not in checks.category_conflict_rows(raw)._jdf.queryExecution().toString()
    raw = raw_orders(store, {"Customer Name": "Ann"}, {"Customer Name": "Ann "}, {"Customer ID": "2"})
    assert rows_of(checks.customer_conflict_rows(raw)) == [("C-1", "Ann", 1), ("C-1", "Ann ", 1)]
    raw = raw_orders(store, {"Product Name": "s"}, {"Product Name": "S"}, {"Product Name": "nan"})
    assert rows_of(checks.product_conflict_rows(raw)) == [("P-1", "S", 1), ("P-1", "s", 1)]
    raw = raw_orders(
        store,
        {"Sub-Category": "nan"}, {"Sub-Category": "b"}, {"Sub-Category": "a"}, {"Sub-Category": "a"},
        {"Product ID": "P-3", "Sub-Category": "a"},
        {"Product ID": "P-4", "Sub-Category": "nan", "Category": "x"},
        {"Product ID": "P-4", "Sub-Category": "a", "Category": "y"},
    )
    assert rows_of(checks.valid_subcategory_rows(raw)) == [
        ("P-1", "Chairs", "a", 2), ("P-1", "Chairs", "b", 1),
    ]


def test_nan_profile_ignores_white_space_of_every_kind(store):
    from silvermart.functions.text import WHITESPACE

    cells = [*(f"{c}nan" for c in WHITESPACE), *(f"NAN{c}{c}" for c in WHITESPACE)]
    others = ["na n", "nan.", " nan", "nan ", "nano", "\x85nan"]
    raw = raw_orders(store, *[{"City": c} for c in cells + others])
    assert rows_of(checks.nan_profile(raw)) == [("city", len(cells))]


def test_the_report_shares_scans_and_leaves_nothing_behind(spark, store, monkeypatch, tmp_path):
    w = workspace(spark, DATA)
    tables = {
        name: store.materialize(name, df)
        for name, df in {
            "raw_orders": w.raw["Orders"], "trusted": w.trusted, "fact": w.fact,
        }.items()
    }
    monkeypatch.setattr(checks, "scratch_root", lambda spark, name: str(tmp_path / name))
    seen = []
    frame, write = type(tables["fact"]), checks.TableStore.write
    collect = frame.collect

    def watched_collect(df):
        seen.append(df._jdf.queryExecution().optimizedPlan().toString())
        return collect(df)

    def watched_write(self, name, df, *args, **kwargs):
        seen.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(self, name, df, *args, **kwargs)

    monkeypatch.setattr(frame, "collect", watched_collect)
    monkeypatch.setattr(checks.TableStore, "write", watched_write)
    checks.run_checks(
        spark, tables["raw_orders"], w.raw["Returns"], tables["trusted"], w.dims, tables["fact"]
    )
    # A column that only that table has.
    marks = {"raw_orders": "Row ID#", "trusted": "product_name_original#", "fact": "delivery_days#"}
    relations = [x for plan in seen for x in plan.splitlines() if "Relation [" in x]
    scans = {name: sum(mark in x for x in relations) for name, mark in marks.items()}
    assert scans["raw_orders"] <= 3 and scans["trusted"] <= 3 and scans["fact"] <= 3
    assert all(n > 0 for n in scans.values())
    assert not (tmp_path / "checks").exists()
