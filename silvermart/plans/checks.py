"""Data quality checks on the raw feed and on the star schema.

Checks named *_faithful or without a suffix keep the meaning of the original query; the siblings
next to them test what the original meant to test where the two differ.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silvermart.functions import beyond_exact, clean_text, exact, is_missing, trim_all
from silvermart.functions.numbers import EXACT_TYPE
from silvermart.functions.text import WHITESPACE
from silvermart.operators.donors import count_kinds
from silvermart.operators.exact_sums import partial_sums, totals
from silvermart.plans.star import CUSTOMER, LOCATION, PRODUCT
from silvermart.sources.store import TableStore, in_parallel, scratch_root, shuffles_go

# Raw column behind each name of the missing-value profile.
PROFILE_COLUMNS = {
    "row_id": "Row ID",
    "order_id": "Order ID",
    "order_date": "Order Date",
    "ship_date": "Ship Date",
    "ship_mode": "Ship Mode",
    "customer_id": "Customer ID",
    "customer_name": "Customer Name",
    "segment": "Segment",
    "country": "Country/Region",
    "city": "City",
    "state": "State/Province",
    "postal_code": "Postal Code",
    "region": "Region",
    "product_id": "Product ID",
    "category": "Category",
    "sub_category": "Sub-Category",
    "product_name": "Product Name",
    "sales": "Sales",
    "quantity": "Quantity",
    "discount": "Discount",
    "profit": "Profit",
}


def _raw(name: str):
    return F.col(f"`{name}`")


# -- the raw feed ----------------------------------------------------------------------------


def _conflicts(raw_orders: DataFrame, key: str, value: str, shown) -> DataFrame:
    """Keys with more than one value. The rows collapse to distinct pairs before any grouping."""
    return (
        raw_orders.filter(~is_missing(_raw(value)))
        .select(_raw(key), shown(_raw(value)).alias("name"))
        .distinct()
        .groupBy(_raw(key))
        .agg(
            F.count("name").alias("diff_name_count"),
            F.sort_array(F.collect_list("name")).alias("associated_names"),
        )
        .filter(F.col("diff_name_count") > 1)
    )


def _several(pairs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys with more than one value, by least and greatest, which combine before the shuffle."""
    bounds = pairs.groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    return bounds.where("low <> high").select(*keys)


def _conflict_rows(raw_orders: DataFrame, key: str, key_name: str, value: str, shown) -> DataFrame:
    """One row per conflicting key and value, with its number of rows; no list is built, so a key
    may have any number of values."""
    pairs = (
        raw_orders.filter(~is_missing(_raw(value)))
        .groupBy(_raw(key).alias(key_name), shown(_raw(value)).alias("name"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    return pairs.join(_several(pairs, [key_name], "name"), key_name, "left_semi")


def category_conflict_rows(raw_orders: DataFrame) -> DataFrame:
    """category_conflict in long form."""
    return _conflict_rows(
        raw_orders, "Product ID", "product_id", "Category", lambda c: F.upper(trim_all(c))
    )


def customer_conflict_rows(raw_orders: DataFrame) -> DataFrame:
    """customer_conflict in long form."""
    return _conflict_rows(raw_orders, "Customer ID", "customer_id", "Customer Name", lambda c: c)


def product_conflict_rows(raw_orders: DataFrame) -> DataFrame:
    """product_conflict in long form."""
    return _conflict_rows(raw_orders, "Product ID", "product_id", "Product Name", lambda c: c)


def category_conflict(raw_orders: DataFrame) -> DataFrame:
    """Product ids with several categories, compared trimmed and in upper case."""
    return _conflicts(raw_orders, "Product ID", "Category", lambda c: F.upper(trim_all(c)))


def customer_conflict(raw_orders: DataFrame) -> DataFrame:
    """Customer ids with several names, compared as written."""
    return _conflicts(raw_orders, "Customer ID", "Customer Name", lambda c: c)


def product_conflict(raw_orders: DataFrame) -> DataFrame:
    """Product ids with several names, compared as written."""
    return _conflicts(raw_orders, "Product ID", "Product Name", lambda c: c)


def nan_profile(raw_orders: DataFrame) -> DataFrame:
    """How often each column holds 'nan'; columns that never do are absent.

    One pass counts all columns at once and only the single result row is turned into rows.
    """
    # One pattern per column: trimming 21 of them would be more code than the JVM compiles at once.
    blanks = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in WHITESPACE) + "]*"
    counts = raw_orders.agg(
        *[
            F.count_if(_raw(raw).rlike(rf"(?i)\A{blanks}nan{blanks}\z")).alias(name)
            for name, raw in PROFILE_COLUMNS.items()
        ]
    )
    return (
        counts.unpivot([], list(PROFILE_COLUMNS), "column_name", "null_count")
        .filter(F.col("null_count") > 0)
        .orderBy(F.desc("null_count"), "column_name")
    )


def _quantities(orders: DataFrame, returned: DataFrame) -> DataFrame:
    # The semi join comes first: the quantities then collapse before they are shuffled.
    return orders.join(returned.distinct(), "order", "left_semi").select("quantity").distinct()


def returned_quantities(raw_orders: DataFrame, raw_returns: DataFrame) -> DataFrame:
    """Quantities that occur on returned orders, order ids compared as written."""
    return _quantities(
        raw_orders.select(_raw("Order ID").alias("order"), _raw("Quantity").alias("quantity")),
        raw_returns.select(_raw("Order ID").alias("order")),
    )


def returned_quantities_clean(raw_orders: DataFrame, raw_returns: DataFrame) -> DataFrame:
    """The same with cleaned order ids, so that stray blanks do not hide a match."""
    return _quantities(
        raw_orders.select(
            clean_text(_raw("Order ID")).alias("order"), _raw("Quantity").alias("quantity")
        ),
        raw_returns.select(clean_text(_raw("Order ID")).alias("order")),
    )


def valid_subcategories(raw_orders: DataFrame) -> DataFrame:
    """Sub-categories seen for the (product, category) pairs that also miss one.

    One grouping answers both halves, where a join would meet every missing row with every
    present one. A pair with a NULL part matches nothing.
    """
    sub = _raw("Sub-Category")
    return (
        raw_orders.filter(_raw("Product ID").isNotNull() & _raw("Category").isNotNull())
        .select("Product ID", "Category", F.when(~is_missing(sub), sub).alias("valid"))
        .distinct()
        .groupBy("Product ID", "Category")
        .agg(
            F.sort_array(F.collect_list("valid")).alias("found_subcategories"),
            F.count("valid").alias("valid_options_count"),
            F.max(F.col("valid").isNull()).alias("misses_one"),
        )
        .filter(F.col("misses_one") & (F.col("valid_options_count") > 0))
        .drop("misses_one")
    )


def valid_subcategory_rows(raw_orders: DataFrame) -> DataFrame:
    """valid_subcategories in long form: a row per pair that misses one and sub-category seen."""
    sub, keys = _raw("Sub-Category"), ["product_id", "category"]
    seen = (
        raw_orders.filter(_raw("Product ID").isNotNull() & _raw("Category").isNotNull())
        .groupBy(
            _raw("Product ID").alias("product_id"),
            _raw("Category").alias("category"),
            F.when(~is_missing(sub), sub).alias("sub_category"),
        )
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    missing = seen.where("sub_category is null").select(*keys)
    return seen.where("sub_category is not null").join(missing, keys, "left_semi")


# -- the star schema -------------------------------------------------------------------------


def fact_nulls(fact: DataFrame) -> DataFrame:
    """Row count, missing dates, negative deliveries, missing discounts; NULL on an empty fact."""

    def rows_where(condition, name):
        return F.sum(F.when(condition, 1).otherwise(0)).alias(name)

    return fact.agg(
        F.count(F.lit(1)).alias("total_rows"),
        rows_where(F.col("order_date_key").isNull(), "null_order_dates"),
        rows_where(F.col("ship_date_key").isNull(), "null_ship_dates"),
        rows_where(F.col("delivery_days") < 0, "negative_delivery_days"),
        rows_where(F.col("discount_amount").isNull(), "null_discounts"),
    )


def orphans(
    fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, counted_as: str
) -> DataFrame:
    """Fact rows whose key is not in the dimension; the fact shrinks to its keys first."""
    return (
        fact.groupBy(F.col(fact_key).alias(dim_key))
        .agg(F.count(F.lit(1)).alias("n"))
        .join(dim.select(dim_key), dim_key, "left_anti")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias(counted_as))
    )


def orphan_customers(fact: DataFrame, dim_customer: DataFrame) -> DataFrame:
    return orphans(fact, dim_customer, "customer_key", "customer_key", "orphan_customers")


def orphan_geography(fact: DataFrame, dim_geography: DataFrame) -> DataFrame:
    return orphans(fact, dim_geography, "geography_key", "geography_key", "orphan_geography")


def orphan_products(fact: DataFrame, dim_product: DataFrame) -> DataFrame:
    return orphans(fact, dim_product, "product_key", "product_key", "orphan_products")


def orphan_shipping(fact: DataFrame, dim_shipping: DataFrame) -> DataFrame:
    return orphans(fact, dim_shipping, "shipping_key", "shipping_key", "orphan_shipping")


def orphan_dates(fact: DataFrame, dim_date: DataFrame) -> DataFrame:
    """Known order or ship dates that the calendar does not hold."""
    dates = fact.select(F.explode(F.array("order_date_key", "ship_date_key")).alias("date_key"))
    known = dates.filter(F.col("date_key").isNotNull())
    return orphans(known, dim_date, "date_key", "date_key", "orphan_dates")


def _per_order(df: DataFrame, prefix: str) -> DataFrame:
    return df.groupBy("order_id").agg(
        F.count(F.lit(1)).alias(f"{prefix}_rows"), F.sum(exact(F.col("sales"))).alias(prefix)
    )


def _sales_report(total_trusted, total_fact) -> list:
    return [
        F.round(total_trusted, 2).cast("double").alias("total_sales_trusted"),
        F.round(total_fact, 2).cast("double").alias("total_sales_fact"),
        F.round(total_trusted - total_fact, 2).cast("double").alias("difference"),
    ]


def sales_faithful(trusted: DataFrame, fact: DataFrame) -> DataFrame:
    """Sales totals over the full outer join of both tables on the order id.

    That join repeats each row once per partner row of its order. The same totals come from one
    row per order and side: a side's sum times the other side's row count, or times one where
    the other side has none.
    """
    orders = _per_order(trusted, "t").join(_per_order(fact, "f"), "order_id", "full")

    def repeated(side, other):
        return F.sum(F.col(side) * F.coalesce(F.col(f"{other}_rows"), F.lit(1)))

    return orders.agg(repeated("t", "f").alias("t"), repeated("f", "t").alias("f")).select(
        _sales_report(F.col("t"), F.col("f"))
    )


def sales_by_order(trusted: DataFrame, fact: DataFrame) -> DataFrame:
    """Orders whose sales or row counts differ between the trusted and the fact table."""
    orders = _per_order(trusted, "t").join(_per_order(fact, "f"), "order_id", "full")
    none = F.lit(0)
    sides = orders.select(
        "order_id",
        F.coalesce("t_rows", none).alias("trusted_rows"),
        F.coalesce("f_rows", none).alias("fact_rows"),
        F.coalesce("t", none).alias("t"),
        F.coalesce("f", none).alias("f"),
    )
    # Compared before rounding, so that differences below a cent count.
    return sides.filter(
        (F.col("trusted_rows") != F.col("fact_rows")) | (F.col("t") != F.col("f"))
    ).select(
        "order_id", "trusted_rows", "fact_rows", *_sales_report(F.col("t"), F.col("f"))
    )


def sales_total(trusted: DataFrame, fact: DataFrame) -> DataFrame:
    """Sales totals of the two tables as they are, and the true gap; no sales count as 0."""
    amount = exact(F.col("sales"))
    both = trusted.select(amount.alias("t")).unionByName(
        fact.select(amount.alias("f")), allowMissingColumns=True
    )
    none = F.lit(0).cast(EXACT_TYPE)
    return both.agg(
        F.coalesce(F.sum("t"), none).alias("t"), F.coalesce(F.sum("f"), none).alias("f")
    ).select(_sales_report(F.col("t"), F.col("f")))


def sales_total_whole(trusted: DataFrame, fact: DataFrame) -> DataFrame:
    """sales_total with amounts of any size. The gap is a sum of its own, over both tables, so that it
    is exact where the totals themselves are too large for their cents."""
    sides = trusted.select(F.col("sales").alias("t"), F.col("sales").alias("gap")).unionByName(
        fact.select(F.col("sales").alias("f"), (-F.col("sales")).alias("gap")),
        allowMissingColumns=True,
    )
    names = ["t", "f", "gap"]
    sums = partial_sums(sides, [], {n: F.col(n) for n in names}, {})
    found = totals(sums, [], names, [], of_near=lambda near: F.round(near, 2))
    shown = ["total_sales_trusted", "total_sales_fact", "difference"]
    return found.select(
        *[F.coalesce(n, F.lit(0.0)).alias(s) for n, s in zip(names, shown, strict=True)]
    )


def money_range(trusted: DataFrame, fact: DataFrame) -> DataFrame:
    """Amounts beyond the range of the reconciliations by decimals, and so missing from them."""
    both = trusted.select(F.lit("trusted_orders").alias("table_name"), "sales", "profit").unionByName(
        fact.select(F.lit("fact_orders").alias("table_name"), "sales", "profit")
    )
    return both.groupBy("table_name").agg(
        F.count_if(beyond_exact(F.col("sales"))).alias("sales_beyond"),
        F.count_if(beyond_exact(F.col("profit"))).alias("profit_beyond"),
    )


def repeated_key(dim: DataFrame, *columns: str) -> DataFrame:
    """Key values that occur more than once."""
    return (
        dim.groupBy(*columns).agg(F.count(F.lit(1)).alias("qtd")).filter(F.col("qtd") > 1)
    )


def unique_customer_key(dim_customer: DataFrame) -> DataFrame:
    return repeated_key(dim_customer, "customer_key")


def unique_product_key(dim_product: DataFrame) -> DataFrame:
    return repeated_key(dim_product, "product_key")


def unique_geography_key(dim_geography: DataFrame) -> DataFrame:
    return repeated_key(dim_geography, "geography_key")


def unique_shipping_key(dim_shipping: DataFrame) -> DataFrame:
    return repeated_key(dim_shipping, "shipping_key")


def unique_date_key(dim_date: DataFrame) -> DataFrame:
    return repeated_key(dim_date, "date_key")


def natural_key_customer(dim_customer: DataFrame) -> DataFrame:
    """Customer ids with several members: the key above cannot repeat, the id can."""
    return repeated_key(dim_customer, "customer_id")


def natural_key_product(dim_product: DataFrame) -> DataFrame:
    return repeated_key(dim_product, "product_id")


def natural_key_geography(dim_geography: DataFrame) -> DataFrame:
    """Locations with several managers: each of them doubles the location's fact rows."""
    return repeated_key(dim_geography, *LOCATION)


def dropped_by_star_join(trusted: DataFrame) -> DataFrame:
    """Trusted rows that no fact row can come from, by the attribute that is missing."""
    required = [c for c in [*CUSTOMER, *PRODUCT, *LOCATION] if c != "postal_code"]
    missing = [F.col(c).isNull() for c in required]
    any_missing = reduce(lambda a, b: a | b, missing)
    counts = trusted.agg(
        F.count_if(any_missing).alias("any"),
        *[F.count_if(m).alias(c) for c, m in zip(required, missing)],
    )
    return counts.unpivot([], ["any", *required], "missing", "rows").filter(F.col("rows") > 0)


def volume(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("total_rows")).select(
            F.lit(name).alias("table_name"), "total_rows"
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


# -- all of them -----------------------------------------------------------------------------

REPORT = "check string, metric string, value double, passed boolean"


def _lines(one_row: DataFrame, lines: list[tuple]) -> DataFrame:
    """A report line per (check, metric, value, passed) of a single row of figures.

    What could not be computed has not passed; `passed` is None for informative lines.
    """
    none = F.lit(None).cast("boolean")
    return one_row.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(check).alias("check"),
                        F.lit(metric).alias("metric"),
                        value.cast("double").alias("value"),
                        (none if ok is None else F.coalesce(ok, F.lit(False))).alias("passed"),
                    )
                    for check, metric, value, ok in lines
                ]
            )
        )
    )


def _listed(check: str, found: DataFrame, informative: bool = False) -> DataFrame:
    """The number of rows that a listing check gives."""
    rows = F.col("rows")
    counted = found.agg(F.count(F.lit(1)).alias("rows"))
    return _lines(counted, [(check, "rows", rows, None if informative else rows == 0)])


def _raw_report(raw_orders: DataFrame, raw_returns: DataFrame, store: TableStore) -> list[DataFrame]:
    """The checks of the raw feed: one pass collapses the rows for all that compare names."""

    def known(name: str, shown=lambda c: c):
        return F.when(~is_missing(_raw(name)), shown(_raw(name)))

    rows = raw_orders.select(
        _raw("Product ID").alias("product"),
        _raw("Customer ID").alias("customer"),
        _raw("Category").alias("category"),
        known("Category", lambda c: F.upper(trim_all(c))).alias("category_name"),
        known("Customer Name").alias("customer_name"),
        known("Product Name").alias("product_name"),
        known("Sub-Category").alias("sub_category"),
    )
    kinds = {
        "category_conflict": (["product"], ["category_name"]),
        "customer_conflict": (["customer"], ["customer_name"]),
        "product_conflict": (["product"], ["product_name"]),
        "valid_subcategory": (["product", "category"], ["sub_category"]),
    }
    counted = count_kinds(rows, kinds, store, "raw")
    conflicts = [
        _listed(name, _several(counted[name], *kinds[name][:1], kinds[name][1][0]))
        for name in ("category_conflict", "customer_conflict", "product_conflict")
    ]
    pairs = counted["valid_subcategory"].groupBy("product", "category").agg(
        F.count("sub_category").alias("seen"), F.max(F.col("sub_category").isNull()).alias("missing")
    )
    negative = returned_quantities_clean(raw_orders, raw_returns).filter(
        F.col("quantity").try_cast("double") < 0
    )
    return [
        *conflicts,
        _listed("nan_profile", nan_profile(raw_orders), informative=True),
        _listed("negative_returned_quantities", negative),
        _listed("valid_subcategory", pairs.where("missing and seen > 0"), informative=True),
    ]


def _fact_report(fact: DataFrame, dims: dict[str, DataFrame], store: TableStore) -> list[DataFrame]:
    """Nulls in one pass; the keys of all dimensions, collapsed to counts, in another."""
    nulls = fact_nulls(fact)
    must_be_zero = nulls.columns[1:]
    lines = [
        ("fact_nulls", c, F.col(c), F.col(c) == 0 if c in must_be_zero else None)
        for c in nulls.columns
    ]
    lines.append(("volume", "fact_orders", F.col("total_rows"), None))

    names = {"customer": "customers", "geography": "geography", "product": "products", "shipping": "shipping"}
    keys = [*[f"{n}_key" for n in names], "order_date_key", "ship_date_key"]
    # One grouping set per key; grouping_id has a bit for each key, 0 where the set holds it.
    counted = fact.groupingSets([[c] for c in keys], *keys).agg(
        F.grouping_id().alias("set"), F.count(F.lit(1)).alias("n")
    )
    counted = store.open(store.write("fact", counted))
    full = (1 << len(keys)) - 1

    def of(key: str) -> DataFrame:
        bit = 1 << (len(keys) - 1 - keys.index(key))
        return counted.where(F.col("set") == full - bit).select(F.col(key).alias("key"), "n")

    def orphans_of(check: str, found: DataFrame, dim: DataFrame, key: str) -> DataFrame:
        known = dim.select(F.col(key).alias("key"))
        lost = found.join(known, "key", "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
        return _lines(lost, [("orphans", check, F.col("n"), F.col("n") == 0)])

    # A row without a date is no orphan.
    days = of("order_date_key").unionByName(of("ship_date_key")).where(F.col("key").isNotNull())
    return [
        _lines(nulls, lines),
        *[
            orphans_of(f"orphan_{plural}", of(f"{n}_key"), dims[f"dim_{n}"], f"{n}_key")
            for n, plural in names.items()
        ],
        orphans_of("orphan_dates", days, dims["dim_date"], "date_key"),
    ]


def _sales_lines(trusted: DataFrame, fact: DataFrame) -> list[DataFrame]:
    """All reconciliations from one row per order and side: each table is read once."""

    def side(df: DataFrame, prefix: str) -> DataFrame:
        return df.groupBy("order_id").agg(
            F.count(F.lit(1)).alias(f"{prefix}_rows"),
            F.sum(exact(F.col("sales"))).alias(prefix),
            F.count_if(beyond_exact(F.col("sales")) | beyond_exact(F.col("profit"))).alias(
                f"{prefix}_beyond"
            ),
        )

    none = F.lit(0)

    def repeated(one: str, other: str):
        return F.sum(F.col(one) * F.coalesce(F.col(f"{other}_rows"), F.lit(1)))

    def known(c: str):
        return F.coalesce(F.col(c), none)

    figures = side(trusted, "t").join(side(fact, "f"), "order_id", "full").agg(
        repeated("t", "f").alias("joined_t"),
        repeated("f", "t").alias("joined_f"),
        F.coalesce(F.sum("t"), none.cast(EXACT_TYPE)).alias("total_t"),
        F.coalesce(F.sum("f"), none.cast(EXACT_TYPE)).alias("total_f"),
        F.count_if((known("t_rows") != known("f_rows")) | (known("t") != known("f"))).alias("differ"),
        F.coalesce(F.sum("t_beyond"), none).alias("t_beyond"),
        F.coalesce(F.sum("f_beyond"), none).alias("f_beyond"),
    )
    lines = []
    for check, a, b in (("sales_faithful", "joined_t", "joined_f"), ("sales_total", "total_t", "total_f")):
        t, f, gap = _sales_report(F.col(a), F.col(b))
        lines += [
            (check, "total_sales_trusted", t, None),
            (check, "total_sales_fact", f, None),
            (check, "difference", gap, gap == 0),
        ]
    beyond = sum((F.col(c) > 0).cast("int") for c in ("t_beyond", "f_beyond"))
    lines += [
        ("sales_by_order", "rows", F.col("differ"), F.col("differ") == 0),
        ("money_range", "rows", beyond, beyond == 0),
    ]
    return [
        _lines(figures, lines),
        _listed("dropped_by_star_join", dropped_by_star_join(trusted)),
    ]


def _dim_report(dims: dict[str, DataFrame]) -> list[DataFrame]:
    """Repeated keys and volume of each dimension from one count by key; repeated natural keys."""
    out = []
    for name, dim in dims.items():
        short = name.removeprefix("dim_")
        counts = dim.groupBy(f"{short}_key").agg(F.count(F.lit(1)).alias("n")).agg(
            F.count_if(F.col("n") > 1).alias("repeated"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        )
        lines = [
            (f"unique_{short}_key", "rows", F.col("repeated"), F.col("repeated") == 0),
            ("volume", name, F.col("rows"), None),
        ]
        out.append(_lines(counts, lines))
    natural = {
        "customer": natural_key_customer, "product": natural_key_product,
        "geography": natural_key_geography,
    }
    return out + [
        _listed(f"natural_key_{short}", check(dims[f"dim_{short}"]))
        for short, check in natural.items()
    ]


def run_checks(
    spark: SparkSession,
    raw_orders: DataFrame,
    raw_returns: DataFrame,
    trusted: DataFrame,
    dims: dict[str, DataFrame],
    fact: DataFrame,
) -> DataFrame:
    """One row per check: (check, metric, value, passed); passed is NULL for the informative ones.

    A listing check contributes its row count, a counting one its counters. The checks of a table
    share its scans (two of raw and trusted, three of the fact), and the report, which has a fixed
    number of lines, is complete when this returns: its intermediate tables are gone by then.
    """
    store = TableStore(spark, scratch_root(spark, "checks"))
    try:
        groups = {
            "raw": lambda: _raw_report(raw_orders, raw_returns, store),
            "fact": lambda: _fact_report(fact, dims, store),
            "sales": lambda: _sales_lines(trusted, fact),
            "dims": lambda: _dim_report(dims),
        }
        with shuffles_go(spark):
            found = in_parallel(
                {
                    name: (lambda parts=parts: reduce(DataFrame.unionByName, parts()).collect())
                    for name, parts in groups.items()
                }
            )
    finally:
        store.drop_all()
    return spark.createDataFrame([row for rows in found.values() for row in rows], REPORT)
