"""Refined layer: five dimensions and one fact table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silvermart import schemas
from silvermart.functions import date_key, iso_day_of_week, round_cents
from silvermart.operators.attach import (
    Lookup,
    attach_all,
    hot_among,
    hot_keys,
    stored_lookup,
    with_row_tag,
)
from silvermart.operators.dense_key import numbered, slices
from silvermart.sources.store import TableStore, in_parallel

# By dimension its members with `n`, the trusted rows that have them; for fact_orders.
Counts = dict[str, DataFrame]

# The member that stands for a missing ship mode, and the columns by which an order
# row finds its member. The location is matched without the manager.
NO_SHIP_MODE = "N/A"
CUSTOMER = ["customer_id", "customer_name", "segment"]
PRODUCT = ["product_id", "product_name", "category", "sub_category"]
LOCATION = ["country", "region", "state", "city", "postal_code"]
SHIPPING = ["ship_mode"]


def _ship_mode():
    return F.coalesce(F.col("ship_mode"), F.lit(NO_SHIP_MODE))


def _dimension(
    trusted: DataFrame,
    columns: list[str],
    required: str,
    name: str,
    store: TableStore,
    counts: Counts | None,
) -> DataFrame:
    """The members, numbered; with `counts` their rows are noted there, counted on the way."""
    members = (
        trusted.filter(F.col(required).isNotNull()).groupBy(columns).agg(F.count(F.lit(1)).alias("n"))
    )
    key = f"{name}_key"
    stored = store.open(slices(members, columns, store, key))
    if counts is not None:
        counts[f"dim_{name}"] = stored.select(*columns, "n")
    return numbered(stored, columns, key)


def dim_customer(
    trusted: DataFrame, store: TableStore, counts: Counts | None = None
) -> DataFrame:
    """One row per customer id, name and segment."""
    return _dimension(trusted, CUSTOMER, "customer_id", "customer", store, counts)


def dim_product(trusted: DataFrame, store: TableStore, counts: Counts | None = None) -> DataFrame:
    """One row per product id, canonical name and category pair."""
    return _dimension(trusted, PRODUCT, "product_id", "product", store, counts)


def dim_geography(
    trusted: DataFrame, store: TableStore, counts: Counts | None = None
) -> DataFrame:
    """One row per location and manager."""
    columns = [*LOCATION, "regional_manager"]
    return _dimension(trusted, columns, "country", "geography", store, counts)


def dim_shipping(
    trusted: DataFrame, store: TableStore, counts: Counts | None = None
) -> DataFrame:
    """One row per ship mode, with a member for orders that have none."""
    modes = trusted.select(_ship_mode().alias("ship_mode"))
    return _dimension(modes, SHIPPING, "ship_mode", "shipping", store, counts)


def dim_date(
    trusted: DataFrame, store: TableStore | None = None, counts: Counts | None = None
) -> DataFrame:
    """Every day from the first to the last order or ship date.

    Dates have four-digit years, so the calendar is at most a few million rows.
    """
    bounds = trusted.agg(
        F.least(F.min("order_date"), F.min("ship_date")).alias("first"),
        F.greatest(F.max("order_date"), F.max("ship_date")).alias("last"),
    )
    day = F.col("full_date")
    quarter = F.quarter(day).cast("string")
    return bounds.select(
        F.explode(F.sequence("first", "last", F.expr("interval 1 day"))).alias("full_date")
    ).select(
        date_key(day).alias("date_key"),
        day,
        F.dayofmonth(day).alias("day_of_month"),
        iso_day_of_week(day).alias("day_of_week"),
        F.date_format(day, "EEEE").alias("day_name"),
        F.weekofyear(day).alias("week_of_year"),
        F.month(day).alias("month_number"),
        F.date_format(day, "MMMM").alias("month_name"),
        F.quarter(day).alias("quarter"),
        F.concat(F.lit("Q"), quarter, F.lit(" "), F.year(day).cast("string")).alias(
            "quarter_label"
        ),
        F.year(day).alias("year"),
        F.date_format(day, "yyyy-MM").alias("year_month"),
        (iso_day_of_week(day) >= 6).alias("is_weekend"),
    )


DIMENSIONS = {
    "dim_customer": dim_customer,
    "dim_product": dim_product,
    "dim_geography": dim_geography,
    "dim_shipping": dim_shipping,
    "dim_date": dim_date,
}
# Those whose members the fact looks up.
KEYED = [name for name in DIMENSIONS if name != "dim_date"]


def fact_orders(
    trusted: DataFrame,
    dims: dict[str, DataFrame],
    store: TableStore,
    shuffled: bool = False,
    sizes: dict[str, int] | None = None,
    counts: Counts | None = None,
) -> DataFrame:
    """One row per trusted row that finds a member in all four keyed dimensions.

    The match is by plain equality, so a row with a missing name, segment, category, region,
    state or city has no member and is left out; only postal code and ship mode may be missing.
    `trusted` and `dims` are stored tables: keys are dense, so they must not be computed again
    between the dimension and the fact. With `shuffled` every dimension goes the way of large ones.
    `sizes` are the bytes of the dimensions as their writes have measured them, `counts` the rows of
    their members as their builds have counted them; what is not given is taken from the tables.
    """
    postal = F.coalesce(F.col("postal_code"), F.lit(""))
    matches = {
        "geography": (
            dims["dim_geography"].select("geography_key", *LOCATION).withColumn(
                "postal_code", postal
            ),
            LOCATION,
        ),
        "shipping": (dims["dim_shipping"], SHIPPING),
        "product": (dims["dim_product"], PRODUCT),
        "customer": (dims["dim_customer"], CUSTOMER),
    }
    lookups = in_parallel(
        {
            name: (lambda name=name, members=members, on=on: stored_lookup(
                store, f"match_{name}", members, on, (sizes or {}).get(f"dim_{name}")
            ))
            for name, (members, on) in matches.items()
        }
    )
    keyed = trusted.withColumns({"postal_code": postal, "ship_mode": _ship_mode()})
    rows = with_row_tag(keyed).dropna(subset=[*CUSTOMER, *PRODUCT, *LOCATION])

    def hot(lookup: Lookup) -> DataFrame:
        dim = lookup.name.replace("match_", "dim_")
        if dim not in (counts or {}):
            return hot_keys(keyed, lookup.on, store)
        counted = counts[dim]
        if "postal_code" in lookup.on:
            counted = counted.withColumn("postal_code", postal)
        return hot_among(counted, lookup.on)

    rows = attach_all(rows, list(lookups.values()), hot, shuffled)
    return rows.dropna(subset=[f"{name}_key" for name in lookups]).select(
        "order_id",
        date_key(F.col("order_date")).alias("order_date_key"),
        date_key(F.col("ship_date")).alias("ship_date_key"),
        *[f"{name}_key" for name in ("customer", "product", "geography", "shipping")],
        *["sales", "quantity", "discount", "profit", "is_returned"],
        F.datediff("ship_date", "order_date").cast("long").alias("delivery_days"),
        round_cents(F.col("sales") * F.col("discount")).alias("discount_amount"),
    ).select(schemas.FACT_ORDERS.names)
