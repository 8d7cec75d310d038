"""Trusted layer: the raw text tables cleaned, repaired, joined and deduplicated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silvermart import schemas
from silvermart.functions import (
    blank_to_null,
    clean_text,
    is_present,
    normalize_region,
    parse_date,
    parse_money,
    parse_number,
    prefix_region,
    trim_all,
    upper_to_null,
    whole,
)
from silvermart.operators.attach import (
    ROW_TAG,
    Lookup,
    attach,
    attach_all,
    hot_among,
    hot_keys,
    is_large,
    store_lookup,
    tag_by,
)
from silvermart.operators.donors import (
    count_kinds,
    fill_name,
    filled,
    max_donors,
    max_donors_of,
    mode_donors,
    mode_donors_of,
    overwritten,
)
from silvermart.sources.store import TableStore, in_parallel

# Raw column behind each cleaned one, by kind of cleaning; the return mark; and the
# placeholder manager that the people sheet carries.
ID_COLUMNS = {"order_id": "Order ID"}
PLAIN_COLUMNS = {
    "customer_id": "Customer ID",
    "product_id": "Product ID",
    "segment": "Segment",
    "country": "Country/Region",
    "city": "City",
    "state": "State/Province",
    "postal_code": "Postal Code",
    "region": "Region",
    "product_name": "Product Name",
    "customer_name": "Customer Name",
}
UPPER_COLUMNS = {
    "ship_mode": "Ship Mode",
    "category": "Category",
    "sub_category": "Sub-Category",
}
DATE_COLUMNS = {"order_date": "Order Date", "ship_date": "Ship Date"}
MONEY_COLUMNS = {"sales": "Sales", "profit": "Profit"}
NUMBER_COLUMNS = {"quantity": "Quantity", "discount": "Discount"}
RETURNED = "YES"
PLACEHOLDER_MANAGER = "Temporary Manager"

LOCATION = ["country", "state", "city"]


# -- the three feeds -------------------------------------------------------------------------


def clean_orders(raw_orders: DataFrame) -> DataFrame:
    """Typed columns from the raw text; rows without an order id are left out."""
    kinds = [
        (ID_COLUMNS, lambda c: trim_all(F.trim(c)), blank_to_null),
        (PLAIN_COLUMNS, trim_all, blank_to_null),
        (UPPER_COLUMNS, trim_all, upper_to_null),
        (DATE_COLUMNS, trim_all, parse_date),
        (MONEY_COLUMNS, trim_all, parse_money),
        (NUMBER_COLUMNS, trim_all, parse_number),
    ]
    # Trimming is a step of its own: every rule mentions its input more than once, so the
    # optimizer keeps the two steps apart, trims each value once and compiles each step as a
    # method of its own. Each stays below 8000 bytes of generated code, beyond which the JVM
    # would only interpret it.
    trimmed = raw_orders.select(
        [
            trim(F.col(f"`{raw}`")).alias(name)
            for columns, trim, _ in kinds
            for name, raw in columns.items()
        ]
    )
    return trimmed.filter(is_present(F.col("order_id"))).select(
        [rule(F.col(name)).alias(name) for columns, _, rule in kinds for name in columns]
    )


def clean_returns(raw_returns: DataFrame) -> DataFrame:
    """Distinct ids of the returned orders."""
    return (
        raw_returns.filter(F.upper(trim_all(F.col("Returned"))) == RETURNED)
        .select(clean_text(F.col("`Order ID`")).alias("order_id"))
        .filter(F.col("order_id").isNotNull())
        .distinct()
    )


def clean_people(raw_people: DataFrame) -> DataFrame:
    """Managers and their normalized region, without the placeholder and without blanks."""
    return (
        raw_people.select(
            clean_text(F.col("`Regional Manager`")).alias("regional_manager"),
            clean_text(F.col("Region")).alias("region"),
        )
        .filter(F.col("region").isNotNull() & (F.col("regional_manager") != PLACEHOLDER_MANAGER))
        .withColumn("region", normalize_region(F.col("region")))
    )


def one_manager_per_region(people: DataFrame) -> DataFrame:
    """Corrected variant of the people table: the first manager by name, so no order doubles."""
    return people.groupBy("region").agg(F.min("regional_manager").alias("regional_manager"))


# -- repairs ---------------------------------------------------------------------------------


def _repair(
    rows: DataFrame, donors: DataFrame, keys: list[str], store: TableStore, name: str
) -> DataFrame:
    lookup = store_lookup(store, name, donors, keys)
    return attach(rows, lookup, lambda: hot_keys(rows, keys, store))


def fill_by_key(
    rows: DataFrame, keys: list[str], columns: list[str], store: TableStore
) -> DataFrame:
    """Missing values from other rows with the same key: the largest value there.

    `rows` is a scan that with_row_tag has numbered, here and in the next two operators.
    """
    donors = max_donors(rows, keys, columns)
    return filled(_repair(rows, donors, keys, store, "fill_" + "_".join(columns)), *columns)


def fill_by_mode(rows: DataFrame, keys: list[str], column: str, store: TableStore) -> DataFrame:
    """Missing values from the most frequent value of the same key."""
    donors = mode_donors(rows, keys, column)
    return filled(_repair(rows, donors, keys, store, f"mode_{column}"), column)


def canonicalize_by_mode(
    rows: DataFrame, keys: list[str], column: str, store: TableStore
) -> DataFrame:
    """Every value replaced by the key's most frequent one; the old value stays beside it."""
    donors = mode_donors(rows, keys, column, overwrite=True)
    attached = _repair(rows, donors, keys, store, f"canonical_{column}")
    return overwritten(attached, column, f"{column}_original")


def order_lookup(ship_modes: DataFrame, returned: DataFrame) -> DataFrame:
    """Ship mode repair and return flag in one table, so the orders meet their key once."""
    both = ship_modes.withColumn("returned", F.lit(0)).unionByName(
        returned.withColumn("returned", F.lit(1)), allowMissingColumns=True
    )
    fill = fill_name("ship_mode")
    return both.groupBy("order_id").agg(
        F.max(fill).alias(fill), F.max("returned").alias("returned")
    )


def flag_returns(
    rows: DataFrame, returned: DataFrame, people: DataFrame, store: TableStore
) -> DataFrame:
    """Return mark per order and manager per region; `rows` has the normalized region.

    A region with two managers doubles its rows, see one_manager_per_region.
    """
    marks = returned.withColumn("is_returned", F.lit(1))
    rows = _repair(rows, marks, ["order_id"], store, "returns")
    rows = _repair(rows, people, ["region"], store, "people")
    return rows.withColumn("is_returned", F.coalesce(F.col("is_returned"), F.lit(0)))


# -- the whole layer -------------------------------------------------------------------------


def dedup_exact(rows: DataFrame) -> DataFrame:
    """Each row once, by all its columns; NULLs are equal.

    `rows` may carry ROW_TAG, see repaired_orders. Equal rows have one tag, so a distinct with the tag
    gives the same rows as one without, and needs no shuffle where the rows lie by their tags already.
    """
    return rows.distinct().drop(ROW_TAG)


def trusted_orders(
    raw_orders: DataFrame,
    raw_returns: DataFrame,
    raw_people: DataFrame,
    store: TableStore,
    shuffled: bool = False,
) -> DataFrame:
    """The trusted table; with `shuffled` every lookup goes the way of the large ones.

    Exact duplicates count as such by the quantity as it was written, before it is rounded.
    """
    rows = _repaired(raw_orders, raw_returns, raw_people, store, shuffled, once=True)
    return dedup_exact(rows).withColumns(
        {
            "quantity": whole(F.col("quantity")),
            "region": prefix_region(F.col("country"), F.col("region")),
        }
    )


def repaired_orders(
    raw_orders: DataFrame,
    raw_returns: DataFrame,
    raw_people: DataFrame,
    store: TableStore,
    shuffled: bool = False,
    tagged: bool = False,
) -> DataFrame:
    """Cleaned rows with every repair and join done, duplicates still among them.

    `raw_orders` is a stored table. One pass over it counts the keys and values of all lookups, the
    main pass reads it once more. Where the lookups are small enough to broadcast, the final
    distinct is the only shuffle of whole rows. Where they are not, a third pass takes the keys to
    them, and whole rows are shuffled by a hash of their order id, see tag_by; the order's own lookup
    and the distinct of the trusted table then find them together, so whole rows move once either way.
    With `tagged` that hash stays in the rows as ROW_TAG, if they were shuffled by it, for dedup_exact.
    """
    rows = _repaired(raw_orders, raw_returns, raw_people, store, shuffled)
    return rows if tagged else rows.select(schemas.TRUSTED_ORDERS.names)


def _repaired(
    raw_orders: DataFrame,
    raw_returns: DataFrame,
    raw_people: DataFrame,
    store: TableStore,
    shuffled: bool,
    once: bool = False,
) -> DataFrame:
    """repaired_orders, with the tag by which the rows lie if a lookup was large.

    With `once` copies of a row may be left out, and those in an order of very many rows are, before
    they would meet in one task.
    """
    base = clean_orders(raw_orders).withColumn("region", normalize_region(F.col("region")))
    people = store_lookup(store, "people", clean_people(raw_people), LOOKUP_COLUMNS["people"][0])
    # Regions repair nothing, and are counted only where their weight matters.
    kinds = {n: k for n, k in LOOKUP_COLUMNS.items() if n != "people" or is_large(people, shuffled)}
    counted = count_kinds(base, kinds, store, "counted")
    lookups = build_lookups(counted, clean_returns(raw_returns), people, store)

    def hot(lookup: Lookup) -> DataFrame:
        return hot_among(counted[lookup.name].withColumnRenamed("freq", "n"), lookup.on)

    rows = base.withColumn("discount", F.abs(F.col("discount")))
    tag = [ROW_TAG] if any(is_large(x, shuffled) for x in lookups.values()) else []
    tagged = {}
    if tag:
        heavy = store.write("heavy_orders", hot(lookups["order"]))
        if once and heavy.rows:
            # Fewer rows than PIECES times the shuffle partitions.
            ids = F.broadcast(store.open(heavy).select("order_id"))
            rows = rows.join(ids, "order_id", "left_anti").unionByName(
                rows.join(ids, "order_id", "left_semi").distinct()
            )
        # No repair changes a key, so rows that are equal in the end have one tag.
        keys = [c for on, _ in LOOKUP_COLUMNS.values() for c in on]
        salts = store.open(heavy) if heavy.rows else None
        rows, orders = tag_by(rows, lookups["order"], salts, keys)
        tagged = {"order": orders}
    rows = attach_all(
        rows, list(lookups.values()), hot, shuffled, shared_tags=True, tagged=tagged
    )
    rows = filled(rows, "ship_mode", "customer_name", "postal_code", "category", "sub_category")
    rows = overwritten(rows, "product_name", "product_name_original")
    rows = rows.withColumn("is_returned", F.coalesce(F.col("returned"), F.lit(0)))

    return rows.select(*schemas.TRUSTED_ORDERS.names, *tag)


# By lookup its key and the columns that it repairs.
LOOKUP_COLUMNS = {
    "people": (["region"], []),
    "location": (LOCATION, ["postal_code"]),
    "product": (["product_id"], ["product_name", "category", "sub_category"]),
    "customer": (["customer_id"], ["customer_name"]),
    "order": (["order_id"], ["ship_mode"]),
}


def build_lookups(
    counted: dict[str, DataFrame], returned: DataFrame, people: Lookup, store: TableStore
) -> dict[str, Lookup]:
    """Every lookup reads the cleaned rows, never a column that another lookup has repaired."""
    donors = {
        "location": mode_donors_of(counted["location"], LOCATION, "postal_code"),
        "product": mode_donors_of(
            counted["product"],
            ["product_id"],
            "product_name",
            overwrite=True,
            max_columns=("category", "sub_category"),
        ),
        "customer": max_donors_of(counted["customer"], ["customer_id"], ["customer_name"]),
        "order": order_lookup(
            max_donors_of(counted["order"], ["order_id"], ["ship_mode"]), returned
        ),
    }
    stored = in_parallel(
        {
            name: (lambda name=name, df=df: store_lookup(store, name, df, LOOKUP_COLUMNS[name][0]))
            for name, df in donors.items()
        }
    )
    return {"people": people, **stored}
