"""Adapter: derives the dirty three-sheet feed from the order tables of a sales benchmark.

The feed plants the faults that the cleaning rules are about: missing cells, six date spellings,
money marks, region spellings, variant product names, categories, customer names and segments, order
ids with and without a stray blank, negative and half quantities, negative discounts, two managers
in one region, and exact copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the planted spellings.
DATE_SPELLINGS = [
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MM-dd-yyyy", "dd/MM/yyyy", "dd-MMM-yyyy", "MMM dd yyyy",
]
SHIP_MODES = {"1-URGENT": "Same Day", "2-HIGH": "First Class", "3-MEDIUM": "Second Class"}
OTHER_SHIP_MODE = "standard class "
REGION_SPELLINGS = {  # region key: spelling for even and odd order keys
    0: ("Ctr", "Central Region"),
    1: ("East Region", "East"),
    2: ("Sth", "south "),
    3: ("WST", "WST"),
    4: ("North", "North"),
}
# Columns of the orders that are spelled before copies are made.
SPELLED_FIRST = ["Order Date", "Ship Date", "Sales", "Quantity", "Discount", "Profit"]
PEOPLE_REGIONS = {0: "Ctr", 1: "EAST", 2: "South Region", 3: "wst", 4: "North"}


def _text(c: Column) -> Column:
    return c.cast("string")


def _nan_when(condition: Column, otherwise: Column) -> Column:
    return F.when(condition, "nan").otherwise(otherwise)


def _spelled_date(d: Column, turn: Column) -> Column:
    result = F.when(turn == 0, F.date_format(d, DATE_SPELLINGS[0]))
    for i, spelling in enumerate(DATE_SPELLINGS[1:], start=1):
        result = result.when(turn == i, F.date_format(d, spelling))
    return result.otherwise("NaT")


def _ship_mode(line: Column, priority: Column) -> Column:
    result = F.when(line % 4 == 0, "").when(line % 4 == 1, "nan")
    for name, mode in SHIP_MODES.items():
        result = result.when(priority == name, mode)
    return result.otherwise(OTHER_SHIP_MODE)


def _region(region_key: Column, even: Column) -> Column:
    return F.coalesce(
        *[
            F.when((region_key == key) & even, on_even).when(region_key == key, on_odd)
            for key, (on_even, on_odd) in REGION_SPELLINGS.items()
        ]
    )


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item, plus an exact copy of each row whose part key ends in 7."""

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    # Orders meet their customer before the lines, so that lines are not shuffled for a customer. Lines
    # meet their order last: the rows of an order then lie together in the table, and what they have in
    # common is small in its files and in every shuffle after it. The join with the orders needs the
    # partitioning by their key for large tables anyway; a source of a few files is spread over all
    # cores by it.
    customers = table("customer").join(
        table("nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    orders = table("orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    rows = (
        table("lineitem")
        .join(table("part"), F.col("l_partkey") == F.col("p_partkey"))
        .repartition("l_orderkey")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    )
    order, line = F.col("l_orderkey"), F.col("l_linenumber")
    customer, part = F.col("c_custkey"), F.col("p_partkey")
    even = order % 2 == 0
    plain_sales = _text(F.col("l_extendedprice").cast("decimal(12,2)"))
    discount = F.col("l_discount").cast("decimal(5,2)")
    quantity = F.col("l_quantity")
    variant = F.when(part % 5 == 0, even).otherwise(order % 9 == 0)
    columns = {
        "Row ID": _text(order * 10 + line),
        "Order ID": _nan_when(
            order % 97 == 0,
            F.concat(F.when(order % 9 == 0, "ORD-").otherwise(" ORD-"), _text(order)),
        ),
        "Order Date": _spelled_date(F.col("o_orderdate").cast("date"), order % 7),
        "Ship Date": _spelled_date(F.col("l_shipdate").cast("date"), (order + line) % 7),
        "Ship Mode": _ship_mode(line, F.col("o_orderpriority")),
        "Customer ID": F.concat(F.lit("C-"), _text(customer)),
        "Customer Name": _nan_when(
            F.col("l_partkey") % 11 == 0,
            F.when(order % 43 == 0, F.concat("c_name", F.lit(" Jr"))).otherwise(F.col("c_name")),
        ),
        "Segment": _nan_when(
            customer % 61 == 0, F.when(order % 47 == 0, "OTHER").otherwise(F.col("c_mktsegment"))
        ),
        "Country/Region": F.when(F.col("n_regionkey") != 1, F.col("n_name"))
        .when(F.col("n_nationkey") % 2 == 0, "United States")
        .otherwise("Canada"),
        "City": F.concat(F.lit("City "), _text(customer % 40)),
        "State/Province": F.col("n_name"),
        "Postal Code": F.when(F.col("l_suppkey") % 13 == 0, "nan")
        .when(order % 50 == 0, "99999")
        .otherwise(_text(customer % 40 + 10000)),
        "Region": _region(F.col("n_regionkey"), even),
        "Product ID": F.concat(F.lit("P-"), _text(part)),
        "Category": _nan_when(
            line % 6 == 0,
            F.when(order % 41 == 0, F.concat("p_type", F.lit(" X"))).otherwise(F.col("p_type")),
        ),
        "Sub-Category": F.when(line % 5 == 0, " ").otherwise(F.col("p_brand")),
        "Product Name": F.when(variant, F.concat(F.col("p_name"), F.lit(" (alt)"))).otherwise(
            F.col("p_name")
        ),
        "Sales": F.when(
            order % 3 == 0,
            F.concat(F.lit("$"), F.format_number(F.col("l_extendedprice"), 2)),
        ).otherwise(plain_sales),
        "Quantity": _text(
            F.when(order % 101 == 0, -quantity)
            .when(order % 103 == 0, quantity + 0.5)
            .otherwise(quantity)
            .cast("decimal(6,1)")
        ),
        "Discount": _text(F.when(line % 5 == 0, -discount).otherwise(discount)),
        "Profit": _nan_when(
            F.col("l_partkey") % 53 == 0,
            _text(
                F.floor(F.col("l_extendedprice") * (F.col("l_discount") - F.col("l_tax"))).cast(
                    "long"
                )
            ),
        ),
    }
    copies = F.when(part % 10 == 7, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    # The copies are made between two steps: cells that take much code are spelled before it, once
    # per line, the others after it. In one step their code would exceed 8000 bytes, beyond which the
    # JVM only interprets it.
    before = {name: columns[name] for name in SPELLED_FIRST}
    spelled = rows.select("*", *[c.alias(name) for name, c in before.items()])
    copied = spelled.select("*", F.explode(copies).alias("copy"))
    return copied.select(
        [F.col(f"`{name}`") if name in before else c.alias(name) for name, c in columns.items()]
    )


def raw_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return marks per line item, so several rows per order."""
    line = F.col("l_linenumber")
    return (
        spark.read.parquet(f"{sf_dir}/lineitem.parquet")
        .filter((F.col("l_returnflag") == "R") & (F.col("l_orderkey") % 3 == 0))
        .select(
            F.when(line % 7 == 0, "No").when(line % 2 == 0, "yes ").otherwise("Yes").alias(
                "Returned"
            ),
            F.concat(F.lit("ORD-"), _text(F.col("l_orderkey"))).alias("Order ID"),
        )
    )


def raw_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manager per region and a second one in the West, plus two entries that cleaning removes."""
    key = F.col("r_regionkey")
    spelled = F.coalesce(*[F.when(key == k, name) for k, name in PEOPLE_REGIONS.items()])
    managers = spark.read.parquet(f"{sf_dir}/region.parquet").select(
        F.concat(F.lit("Mgr "), F.col("r_name")).alias("Regional Manager"),
        spelled.alias("Region"),
    )
    others = spark.createDataFrame(
        [("Temporary Manager", "West"), ("nan", "East"), ("Second Manager", "West")],
        managers.schema,
    )
    return managers.unionByName(others)


def sheets(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "Orders": raw_orders(spark, sf_dir),
        "People": raw_people(spark, sf_dir),
        "Returns": raw_returns(spark, sf_dir),
    }
