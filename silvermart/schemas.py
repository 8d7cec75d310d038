"""Column layouts of the raw, trusted and refined layers."""

from __future__ import annotations

from pyspark.sql import types as T

# Headers of the three source sheets and the columns of each output table.
RAW_ORDERS_COLUMNS = [
    "Row ID", "Order ID", "Order Date", "Ship Date", "Ship Mode", "Customer ID", "Customer Name",
    "Segment", "Country/Region", "City", "State/Province", "Postal Code", "Region", "Product ID",
    "Category", "Sub-Category", "Product Name", "Sales", "Quantity", "Discount", "Profit",
]
RAW_RETURNS_COLUMNS = ["Returned", "Order ID"]
RAW_PEOPLE_COLUMNS = ["Regional Manager", "Region"]

TRUSTED_COLUMNS = """
    order_id string, customer_id string, customer_name string, product_id string,
    order_date date, ship_date date, ship_mode string, segment string, country string,
    city string, state string, postal_code string, region string, category string,
    sub_category string, product_name string, product_name_original string,
    sales double, quantity int, discount double, profit double,
    is_returned int, regional_manager string
"""
DIM_CUSTOMER_COLUMNS = "customer_key int, customer_id string, customer_name string, segment string"
DIM_PRODUCT_COLUMNS = (
    "product_key int, product_id string, product_name string, category string, sub_category string"
)
DIM_GEOGRAPHY_COLUMNS = (
    "geography_key int, country string, region string, state string, city string, "
    "postal_code string, regional_manager string"
)
DIM_SHIPPING_COLUMNS = "shipping_key int, ship_mode string"
DIM_DATE_COLUMNS = """
    date_key int, full_date date, day_of_month int, day_of_week int, day_name string,
    week_of_year int, month_number int, month_name string, quarter int, quarter_label string,
    year int, year_month string, is_weekend boolean
"""
FACT_COLUMNS = """
    order_id string, order_date_key int, ship_date_key int, customer_key int, product_key int,
    geography_key int, shipping_key int, sales double, quantity int, discount double,
    profit double, is_returned int, delivery_days bigint, discount_amount double
"""


TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "date": T.DateType(),
    "boolean": T.BooleanType(),
}


def layout(columns: str) -> T.StructType:
    """'name type, ...' as a schema; unlike the DDL parser this needs no running session."""
    pairs = [entry.split() for entry in columns.split(",")]
    return T.StructType([T.StructField(name, TYPES[kind]) for name, kind in pairs])


def all_strings(columns: list[str]) -> T.StructType:
    """The raw layer keeps every column as text."""
    return T.StructType([T.StructField(name, T.StringType()) for name in columns])


RAW_ORDERS = all_strings(RAW_ORDERS_COLUMNS)
RAW_RETURNS = all_strings(RAW_RETURNS_COLUMNS)
RAW_PEOPLE = all_strings(RAW_PEOPLE_COLUMNS)

TRUSTED_ORDERS = layout(TRUSTED_COLUMNS)
DIM_CUSTOMER = layout(DIM_CUSTOMER_COLUMNS)
DIM_PRODUCT = layout(DIM_PRODUCT_COLUMNS)
DIM_GEOGRAPHY = layout(DIM_GEOGRAPHY_COLUMNS)
DIM_SHIPPING = layout(DIM_SHIPPING_COLUMNS)
DIM_DATE = layout(DIM_DATE_COLUMNS)
FACT_ORDERS = layout(FACT_COLUMNS)
