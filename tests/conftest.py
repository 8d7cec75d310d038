from __future__ import annotations

import pytest

from silvermart import schemas
from silvermart.session import local_session
from silvermart.sources.store import TableStore

DATA = "/root/testdata/sf0.001"

# One clean order row; tests change the cells they are about.
ORDER = {
    "Row ID": "1", "Order ID": "O-1", "Order Date": "2020-01-05", "Ship Date": "2020-01-07",
    "Ship Mode": "First Class", "Customer ID": "C-1", "Customer Name": "Ann", "Segment": "Home",
    "Country/Region": "United States", "City": "Troy", "State/Province": "New York",
    "Postal Code": "12180", "Region": "East", "Product ID": "P-1", "Category": "Chairs",
    "Sub-Category": "Stools", "Product Name": "Stool", "Sales": "10.00", "Quantity": "2",
    "Discount": "0.1", "Profit": "1.50",
}


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    warehouse = str(tmp_path_factory.mktemp("warehouse"))
    return local_session(
        "tests",
        "4",
        **{"spark.sql.shuffle.partitions": "4", "spark.sql.warehouse.dir": warehouse},
    )


@pytest.fixture
def store(spark, tmp_path):
    return TableStore(spark, str(tmp_path / "store"))


@pytest.fixture
def no_broadcast(spark):
    """Lookups of any size take the path of the large ones."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


def stored(store, name, rows, schema):
    return store.materialize(name, store.spark.createDataFrame(rows, schema))


def raw_orders(store, *changes: dict):
    rows = [tuple({**ORDER, **c}[name] for name in schemas.RAW_ORDERS_COLUMNS) for c in changes]
    return stored(store, "raw_orders", rows, schemas.RAW_ORDERS)


def raw_returns(store, *rows):
    return stored(store, "raw_returns", list(rows), schemas.RAW_RETURNS)


def raw_people(store, *rows):
    return stored(store, "raw_people", list(rows), schemas.RAW_PEOPLE)


def trusted_rows(store, changes, returns=(), people=(("Mia", "East"),)):
    from silvermart.plans.trusted import trusted_orders

    return trusted_orders(
        raw_orders(store, *changes), raw_returns(store, *returns), raw_people(store, *people), store
    )


def rows_of(df, *columns):
    """Rows as tuples in a fixed order, NULLs first."""
    found = [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
    return sorted(found, key=lambda row: [(v is not None, str(v)) for v in row])
