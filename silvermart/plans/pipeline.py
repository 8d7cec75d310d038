"""Full refresh: land the three sheets, build the trusted table, the dimensions, then the fact."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from silvermart import schemas
from silvermart.plans import checks, star
from silvermart.plans.trusted import trusted_orders
from silvermart.sources.landing import land_all
from silvermart.sources.store import SMALL, StoredTable, TableStore, in_parallel, scratch_root

TRUSTED = "trusted/trusted_orders"

# Path of each refined table below the store's root, and its columns.
REFINED = {
    "dim_customer": ("refined/dim_customer", schemas.DIM_CUSTOMER),
    "dim_product": ("refined/dim_product", schemas.DIM_PRODUCT),
    "dim_geography": ("refined/dim_geography", schemas.DIM_GEOGRAPHY),
    "dim_shipping": ("refined/dim_shipping", schemas.DIM_SHIPPING),
    "dim_date": ("refined/dim_date", schemas.DIM_DATE),
    "fact_orders": ("refined/fact_orders", schemas.FACT_ORDERS),
}


@dataclass
class Layers:
    """The stored tables of one run."""

    raw_orders: DataFrame
    raw_returns: DataFrame
    raw_people: DataFrame
    trusted: DataFrame
    dims: dict[str, DataFrame]
    fact: DataFrame
    report: list[dict]
    deleted: int = 0  # versions that the run's publication has replaced or cleaned up

    def checks(self, spark: SparkSession) -> DataFrame:
        return checks.run_checks(
            spark, self.raw_orders, self.raw_returns, self.trusted, self.dims, self.fact
        )

    def publish_views(self) -> list[str]:
        """Name the trusted and refined tables as temporary views of the session."""
        views = {"trusted_orders": self.trusted, **self.dims, "fact_orders": self.fact}
        for name, df in views.items():
            df.createOrReplaceTempView(name)
        return list(views)


def write(store: TableStore, name: str, df: DataFrame) -> tuple[StoredTable, dict]:
    """Write the next version of a table."""
    table = store.write(name, df, compression=SMALL)
    return table, {"table": name.split("/")[-1], "location": table.path, "rows": table.rows}


def build_dimensions(
    trusted: DataFrame,
    store: TableStore,
    scratch: TableStore,
    counts: star.Counts,
    names: Iterable[str] = tuple(star.DIMENSIONS),
) -> dict[str, tuple[StoredTable, dict]]:
    """The dimensions, or those of `names`. They do not depend on each other; their jobs run side by
    side. `counts` takes the rows of their members, see star.fact_orders.
    """
    return in_parallel(
        {
            name: (
                lambda name=name: write(
                    store, REFINED[name][0], star.DIMENSIONS[name](trusted, scratch, counts)
                )
            )
            for name in names
        }
    )


def run_pipeline(
    spark: SparkSession,
    sources: dict[str, DataFrame],
    out: str,
    database: str | None = None,
) -> Layers:
    """Refresh every layer below `out`; `sources` maps the sheet names to DataFrames.

    Each layer reads the stored tables of the one before. All tables change over together when the
    last one is written, so keys of the fact and the dimensions always belong to one run; a failure
    leaves every table at its previous version.
    """
    store = TableStore(spark, out, database)
    scratch = TableStore(spark, scratch_root(spark, "run"))
    try:
        return _refresh(sources, store, scratch)
    finally:
        scratch.drop_all()


def _refresh(sources: dict[str, DataFrame], store: TableStore, scratch: TableStore) -> Layers:
    landed = land_all(store, sources)
    raw = {sheet: store.open(table) for sheet, (table, _) in landed.items()}

    with scratch.section("trusted").dropped() as section:
        trusted_table, trusted_report = write(
            store, TRUSTED, trusted_orders(raw["Orders"], raw["Returns"], raw["People"], section)
        )
    trusted = store.open(trusted_table)

    counts: star.Counts = {}
    built = build_dimensions(trusted, store, scratch, counts)
    dims = {name: store.open(table) for name, (table, _) in built.items()}
    sizes = {name: table.bytes for name, (table, _) in built.items()}

    fact_table, fact_report = write(
        store,
        REFINED["fact_orders"][0],
        star.fact_orders(trusted, dims, scratch, sizes=sizes, counts=counts),
    )
    deleted = store.publish(
        *[table for table, _ in landed.values()],
        trusted_table,
        *[table for table, _ in built.values()],
        fact_table,
    )
    return Layers(
        raw_orders=raw["Orders"],
        raw_returns=raw["Returns"],
        raw_people=raw["People"],
        trusted=trusted,
        dims=dims,
        fact=store.open(fact_table),
        report=[
            *[report for _, report in landed.values()],
            trusted_report,
            *[report for _, report in built.values()],
            fact_report,
        ],
        deleted=deleted,
    )
