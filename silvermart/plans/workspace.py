"""Stored layers over one folder of source tables, built once per session and source state.

A query on one layer reads the stored tables of the layers before it, as in a daily run: the raw
tables are landed once, the checks read the stored fact. Nothing here holds a query's own result.
"""

from __future__ import annotations

from functools import cached_property
from threading import RLock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silvermart.plans import star
from silvermart.plans.pipeline import REFINED, TRUSTED, build_dimensions, write
from silvermart.plans.trusted import trusted_orders
from silvermart.sources import feed
from silvermart.sources.landing import land_all
from silvermart.sources.store import StoredTable, TableStore, scratch_root

SOURCE_TABLES = ["lineitem", "orders", "customer", "nation", "part", "region"]

_lock = RLock()
_open: dict[tuple, Workspace] = {}


class Workspace:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        root = scratch_root(spark, "workspace")
        self.store = TableStore(spark, root)
        self.scratch = TableStore(spark, f"{root}/scratch")
        self.store.drop_at_exit()
        self.dim_counts: star.Counts = {}
        self._dim_tables: dict[str, StoredTable] = {}

    @cached_property
    def raw(self) -> dict[str, DataFrame]:
        landed = land_all(self.store, feed.sheets(self.spark, self.sf_dir))
        return {sheet: self.store.open(table) for sheet, (table, _) in landed.items()}

    @cached_property
    def trusted(self) -> DataFrame:
        with self.scratch.section("trusted").dropped() as scratch:
            built = trusted_orders(
                self.raw["Orders"], self.raw["Returns"], self.raw["People"], scratch
            )
            return self.store.open(write(self.store, TRUSTED, built)[0])

    def dim_tables(self, *names: str) -> dict[str, StoredTable]:
        """The dimensions of these names; those that no query has asked for before are built now."""
        missing = [name for name in names if name not in self._dim_tables]
        built = build_dimensions(self.trusted, self.store, self.scratch, self.dim_counts, missing)
        self._dim_tables.update({name: table for name, (table, _) in built.items()})
        return {name: self._dim_tables[name] for name in names}

    def dim(self, name: str) -> DataFrame:
        return self.store.open(self.dim_tables(name)[name])

    @property
    def dims(self) -> dict[str, DataFrame]:
        return {n: self.store.open(table) for n, table in self.dim_tables(*star.DIMENSIONS).items()}

    @property
    def dim_sizes(self) -> dict[str, int]:
        return {name: table.bytes for name, table in self.dim_tables(*star.DIMENSIONS).items()}

    @cached_property
    def fact(self) -> DataFrame:
        # The calendar is no part of it.
        tables = self.dim_tables(*star.KEYED)
        with self.scratch.section("fact").dropped() as scratch:
            built = star.fact_orders(
                self.trusted,
                {name: self.store.open(table) for name, table in tables.items()},
                scratch,
                sizes={name: table.bytes for name, table in tables.items()},
                counts=self.dim_counts,
            )
            return self.store.open(write(self.store, REFINED["fact_orders"][0], built)[0])


def _source_state(spark: SparkSession, sf_dir: str) -> tuple:
    """Number, length and change time of the files of the source tables; no content is read."""
    paths = [f"{sf_dir}/{name}.parquet" for name in SOURCE_TABLES]
    files = spark.read.format("binaryFile").load(paths)
    return tuple(
        files.agg(
            F.count(F.lit(1)),
            F.sum("length"),
            F.max("modificationTime"),
            F.bit_xor(F.xxhash64("path", "length", "modificationTime")),
        ).first()
    )


def workspace(spark: SparkSession, sf_dir: str) -> Workspace:
    key = (spark.sparkContext.applicationId, sf_dir, _source_state(spark, sf_dir))
    with _lock:
        if key not in _open:
            _open[key] = Workspace(spark, sf_dir)
        return _open[key]
