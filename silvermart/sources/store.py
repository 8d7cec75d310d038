"""Versioned Parquet tables under one root folder.

Every write goes to a fresh version folder. Which versions count is told by the manifest, a small
table that each publication adds a complete list to in one commit; so several tables change over
together, a refresh that fails half-way leaves all of them as they were, and a reader that started
before keeps its files. One writer at a time.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from threading import RLock

from pyspark import InheritableThread
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


# One row per table and version that is kept; the rows of the highest turn hold.
MANIFEST = "turn long, name string, path string, place int"

# The compression of tables whose size matters more than the time of their write.
SMALL = "zstd"

# What a SQL execution has shuffled goes when the execution ends, and not when the driver's JVM
# happens to collect its plan.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_lock = RLock()
_writers: dict[str, int] = {}
_before: dict[str, str | None] = {}


@dataclass(frozen=True)
class StoredTable:
    """What one write produced; the counts are taken while writing, not by a second scan."""

    name: str
    path: str
    schema: T.StructType
    rows: int
    bytes: int


def row_bytes(schema: T.StructType):
    """Estimate of what a row takes in memory: eight bytes per column plus the text."""
    text = [
        F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0))
        for f in schema.fields
        if isinstance(f.dataType, T.StringType)
    ]
    return sum(text, F.lit(16 + 8 * len(schema.fields))).cast("long")


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """SQL executions that start inside delete their shuffle files when they end.

    For writes: a table that is written is read from its files, so no later job needs the shuffles it
    came from. The session's own setting is back when the last of several threads has left.
    """
    session = spark._jsparkSession.sessionUUID()
    with _lock:
        if not _writers.get(session):
            _before[session] = spark.conf.get(SHUFFLES_GO, None)
            spark.conf.set(SHUFFLES_GO, "true")
        _writers[session] = _writers.get(session, 0) + 1
    try:
        yield
    finally:
        with _lock:
            _writers[session] -= 1
            if not _writers[session]:
                before = _before.pop(session)
                if before is None:
                    spark.conf.unset(SHUFFLES_GO)
                else:
                    spark.conf.set(SHUFFLES_GO, before)


class TableStore:
    """Writes and reads the tables below `root`.

    With a `database`, each table is also registered in the session catalog as an external
    Parquet table whose location follows the current version. Of every table the last `keep`
    published versions stay.
    """

    def __init__(self, spark: SparkSession, root: str, database: str | None = None, keep: int = 2):
        self.spark = spark
        self.root = root.rstrip("/")
        self.database = database
        self.keep = keep
        self._lock = RLock()

    # -- writing ---------------------------------------------------------------------------

    def write(
        self,
        name: str,
        df: DataFrame,
        partition_by: str | None = None,
        compression: str = "snappy",
    ) -> StoredTable:
        """Write a new version of `name`, which nobody reads by name until it is published.

        With `partition_by` the files lie in a folder per value of that column, which should have
        few, so that a reader of one value opens no others. Tables of as many rows as the feed are
        written with SMALL.
        """
        path = f"{self.root}/{name}/v{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        seen = Observation()
        observed = df.observe(
            seen, F.count(F.lit(1)).alias("rows"), F.sum(row_bytes(df.schema)).alias("bytes")
        )
        writer = observed.write.mode("errorifexists").option("compression", compression)
        with shuffles_go(self.spark):
            (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
        taken = dict(seen.get)
        return StoredTable(name, path, df.schema, taken["rows"], taken["bytes"] or 0)

    def publish(self, *tables: StoredTable) -> int:
        """Make these versions the current ones, all at once; returns how many old ones went.

        Versions that were written and never published, by a run that failed, go as well.
        """
        with self._lock:
            held = self._manifest()
            for table in tables:
                held[table.name] = [table.path, *held.get(table.name, [])][: self.keep]
            turn = time.time_ns()
            rows = [
                (turn, name, path, place)
                for name, paths in held.items()
                for place, path in enumerate(paths)
            ]
            listed = self.spark.createDataFrame(rows, MANIFEST).coalesce(1)
            listed.write.mode("append").parquet(f"{self.root}/_manifest")
            if self.database:
                for table in tables:
                    self._register(table)
            return sum(self.expire(table.name) for table in tables)

    def materialize(self, name: str, df: DataFrame) -> DataFrame:
        """Full refresh of one table; returns the table read back from its files."""
        table = self.write(name, df)
        self.publish(table)
        return self.open(table)

    def _register(self, table: StoredTable) -> None:
        catalog = self.spark.catalog
        qualified = f"`{self.database}`.`{table.name.split('/')[-1]}`"
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{self.database}`")
        if catalog.tableExists(qualified):
            if [f.simpleString() for f in self.spark.table(qualified).schema] == [
                f.simpleString() for f in table.schema
            ]:
                self.spark.sql(f"ALTER TABLE {qualified} SET LOCATION '{table.path}'")
                catalog.refreshTable(qualified)
                return
            self.spark.sql(f"DROP TABLE IF EXISTS {qualified}")
        catalog.createTable(qualified, path=table.path, source="parquet", schema=table.schema)

    # -- reading ---------------------------------------------------------------------------

    def open(self, table: StoredTable) -> DataFrame:
        return self.spark.read.schema(table.schema).parquet(table.path)

    def read(self, name: str, schema: T.StructType) -> DataFrame:
        """The current version of `name`, also one that an earlier session published."""
        versions = self._manifest().get(name)
        if not versions:
            raise FileNotFoundError(f"no published version of {name} below {self.root}")
        return self.spark.read.schema(schema).parquet(versions[0])

    def _manifest(self) -> dict[str, list[str]]:
        """By table its published versions that are kept, the current one first."""
        try:
            listed = self.spark.read.schema(MANIFEST).parquet(f"{self.root}/_manifest")
            last = listed.agg(F.max("turn")).first()[0]
            rows = listed.where(F.col("turn") == last).orderBy("name", "place").collect()
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return {}
        found: dict[str, list[str]] = {}
        for r in rows:
            found.setdefault(r["name"], []).append(r["path"])
        return found

    # -- versions --------------------------------------------------------------------------

    def section(self, name: str) -> TableStore:
        """A store below this one's root, for tables that can go before the others; see drop_all."""
        return TableStore(self.spark, f"{self.root}/{name}-{uuid.uuid4().hex[:8]}")

    def expire(self, name: str) -> int:
        """Delete every version that the manifest does not list; returns how many went."""
        kept = {path.rsplit("/", 1)[-1] for path in self._manifest().get(name, [])}
        old = [v for v in self._versions(name) if v.rsplit("/", 1)[-1] not in kept]
        for version in old:
            path, fs = self._hadoop(version)
            fs.delete(path, True)
        return len(old)

    def drop_all(self) -> int:
        """Delete everything below the root, for the tables of a finished run; returns how many
        files went."""
        path, fs = self._hadoop(self.root)
        if not fs.exists(path):
            return 0
        files = fs.getContentSummary(path).getFileCount()
        fs.delete(path, True)
        return files

    @contextmanager
    def dropped(self) -> Iterator[TableStore]:
        """This store, whose tables all go at the end; what was made of them is written by then."""
        try:
            yield self
        finally:
            self.drop_all()

    def drop_at_exit(self) -> None:
        """Delete everything below the root when the driver's JVM ends; for tables that results
        not yet read may need. A driver that is killed leaves them."""
        path, fs = self._hadoop(self.root)
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def _versions(self, name: str) -> list[str]:
        path, fs = self._hadoop(f"{self.root}/{name}")
        if not fs.exists(path):
            return []
        return sorted(s.getPath().toString() for s in fs.listStatus(path) if s.isDirectory())

    def _hadoop(self, location: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(location)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())


def scratch_root(spark: SparkSession, purpose: str) -> str:
    """A folder for intermediate tables that all executors share.

    The cluster names it in spark.checkpoint.dir; without that setting it lies below the warehouse.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.sql.warehouse.dir"
    )
    app = spark.sparkContext.applicationId
    return f"{shared.rstrip('/')}/silvermart/{app}/{purpose}-{uuid.uuid4().hex[:8]}"


def in_parallel(jobs: dict[str, Callable[[], object]]) -> dict[str, object]:
    """Submit independent Spark jobs at the same time; the first failure is raised.

    The threads inherit the caller's job group, tags and scheduler pool.
    """
    results: dict[str, object] = {}
    failures: list[BaseException] = []

    def run(name: str) -> None:
        try:
            results[name] = jobs[name]()
        except BaseException as failure:  # raised again below
            failures.append(failure)

    threads = [InheritableThread(target=run, args=(name,)) for name in jobs]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    if failures:
        raise failures[0]
    return {name: results[name] for name in jobs}
