"""Dense integer keys 1..n in the order of the given columns, without a single-task sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from silvermart.sources.store import StoredTable, TableStore

# Low bits of monotonically_increasing_id: the position of a row in its partition.
POSITION_BITS = 33


def dense_key(
    df: DataFrame, columns: list[str], key: str, store: TableStore, name: str
) -> DataFrame:
    """Number the distinct rows of `df` by `columns`, NULLs last.

    Range partitioning gives each task one slice of the order, the local sort a position in the
    slice. Both are written down, because the slices may differ when they are computed again.
    The start of each slice is the running sum of the slice sizes, one row per slice.
    `columns` must tell all rows apart, so that the order has no ties.
    """
    return numbered(store.open(slices(df, columns, store, name)), columns, key)


def slices(df: DataFrame, columns: list[str], store: TableStore, name: str) -> StoredTable:
    """The rows of `df`, all their columns, in slices of the order by `columns`."""
    order = [F.col(c).asc_nulls_last() for c in columns]
    sliced = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("slice", F.spark_partition_id())
        .withColumn(
            "position", F.monotonically_increasing_id().bitwiseAND((1 << POSITION_BITS) - 1)
        )
    )
    return store.write(f"slices/{name}", sliced)


def numbered(stored: DataFrame, columns: list[str], key: str) -> DataFrame:
    """`key` and `columns` of what slices has written."""
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        stored.groupBy("slice")
        .agg(F.count(F.lit(1)).alias("size"))
        .select("slice", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    )
    # One row per range partition, so this broadcast is bounded by the partition count.
    return stored.join(F.broadcast(starts), "slice").select(
        (F.col("start") + F.col("position") + 1).cast("int").alias(key),
        *columns,
    )
