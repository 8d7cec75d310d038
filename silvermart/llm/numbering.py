"""Places of rows within their group, for groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from silvermart.llm.common import Scratch

# Low bits of monotonically_increasing_id: the position of a row in its partition.
POSITION_BITS = 33


def numbered(df: DataFrame, group: str, order: list[str], scratch: Scratch, name: str) -> DataFrame:
    """`df` with `place` (from 0) and `total` of each row in its group, by `order`, NULLs first.

    The rows are dealt by ranges of group and order, so a group may spread over many tasks; what
    meets per group is one row per range. Both ranges and positions are stored, as they may differ
    when they are computed again. `order` should tell rows apart, or equal rows share one range.
    """
    columns = [F.col(c).asc_nulls_first() for c in (group, *order)]
    sliced = (
        df.repartitionByRange(*columns)
        .sortWithinPartitions(*columns)
        .withColumn("slice", F.spark_partition_id())
        .withColumn(
            "position", F.monotonically_increasing_id().bitwiseAND((1 << POSITION_BITS) - 1)
        )
    )
    stored = scratch.store(name, sliced)
    sizes = stored.groupBy(group, "slice").agg(
        F.count(F.lit(1)).alias("size"), F.min("position").alias("first")
    )
    whole = Window.partitionBy(group)
    before = whole.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        group,
        "slice",
        (F.coalesce(F.sum("size").over(before), F.lit(0)) - F.col("first")).alias("start"),
        F.sum("size").over(whole).alias("total"),
    )
    return stored.join(starts, [group, "slice"]).select(
        *df.columns, (F.col("start") + F.col("position")).alias("place"), "total"
    )
