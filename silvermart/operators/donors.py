"""Lookups that repair a column from other rows with the same key.

Two rules: fill a missing value with the largest value the key has elsewhere, or take the key's
most frequent value (the smallest one on a tie). The lookups hold only keys with something to
repair, so they grow with the faults in the data and not with the data.

All of them first collapse the rows to distinct (key, values) combinations with a count. That
step hashes, combines before the shuffle and spreads a heavy key over its combinations; taking
the maximum of a text column directly would sort every row instead.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silvermart.sources.store import TableStore

FILL = "_fill"


def fill_name(column: str) -> str:
    return column + FILL


def _counted(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    present = reduce(and_, [F.col(k).isNotNull() for k in keys])
    return df.filter(present).groupBy(*keys, *values).agg(F.count(F.lit(1)).alias("freq"))


def count_kinds(
    df: DataFrame, kinds: dict[str, tuple[list[str], list[str]]], store: TableStore, name: str
) -> dict[str, DataFrame]:
    """By kind the distinct (keys, values) with `freq`, all from one pass over the rows.

    Each row is expanded to one entry per kind whose keys are all there, and the entries collapse
    before they are shuffled. Keys and values are text. The counts are written, a folder per kind.
    """
    none = F.array().cast("array<string>")
    entries = [
        F.when(
            reduce(and_, [F.col(c).isNotNull() for c in keys]),
            F.struct(
                F.lit(kind).alias("kind"),
                F.array(*keys).alias("key"),
                (F.array(*values) if values else none).alias("value"),
            ),
        )
        for kind, (keys, values) in kinds.items()
    ]
    # Nulls go after the explode: functions that take a lambda, as array_compact does, are not compiled.
    expanded = df.select(F.explode(F.array(*entries)).alias("entry"))
    present = expanded.where(F.col("entry").isNotNull())
    counted = present.groupBy("entry.kind", "entry.key", "entry.value").agg(
        F.count(F.lit(1)).alias("freq")
    )
    stored = store.open(store.write(name, counted, partition_by="kind"))
    return {
        kind: stored.where(F.col("kind") == kind).select(
            *[F.col("key")[i].alias(c) for i, c in enumerate(keys)],
            *[F.col("value")[i].alias(c) for i, c in enumerate(values)],
            "freq",
        )
        for kind, (keys, values) in kinds.items()
    }


def max_donors(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys + <column>_fill for the keys that have both a missing and a present value."""
    return max_donors_of(_counted(df, keys, columns), keys, columns)


def max_donors_of(counted: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """max_donors of rows that are collapsed to distinct keys and values already."""
    aggregates, repairable = [], []
    for c in columns:
        aggregates += [
            F.max(c).alias(fill_name(c)),
            F.max(F.col(c).isNull()).alias(f"{c}_missing"),
        ]
        repairable.append(F.col(f"{c}_missing") & F.col(fill_name(c)).isNotNull())
    return (
        counted.groupBy(*keys)
        .agg(*aggregates)
        .filter(reduce(or_, repairable))
        .select(*keys, *[fill_name(c) for c in columns])
    )


def mode_donors(
    df: DataFrame,
    keys: list[str],
    column: str,
    overwrite: bool = False,
    max_columns: tuple[str, ...] = (),
) -> DataFrame:
    """keys + <column>_fill, the most frequent value, where it would change a row.

    That is a key with a missing value, or with `overwrite` any key with more than one value.
    `max_columns` are repaired by the maximum rule in the same pass over the data.
    """
    counted = _counted(df, keys, [column, *max_columns])
    return mode_donors_of(counted, keys, column, overwrite, max_columns)


def mode_donors_of(
    per_value: DataFrame,
    keys: list[str],
    column: str,
    overwrite: bool = False,
    max_columns: tuple[str, ...] = (),
) -> DataFrame:
    """mode_donors of rows that are collapsed to distinct keys and values, with `freq`, already."""
    if max_columns:
        per_value = per_value.groupBy(*keys, column).agg(
            F.sum("freq").alias("freq"),
            *[F.max(c).alias(c) for c in max_columns],
            *[F.max(F.col(c).isNull()).alias(f"{c}_missing") for c in max_columns],
        )
    value = F.col(column)
    # The smallest (-freq, value) pair is the most frequent value, ties to the smallest.
    ranked = F.when(value.isNotNull(), F.struct((-F.col("freq")).alias("rank"), value.alias("v")))
    per_key = per_value.groupBy(*keys).agg(
        F.min(ranked)["v"].alias(fill_name(column)),
        F.count(F.lit(1)).alias("variants"),
        F.max(value.isNull()).alias(f"{column}_missing"),
        *[F.max(c).alias(fill_name(c)) for c in max_columns],
        *[F.max(f"{c}_missing").alias(f"{c}_missing") for c in max_columns],
    )
    changed = F.col("variants") > 1 if overwrite else F.col(f"{column}_missing")
    repairable = [F.col(fill_name(column)).isNotNull() & changed]
    repairable += [
        F.col(f"{c}_missing") & F.col(fill_name(c)).isNotNull() for c in max_columns
    ]
    return per_key.filter(reduce(or_, repairable)).select(
        *keys, fill_name(column), *[fill_name(c) for c in max_columns]
    )


def filled(df: DataFrame, *columns: str) -> DataFrame:
    """Put the attached fill where the column is NULL."""
    return df.withColumns(
        {c: F.coalesce(F.col(c), F.col(fill_name(c))) for c in columns}
    ).drop(*[fill_name(c) for c in columns])


def overwritten(df: DataFrame, column: str, original: str) -> DataFrame:
    """Put the attached fill over the column and keep what was there as `original`."""
    return df.withColumns(
        {
            original: F.col(column),
            column: F.coalesce(F.col(fill_name(column)), F.col(column)),
        }
    ).drop(fill_name(column))
