"""Left join to a lookup table, safe for lookups of any size and for keys of any weight.

A lookup is written first, so its size is known before the join is planned:

* below the session's broadcast threshold it is broadcast, and the wide side does not move;
* above it, both sides are shuffled by the key. A key with more rows than one task should get is
  hot: its rows are dealt over as many salts as it holds such shares, and its lookup rows are
  repeated once per salt. Rows with a NULL key need no partner and are dealt by their row number.

Several large lookups (attach_all) meet row numbers and keys only, all in one join. The wide rows move
once, by row number, to meet what was found, however many lookups there are. Neighbours in the scan move
together, so what they have in common stays small in the shuffle, and in the table that is written.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silvermart.sources.store import SMALL, TableStore, in_parallel

ROW_TAG = "row_tag"
ROW_PLACE = "row_place"
SALT, SALTS = "salt", "salts"
FOUND_KEY = "_found_key"

# A task's share of the rows is made up of so many pieces at least; finer ones lie more evenly.
PIECES = 8

# Rows of consecutive numbers that move together, as bits of the number. A row is compared with what was
# found for its block, so blocks are short.
BLOCK_BITS = 4


@dataclass(frozen=True)
class Lookup:
    """A stored lookup table: `on` are its key columns, the others what it adds to a row."""

    store: TableStore
    name: str
    df: DataFrame
    on: list[str]
    bytes: int

    @property
    def payload(self) -> list[str]:
        return [c for c in self.df.columns if c not in self.on]


def store_lookup(store: TableStore, name: str, df: DataFrame, on: list[str]) -> Lookup:
    """Write the lookup; its size is taken while writing."""
    table = store.write(f"lookup/{name}", df)
    return Lookup(store, name, store.open(table), on, table.bytes)


def stored_lookup(
    store: TableStore, name: str, stored: DataFrame, on: list[str], size: int | None
) -> Lookup:
    """A lookup that reads a stored table, whose size is known from its write.

    Without a size the rows are written once more, which measures them.
    """
    if size is None:
        return store_lookup(store, name, stored, on)
    return Lookup(store, name, stored, on, size)


def broadcast_limit(spark: SparkSession) -> int:
    """spark.sql.autoBroadcastJoinThreshold in bytes; -1 turns broadcasts off."""
    text = spark.conf.get("spark.sql.autoBroadcastJoinThreshold").strip().lower()
    number = re.match(r"-?\d+", text)[0]
    unit = text[len(number) :].rstrip("b")
    powers = {"": 0, "k": 10, "m": 20, "g": 30, "t": 40, "p": 50}
    return int(number) << powers[unit] if int(number) > 0 else int(number)


def with_row_tag(scanned: DataFrame) -> DataFrame:
    """Number the rows of a table scan.

    To be called directly on a scan, whose row order is the same when a lost task runs again; the
    number then travels with the row through every shuffle.
    """
    return scanned.withColumn(ROW_TAG, F.monotonically_increasing_id())


def _present(on: list[str]):
    return reduce(and_, [F.col(c).isNotNull() for c in on])


def hot_keys(df: DataFrame, on: list[str], store: TableStore | None = None) -> DataFrame:
    """Keys with more rows than one of the `PIECES` of a task's share, and their number of salts.

    Fewer than PIECES times the shuffle partitions can be so, which bounds the result. Counted
    before the shuffle, by a scan of the key columns; with a `store` the counts are written, so that
    the total and the hot keys come from one count.
    """
    counted = df.groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
    if store:
        counted = store.open(store.write("counts/" + "-".join(on), counted))
    return hot_among(counted, on)


def hot_among(counted: DataFrame, on: list[str]) -> DataFrame:
    """hot_keys of rows that are counted already: keys and `n`, a key perhaps in several rows."""
    spark = counted.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = counted.agg(F.sum("n")).first()[0] or 0
    piece = max(1.0, total / (partitions * PIECES))
    return (
        counted.where(_present(on))
        .groupBy(*on)
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") > piece)
        .select(*on, F.ceil(F.col("n") / piece).cast("long").alias(SALTS))
    )


def attach(
    df: DataFrame,
    lookup: Lookup,
    hot: Callable[[], DataFrame],
    shuffled: bool = False,
) -> DataFrame:
    """Add the lookup's columns; NULL where the key is NULL or has no entry.

    `df` carries ROW_TAG. `hot` names the hot keys of `df`, see hot_keys; it is only asked for a
    lookup that is too large to broadcast, or always with `shuffled`.
    """
    on, store = lookup.on, lookup.store
    if not is_large(lookup, shuffled):
        return df.join(F.broadcast(lookup.df), on, "left")

    # Fewer rows than PIECES times the shuffle partitions.
    salts = store.open(store.write(f"hot/{lookup.name}", hot()))
    present = _present(on)
    many = F.coalesce(F.col(SALTS), F.lit(1))
    dealt = (
        df.join(F.broadcast(salts), on, "left")
        .withColumn(
            SALT, F.when(present, F.pmod(F.col(ROW_TAG), many)).otherwise(-1 - F.col(ROW_TAG))
        )
        .drop(SALTS)
    )
    entries = (
        lookup.df.join(F.broadcast(salts), on, "left")
        .withColumn(SALT, F.explode(F.sequence(F.lit(0).cast("long"), many - 1)))
        .drop(SALTS)
    )
    return dealt.join(entries, [*on, SALT], "left").drop(SALT)


def is_large(lookup: Lookup, shuffled: bool = False) -> bool:
    """Whether a lookup is joined by a shuffle: it is beyond the broadcast limit, or has to."""
    return shuffled or lookup.bytes > broadcast_limit(lookup.store.spark)


def key_tag(keys: list[str]):
    """A row number made of the row's keys, for attach_all with `shared_tags`.

    A hash skips NULLs, so which keys are missing goes into it as well.
    """
    missing = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in keys])
    return F.xxhash64(missing, *keys)


def tag_by(
    rows: DataFrame, lookup: Lookup, heavy: DataFrame | None, keys: list[str]
) -> tuple[DataFrame, DataFrame]:
    """`rows` with a number made of the key of `lookup`, and the lookup's entries with their numbers.

    `heavy`, if there are any, names the keys of very many rows and their number of salts, see
    hot_keys; those rows are dealt by all their `keys`, so that equal rows have one number there too.
    For attach_all with `shared_tags`, where `lookup` then needs no search.
    """
    on = lookup.on
    if heavy is None:
        number = key_tag(on)
        return rows.withColumn(ROW_TAG, number), lookup.df.withColumn(ROW_TAG, number)

    # Fewer rows than PIECES times the shuffle partitions.
    salts = F.broadcast(heavy)
    many = F.coalesce(F.col(SALTS), F.lit(1))
    number = F.xxhash64(key_tag(on), SALT)
    numbered = (
        rows.join(salts, on, "left")
        .withColumn(SALT, F.pmod(key_tag(keys), many))
        .withColumn(ROW_TAG, number)
    )
    entries = (
        lookup.df.join(salts, on, "left")
        .withColumn(SALT, F.explode(F.sequence(F.lit(0).cast("long"), many - 1)))
        .withColumn(ROW_TAG, number)
    )
    return numbered.drop(SALT, SALTS), entries.drop(SALT, SALTS)


def attach_all(
    df: DataFrame,
    lookups: list[Lookup],
    hot: Callable[[Lookup], DataFrame],
    shuffled: bool = False,
    shared_tags: bool = False,
    tagged: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """Add the columns of several lookups, whose names differ, as attach does one after the other.

    `df` carries ROW_TAG, and no lookup's key is a column that another one adds. Small lookups are
    broadcast. The others meet (row number, key) in one join, and what it has found is joined by row
    number: so wide rows are shuffled at most once. With `shared_tags` rows may have one number
    together, as key_tag and tag_by give it: then what was found is taken by its key as well, and the
    rows are left where rows of one number lie together. Rows with numbers of their own move by blocks
    of consecutive numbers, and keep their neighbours. `tagged` has by name the entries of lookups
    that know their row numbers themselves, with ROW_TAG; those need not be searched.
    """
    tagged = tagged or {}
    large = [x for x in lookups if is_large(x, shuffled)]
    small = [x for x in lookups if not is_large(x, shuffled)]

    def met_small(rows: DataFrame) -> DataFrame:
        for lookup in small:
            rows = rows.join(F.broadcast(lookup.df), lookup.on, "left")
        return rows

    if not large:
        return met_small(df)

    store = large[0].store
    searched = [x for x in large if x.name not in tagged]
    if searched:
        found = _found(df, searched, hot, shared_tags)
        found = store.open(store.write("found", found, "kind", SMALL))
    # Rows with numbers of their own shed the keys of small lookups before they move. The others keep
    # all columns, so there what the small ones add, and the rows they double, need not move.
    rows = df if shared_tags else _in_blocks(met_small(df))
    for lookup in large:
        if lookup.name in tagged:
            mine = tagged[lookup.name].withColumn("key", _key(lookup.on))
        else:
            mine = found.where(F.col("kind") == searched.index(lookup))
        # All by the same number, so the rows stay where the first of these joins puts them. The second
        # condition is no equality, by which Spark would shuffle as well: the number alone places the rows.
        same_tag = F.col(f"rows.{ROW_TAG}") == F.col(f"found.{ROW_TAG}")
        if shared_tags:
            mine = mine.select(ROW_TAG, F.col("key").alias(FOUND_KEY), *lookup.payload)
            same_row = F.array_contains(F.array(FOUND_KEY), _key(lookup.on))
        else:
            mine = _in_blocks(mine.select(ROW_TAG, *lookup.payload)).withColumnRenamed(
                ROW_PLACE, FOUND_KEY
            )
            same_row = F.col(ROW_PLACE).bitwiseXOR(F.col(FOUND_KEY)) == 0
        met = rows.alias("rows").join(
            mine.alias("found").hint("merge"), same_tag & same_row, "left"
        )
        rows = met.drop(F.col(f"found.{ROW_TAG}"), F.col(FOUND_KEY))
    if shared_tags:
        return met_small(rows)
    number = F.shiftleft(ROW_TAG, BLOCK_BITS).bitwiseOR(F.col(ROW_PLACE))
    return rows.withColumn(ROW_TAG, number).drop(ROW_PLACE)


def _in_blocks(rows: DataFrame) -> DataFrame:
    """Row numbers cut into ROW_TAG, now the number of a block, and the place in the block."""
    number = F.col(ROW_TAG)
    return rows.withColumns(
        {
            ROW_TAG: F.shiftright(number, BLOCK_BITS),
            ROW_PLACE: number.bitwiseAND(F.lit((1 << BLOCK_BITS) - 1).cast("long")),
        }
    )


def _key(on: list[str]):
    """Key columns as one text; several are told apart by their lengths."""
    texts = [F.col(c).cast("string") for c in on]
    if len(texts) == 1:
        return texts[0]
    return F.concat(*[part for t in texts for part in (F.length(t), F.lit(":"), t)])


def _found(
    df: DataFrame, large: list[Lookup], hot: Callable[[Lookup], DataFrame], shared_tags: bool
) -> DataFrame:
    """(row number, kind, payload of all lookups): a row per row number and entry that it meets.

    With `shared_tags` it has the key too, and each key is asked for once per number: equal questions
    lie together anyway, by the key.
    """
    asked = [
        F.when(_present(x.on), F.struct(F.lit(k).alias("kind"), _key(x.on).alias("key")))
        for k, x in enumerate(large)
    ]
    # Nulls go after the explode: functions that take a lambda, as array_compact does, are not compiled.
    keyed = df.select(ROW_TAG, F.explode(F.array(*asked)).alias("asked"))
    keyed = keyed.where(F.col("asked").isNotNull()).select(ROW_TAG, "asked.kind", "asked.key")

    def of(k: int, rows: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
        return rows.select(F.lit(k).alias("kind"), _key(on).alias("key"), *columns)

    def union(parts: list[DataFrame]) -> DataFrame:
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    store = large[0].store
    # Fewer rows per lookup than PIECES times the shuffle partitions.
    hot_of = in_parallel({k: (lambda x=x: hot(x)) for k, x in enumerate(large)})
    salts = union([of(k, hot_of[k], x.on, [SALTS]) for k, x in enumerate(large)])
    salts = F.broadcast(store.open(store.write("hot/all", salts)))
    entries = union([of(k, x.df, x.on, x.payload) for k, x in enumerate(large)])
    on, many = ["kind", "key"], F.coalesce(F.col(SALTS), F.lit(1))
    dealt = keyed.join(salts, on, "left").withColumn(SALT, F.pmod(F.col(ROW_TAG), many))
    copies = entries.join(salts, on, "left").withColumn(
        SALT, F.explode(F.sequence(F.lit(0).cast("long"), many - 1))
    )
    dealt = dealt.drop(SALTS)
    if shared_tags:
        dealt = dealt.repartition(*on, SALT).distinct()
    met = dealt.join(copies.drop(SALTS), [*on, SALT])
    return met.drop(SALT) if shared_tags else met.drop("key", SALT)
