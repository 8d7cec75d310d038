"""What the operators of this subpackage share: word rules, stored steps, names that cannot clash."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from silvermart.llm.spans import slices

# The white space of the word rule, as code points and as a Java class.
SPACES = "\t\n\x0b\x0c\r "
SPACE_CLASS = "[\\x20\\x09-\\x0D]"


# Rows handed to a Python worker at once. Texts are long, and a task holds a batch several times.
ROWS_PER_BATCH = 1000


def short_batches(spark: SparkSession) -> None:
    """Lower the session's batch size for Python workers to what texts allow; results are the same."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ROWS_PER_BATCH:
        spark.conf.set(name, str(ROWS_PER_BATCH))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def words_of(text: Column) -> Column:
    """The words of a text, unchanged; none for NULL and for white space alone."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    none = F.array().cast("array<string>")
    return F.when(trimmed == "", none).otherwise(F.split(trimmed, SPACE_CLASS + "+"))


def below(ascending: Column, value: Column, bits: int = 24, equal: bool = False) -> Column:
    """How many entries of an ascending array are smaller than `value`, by binary search.

    With `equal`, those that equal it count as well. The array has fewer than 2^bits entries.
    """
    size = F.size(ascending)
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(bits))])

    def halve(found: Column, step: Column) -> Column:
        entry = F.get(ascending, found + step - 1)
        smaller = entry <= value if equal else entry < value
        return F.when((found + step <= size) & smaller, found + step).otherwise(found)

    return F.aggregate(steps, F.lit(0), halve)


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """The wanted names, each lengthened until no column has it (Spark compares in any case)."""
    taken, found = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def let(value: Column, body) -> Column:
    """`body(value)` with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shared_root(spark: SparkSession) -> str:
    """Folder for intermediate tables that every executor sees.

    The cluster names it in spark.checkpoint.dir; without it, below the warehouse folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.sql.warehouse.dir"
    )
    return f"{root.rstrip('/')}/silvermart-llm"


class Scratch:
    """Intermediate tables in the shared folder.

    What comes after a stored table no longer depends on what computed it, so a lost executor costs
    a re-read. A table that is no longer needed can be emptied.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
        self.schemas: dict[str, T.StructType] = {}

    def store(self, name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{self.root}/{name}")
        self.schemas[name] = df.schema
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def discard(self, *names: str) -> None:
        for name in names:
            empty = self.spark.createDataFrame([], self.schemas[name])
            empty.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/{name}")


def stored(df: DataFrame) -> DataFrame:
    """The rows of `df`, written once to the shared folder and read back."""
    return Scratch(df.sparkSession).store("rows", df)


def text_parts(
    batch: pa.RecordBatch, *columns: str, limit: int = 1 << 20
) -> Iterator[pa.RecordBatch]:
    """A batch in slices of bounded size, by the bytes of some text (or list) columns."""
    sizes = np.ones(batch.num_rows, np.int64)
    for name in columns:
        values = batch.column(name)
        listed = pa.types.is_list(values.type)
        length = pc.list_value_length(values) if listed else pc.binary_length(values)
        sizes += (8 if listed else 1) * pc.fill_null(length, 0).to_numpy(zero_copy_only=False)
    for a, b in slices(sizes.tolist(), limit):
        yield batch.slice(a, b - a)


def add_columns(
    df: DataFrame,
    fields: list[T.StructField],
    compute: Callable[[pa.RecordBatch], Iterator[tuple[pa.RecordBatch, list[pa.Array]]]],
    without: tuple[str, ...] = (),
) -> DataFrame:
    """`df` with columns computed in tasks, batch by batch; those of the same names are replaced.

    `compute` gives slices of a batch with the new columns. The other columns pass through as they
    are, NULLs and all; those of `without` are read and then left out.
    """
    new = {f.name for f in fields}
    read = [c for c in df.columns if c not in new]
    kept = [c for c in read if c not in without]
    source = df.select(*[F.col(f"`{c}`") for c in read])
    schema = T.StructType([*[f for f in source.schema if f.name in kept], *fields])
    names = [*kept, *[f.name for f in fields]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, arrays in compute(batch):
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in kept], *arrays], names=names
                )

    return source.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Rows no model learns from: crc32 of the id as text, a fifth of all; NULL ids as well."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def uniform(*columns: Column, seed: int = 0) -> Column:
    """A number in (0, 1) that depends on the columns alone."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11)
    return (bits.cast("double") + 0.5) / float(1 << 53)
