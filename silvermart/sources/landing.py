"""Landing: any Spark-readable source becomes an all-text raw table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from silvermart import schemas
from silvermart.sources.store import SMALL, StoredTable, TableStore, in_parallel


@dataclass(frozen=True)
class Entity:
    """One sheet of the feed and the raw table it lands in."""

    sheet: str
    table: str
    schema: T.StructType


ENTITIES = [
    Entity("Orders", "raw/raw_orders", schemas.RAW_ORDERS),
    Entity("People", "raw/raw_people", schemas.RAW_PEOPLE),
    Entity("Returns", "raw/raw_returns", schemas.RAW_RETURNS),
]


def read_source(
    spark: SparkSession,
    fmt: str,
    path: str,
    schema: T.StructType,
    mode: str = "FAILFAST",
    multi_line: bool = False,
) -> DataFrame:
    """Read one entity without inference: text formats come in as text, typed ones as they are.

    A malformed record of a text format ends the read, unless `mode` says otherwise (Spark's
    PERMISSIVE or DROPMALFORMED). With `multi_line` cells may hold line breaks; a file is then
    read by one task.
    """
    reader = spark.read.format(fmt)
    if fmt == "csv":
        # All columns are text, so header names pick the columns and their order is free.
        return (
            reader.options(header=True, multiLine=multi_line, escape='"', mode=mode)
            .load(path)
            .select([F.col(f"`{f.name}`") for f in schema])
        )
    if fmt == "json":
        return reader.options(mode=mode, multiLine=multi_line).schema(schema).load(path)
    return reader.load(path).select([F.col(f"`{f.name}`") for f in schema])


# The column that holds the text of a record that could not be parsed.
REJECTED = "_rejected"


def read_with_rejects(
    spark: SparkSession, fmt: str, path: str, schema: T.StructType, multi_line: bool = False
) -> DataFrame:
    """As read_source, with malformed records of CSV and JSON as rows of their own.

    Such a row has its whole text in the column `_rejected`, which is NULL for all others. Formats
    with types have no malformed records.
    """
    options = {"mode": "PERMISSIVE", "multiLine": multi_line, "columnNameOfCorruptRecord": REJECTED}
    columns = [F.col(f"`{f.name}`") for f in schema]
    if fmt == "csv":
        names = spark.read.options(header=True, escape='"', multiLine=multi_line).csv(path).columns
        read = T.StructType([T.StructField(n, T.StringType()) for n in [*names, REJECTED]])
        reader = spark.read.options(header=True, escape='"', **options).schema(read)
        return reader.csv(path).select(*columns, REJECTED)
    if fmt == "json":
        read = T.StructType([*schema.fields, T.StructField(REJECTED, T.StringType())])
        return spark.read.options(**options).schema(read).json(path).select(*columns, REJECTED)
    return read_source(spark, fmt, path, schema).withColumn(REJECTED, F.lit(None).cast("string"))


def land_with_rejects(
    store: TableStore, scratch: TableStore, entity: Entity, source: DataFrame
) -> tuple[StoredTable, StoredTable, dict]:
    """Land one entity read by read_with_rejects: the raw table, its rejects, the report with both.

    The source is parsed once, into a table of the scratch store that both are taken from.
    """
    parsed = scratch.open(scratch.write(f"parsed/{entity.sheet}", source))
    good = parsed.where(F.col(REJECTED).isNull()).drop(REJECTED)
    table, report = land_entity(store, entity, good)
    bad = parsed.where(F.col(REJECTED).isNotNull()).select(F.col(REJECTED).alias("record"))
    rejects = store.write(f"rejects/{entity.table.split('/')[-1]}", bad)
    return table, rejects, report | {"rejected": rejects.rows}


def plain_double(c: Column) -> Column:
    """A double as text without an exponent from 0.0001 up to 1e16, and as Spark writes it beyond."""
    size = F.abs(c)
    # Below 0.001 the digits are those of the text with an exponent: 1.25E-4.
    mantissa = F.translate(F.regexp_replace(c.cast("string"), "E-4$", ""), "-.", "")
    small = F.concat(F.when(c < 0, "-").otherwise(""), F.lit("0.000"), F.rtrim(mantissa, F.lit("0")))
    digits = c.try_cast("decimal(38,18)").cast("string")
    plain = F.regexp_replace(digits, r"(\.\d+?)0+$", "$1")
    return (
        F.when((size >= 1e7) & (size < 1e16), plain)
        .when((size >= 1e-4) & (size < 1e-3), small)
        .otherwise(c.cast("string"))
    )


def stringify(df: DataFrame) -> DataFrame:
    """Every column as text, missing cells spelled out: 'nan', or 'NaT' for dates and times."""

    def as_text(field: T.StructField):
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            missing = "NaT"
        else:
            missing = "nan"
        text = c.cast("string")
        if isinstance(field.dataType, T.BooleanType):
            text = F.initcap(text)
        if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            text = F.when(~F.isnan(c), plain_double(c.cast("double")))
        return F.coalesce(text, F.lit(missing)).alias(field.name)

    return df.select([as_text(f) for f in df.schema.fields])


def land_entity(store: TableStore, entity: Entity, source: DataFrame) -> tuple[StoredTable, dict]:
    """Write one raw table, not yet published; the metrics come from the write itself."""
    table = store.write(entity.table, stringify(source), compression=SMALL)
    return table, {
        "sheet": entity.sheet,
        "table": entity.table.split("/")[-1],
        "rows": table.rows,
        "columns": len(table.schema.fields),
        "path": table.path,
    }


def land_all(store: TableStore, sources: dict[str, DataFrame]) -> dict[str, tuple]:
    """Land every entity, one independent job each; keys are the sheet names. See publish()."""
    return in_parallel(
        {
            e.sheet: (lambda e=e: land_entity(store, e, sources[e.sheet]))
            for e in ENTITIES
        }
    )
