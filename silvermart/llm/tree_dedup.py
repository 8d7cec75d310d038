"""Exact duplicates by a tree merge of digest runs, in DataFrame functions alone.

Each partition of the table is a run: its distinct digests with the row that stays and the number of
rows. Runs are merged in rounds, each of which joins the runs that are equal but for the lowest bits
of their numbers (2^RUN_BITS runs at once, so RUN_BITS binomial rounds in one), until one is left. A
merge keeps the larger identifier and adds the counts. It is dealt by run and digest, so that no task
holds a run as a whole, and what a task gets of one digest is a row per run: however many rows share
a text, its partitions have collapsed them before anything moves. The answers go down the same way,
from the last run to the runs it was made of and to the rows of each.

Digests are verified at every level: entries are one only if the 256-bit digest, the number of bytes
and a second, independent hash agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silvermart.llm.common import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Runs merged at once, as a power of two.
RUN_BITS = 3
KEY = ["digest", "n_bytes", "second"]


def normalised(text: Column) -> Column:
    """A-Z lower-cased and nothing else; NULL as the empty text."""
    known = F.coalesce(text, F.lit(""))
    # Of texts of one byte per character, the fast function changes the same letters.
    plain = F.octet_length(known) == F.length(known)
    return F.when(plain, F.lower(known)).otherwise(F.translate(known, UPPER, LOWER))


def _marked(docs: DataFrame, id_column: str, text_column: str, carry: bool) -> DataFrame:
    """run, tag, id and key of every row; with `carry` the row as well."""
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    texts = docs.select(
        F.spark_partition_id().alias("run"),
        F.monotonically_increasing_id().alias("tag"),
        F.col(f"`{id_column}`").alias("id"),
        normalised(F.col(f"`{text_column}`").cast("string")).alias("normalised"),
        *row,
    )
    return texts.select(
        "run",
        "tag",
        "id",
        F.unhex(F.sha2(F.col("normalised").cast("binary"), 256)).alias("digest"),
        F.octet_length("normalised").alias("n_bytes"),
        F.xxhash64("normalised").alias("second"),
        *[c for c in ("row",) if carry],
    )


def _merged(entries: DataFrame) -> DataFrame:
    """One entry per run and digest: the largest (id, tag) and the number of rows.

    Sorted by run and digest before and after the exchange, as the largest of a pair is not kept
    by hashing but by merging in order.
    """
    return entries.groupBy("run", *KEY).agg(
        F.max("best").alias("best"), F.sum("rows").alias("rows")
    )


def exact_groups(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    carry: bool = False,
    bits: int = RUN_BITS,
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row, dropped ones too.

    Texts are equal when identical after lower-casing A-Z; NULL counts as empty. Of equal texts the
    row of largest id stays, rows without an id before none; of several rows with that id exactly
    one stays. `carry` adds the row itself as a struct `row`. Ids may be of any type that has an
    order. Other columns play no part, whatever their names; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    marked = scratch.store("marked", _marked(docs, id_column, text_column, carry))
    first = marked.select(
        "run", *KEY, F.struct("id", "tag").alias("best"), F.lit(1).cast("long").alias("rows")
    )
    levels = [scratch.store("runs-0", _merged(first))]
    last = marked.agg(F.max("run")).first()[0] or 0
    while last:
        last >>= bits
        joined = levels[-1].withColumn("run", F.shiftright("run", bits))
        levels.append(scratch.store(f"runs-{len(levels)}", _merged(joined)))

    answers = levels[-1]
    for entries in reversed(levels[:-1]):
        asked = entries.select(F.col("run").alias("own"), F.shiftright("run", bits).alias("run"), *KEY)
        found = asked.join(answers, ["run", *KEY])
        answers = found.select(F.col("own").alias("run"), *KEY, "best", "rows")
    if len(levels) > 1:
        answers = scratch.store("answers", answers)
        scratch.discard(*[f"runs-{k}" for k in range(len(levels))])
    return marked.join(answers, ["run", *KEY]).select(
        F.col("id").alias("doc_id"),
        F.col("best.id").alias("keep_id"),
        F.col("rows").alias("group_size"),
        (F.col("tag") == F.col("best.tag")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        *[c for c in ("row",) if carry],
    )


def drop_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns."""
    return exact_groups(docs, id_column, text_column, carry=True).where("kept").select("row.*")
