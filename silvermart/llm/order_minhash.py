"""Order MinHash fingerprints in DataFrame functions alone.

A text becomes its k-mers of words, each with the number of its occurrence, so that repeated
k-mers count as different ones. Each of `SKETCHES` orders picks the `PICKED` smallest hashes,
puts the picked k-mers back into text order and hashes that tuple. Two texts share a component when
the same k-mers win in both and stand in the same order, so the share of equal components falls
with the edit distance and not only with the overlap.

All orders come from one hash: order i is the hash shifted round its range by i / SKETCHES, so the
smallest under order i are the first ones from that point on in a single sorted array.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silvermart.llm.common import below, free_names, let, words_of

WORDS_PER_KMER = 2
SKETCHES = 32
PICKED = 2
# Low bits of a k-mer's number that hold its place; the others are its hash, the same for any text.
PLACE_BITS = 24

LONG = "bigint"
NO_KMERS = 0  # the component of a text without words


def _shift_left(value: Column, by: Column) -> Column:
    return F.call_function("shiftleft", value, by)


def _shift_right(value: Column, by: Column) -> Column:
    return F.call_function("shiftrightunsigned", value, by)


def add_fingerprint(rows: DataFrame, text: str, column: str) -> DataFrame:
    """Adds the fingerprint of a text column: `SKETCHES` integers, equal for equal texts.

    NULL counts as empty; a text without words has the same component throughout. A text of fewer
    words than a k-mer has is one k-mer. Beyond 2^PLACE_BITS words, places are counted modulo that.
    A column of the new name is replaced, others stay whatever their names.
    """
    words_, count_, kmers_, order_, first_ = free_names(
        rows.columns, "_words", "_count", "_kmers", "_order", "_first"
    )
    rows = rows.withColumn(words_, words_of(F.col(text)))
    w, n = F.col(words_), F.size(words_)
    count = F.greatest(n - (WORDS_PER_KMER - 1), F.least(n, F.lit(1)))
    rows = rows.withColumn(count_, count)
    bits = F.lit(PLACE_BITS)
    mask = F.lit((1 << PLACE_BITS) - 1).cast(LONG)

    def kmer(x: Column, i: Column) -> Column:
        hashed = F.xxhash64(x, *[F.get(w, i + k) for k in range(1, WORDS_PER_KMER)])
        return _shift_left(hashed, bits).bitwiseOR(i.cast(LONG).bitwiseAND(mask))

    rows = rows.withColumn(kmers_, F.transform(F.slice(w, F.lit(1), F.col(count_)), kmer))
    rows = rows.withColumn(kmers_, F.sort_array(kmers_))
    ordered = F.col(kmers_)

    # The occurrence number of a k-mer: how far it is from the first of its kind.
    def numbered(x: Column, j: Column) -> Column:
        kind = _shift_left(_shift_right(x, bits), bits)
        repeated = F.coalesce(
            _shift_right(x.bitwiseXOR(F.get(ordered, j - 1)), bits) == 0, F.lit(False)
        )
        nth = F.when(repeated, j - below(ordered, kind, bits=31)).otherwise(F.lit(0))
        fresh = F.xxhash64(_shift_right(x, bits), nth)
        return _shift_left(fresh, bits).bitwiseOR(x.bitwiseAND(mask))

    rows = rows.withColumn(order_, F.transform(ordered, numbered))
    rows = rows.withColumn(order_, F.sort_array(order_))
    order = F.col(order_)

    # Only the first PICKED of each stretch of the range can be picked by any order.
    step = (1 << 64) // SKETCHES
    edges = [-(1 << 63) + i * step for i in range(SKETCHES)]
    shift = 64 - (SKETCHES - 1).bit_length()

    def stretch(x: Column) -> Column:
        return F.call_function("shiftright", x, F.lit(shift))

    rows = rows.withColumn(
        first_,
        F.filter(
            order,
            lambda x, j: (j < PICKED) | (stretch(F.get(order, j - PICKED)) != stretch(x)),
        ),
    )
    first = F.col(first_)
    size = F.size(first)

    def component(edge: Column) -> Column:
        def picked(at: Column) -> Column:
            chosen = [F.get(first, (at + k) % size) for k in range(PICKED)]
            return F.array(*chosen)

        def hashed(values: Column) -> Column:
            # Text order, then the hashes alone.
            by_place = F.sort_array(
                F.transform(
                    values,
                    lambda v: F.struct(
                        v.bitwiseAND(mask).alias("place"), _shift_right(v, bits).alias("hash")
                    ),
                )
            )
            return let(
                by_place,
                lambda s: F.xxhash64(*[F.get(s, F.lit(k))["hash"] for k in range(PICKED)]),
            )

        return let(below(first, edge, bits=8), lambda at: let(picked(at), hashed))

    fingerprint = F.transform(F.array(*[F.lit(e).cast(LONG) for e in edges]), component)
    empty = F.array(*[F.lit(NO_KMERS).cast("int")] * SKETCHES)
    return rows.withColumn(
        column,
        F.when(size == 0, empty).otherwise(
            F.transform(
                fingerprint, lambda h: F.call_function("shiftright", h, F.lit(32)).cast("int")
            )
        ),
    ).drop(words_, count_, kmers_, order_, first_)


def likeness(one: Column, other: Column) -> Column:
    """The share of equal components, 0 to 1."""
    equal = F.zip_with(one, other, lambda a, b: (a == b).cast("int"))
    return F.aggregate(equal, F.lit(0), lambda a, x: a + x) / F.lit(float(SKETCHES))


def as_text(fingerprint: Column) -> Column:
    """Eight hexadecimal digits per component."""
    digits = F.transform(
        fingerprint,
        lambda h: F.lpad(F.lower(F.hex(h.cast(LONG).bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0"),
    )
    return F.array_join(digits, "")


def with_next(rows: DataFrame, key: str, tie: list[str], values: list[str]) -> DataFrame:
    """Adds `next_<value>` of the row that follows in descending order of `key`.

    After the last row the first one follows; NULL keys come last; equal keys are ordered by the
    `tie` columns. The rows are dealt by ranges of the key, whose bounds are quantiles, as many as
    shuffle partitions; the first row of each range is sent to the range before it as well.
    """
    spark = rows.sparkSession
    ranges = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = (
        rows.agg(
            F.percentile_approx(key, [i / ranges for i in range(1, ranges)], 50 * ranges).alias("b")
        ).first()["b"]
        or []
    )
    bounds = sorted(set(bounds))
    cuts = F.array(*[F.lit(b) for b in bounds]).cast("array<bigint>")
    held = F.col(key)
    # Range 0 holds the NULL keys, range i + 1 the keys of at least the i-th bound.
    place = F.when(held.isNull(), F.lit(0)).otherwise(
        1 + below(cuts, held, bits=max(1, len(bounds).bit_length()), equal=True)
    )
    dealt = rows.withColumn("_range", place)
    tops = {
        r["_range"]: r.top
        for r in dealt.groupBy("_range").agg(F.max(key).alias("top")).collect()
    }
    filled = sorted(tops)
    if not filled:
        follows: dict[int, int] = {}
    else:
        follows = {r: filled[bisect_right(filled, r) % len(filled)] for r in filled}
    # The ghost of a range's first row goes to the next range up, that of the top range to the end.
    top_of = F.array(*[F.lit(tops.get(i)).cast(LONG) for i in range(len(bounds) + 2)])
    goes_to = F.array(*[F.lit(follows.get(i, 0)) for i in range(len(bounds) + 2)])
    is_top = held.eqNullSafe(F.get(top_of, F.col("_range")))
    copies = F.when(
        is_top,
        F.array(
            F.struct(F.col("_range").alias("range"), F.lit(False).alias("ghost")),
            F.struct(F.get(goes_to, F.col("_range")).alias("range"), F.lit(True).alias("ghost")),
        ),
    ).otherwise(F.array(F.struct(F.col("_range").alias("range"), F.lit(False).alias("ghost"))))
    sent = dealt.select(
        *rows.columns, F.explode(copies).alias("_copy")
    ).select(*rows.columns, F.col("_copy.range").alias("_range"), F.col("_copy.ghost").alias("_ghost"))
    in_order = Window.partitionBy("_range").orderBy(
        "_ghost", F.col(key).desc_nulls_last(), *tie
    )
    follower = F.lead(F.struct(*values)).over(in_order)
    return (
        sent.withColumn("_next", follower)
        .where(~F.col("_ghost"))
        .select(*rows.columns, *[F.col(f"_next.{v}").alias(f"next_{v}") for v in values])
    )


def compare_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edit, and how alike they and the next text's are.

    `docs` has doc_id and text. The edit replaces the last third of a text by as much of the
    beginning of the next document's, in descending order of doc_id, after the last the first.
    NULL texts count as empty; two empty texts are alike; rows with equal ids follow each other
    in the order of their texts' hashes; a single row follows itself; an empty table stays empty.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = add_fingerprint(rows, "text", "fingerprint")
    rows = rows.withColumn("_tie", F.xxhash64("text"))
    rows = with_next(rows, "doc_id", ["_tie"], ["text", "fingerprint"])
    size = F.length("text")
    third = F.floor(size / 3).cast("int")
    rows = rows.select(
        "doc_id",
        size.cast(LONG).alias("n_chars"),
        "fingerprint",
        "next_fingerprint",
        F.concat(
            F.substring(F.col("text"), F.lit(1), size - third),
            F.substring(F.col("next_text"), F.lit(1), third),
        ).alias("edited"),
    )
    rows = add_fingerprint(rows, "edited", "edited_fingerprint")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("fingerprint")).alias("fingerprint"),
        as_text(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
