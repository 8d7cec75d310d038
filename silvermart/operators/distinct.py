"""Distinct rows of a stored table, of which only the repeated ones are shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silvermart.operators.attach import broadcast_limit
from silvermart.sources.store import StoredTable, TableStore

DIGEST = "_row_digest"

# Marks of digests: a long array of bits, cut into slots of WORDS words of 64 bits.
SLOT, MARKS = "_row_digest_slot", "_row_digest_marks"
WORDS = 512
SLOT_BITS = 64 * WORDS
# So many bits for each digest, if the broadcast limit allows it; one mark in as many is false then.
BITS_PER_DIGEST = 16


def distinct_by_digest(table: StoredTable, store: TableStore) -> DataFrame:
    """Each row of `table` once, by all its columns; NULLs are equal.

    A first pass counts digests of 64 bits, eight bytes per different row in the shuffle. Rows whose
    digest is met once are no duplicates and stay where they were read; the others go through a
    plain distinct of whole rows. So rows that share a digest by chance are compared as a whole and
    both stay. Where the repeated digests are too many to broadcast, one bit for each of them is
    broadcast instead: rows whose bit is not set stay, and the few that have another digest's bit go
    through the distinct without need. Where even the bits are too many, most rows would have to move
    in any case, and all go through the plain distinct. `table` is read three times, and so it has to be
    a stored one. An empty table gives no rows; columns may have any names that do not begin with that
    of the digest.
    """
    rows = store.open(table)
    if not table.rows:
        return rows
    tagged = rows.withColumn(DIGEST, F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]))
    repeated = store.write(
        "repeated_digests",
        tagged.groupBy(DIGEST).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(DIGEST),
    )
    if not repeated.rows:
        return rows
    limit = broadcast_limit(store.spark)
    if repeated.bytes > limit:
        wanted = max(BITS_PER_DIGEST * repeated.rows, SLOT_BITS)
        bits = min(8 * limit, wanted) // SLOT_BITS * SLOT_BITS
        if bits < 2 * repeated.rows:
            return rows.distinct()
        marked = _marked(tagged, store.open(repeated), bits, store)
        single = marked.where(~F.col(DIGEST))
        several = marked.where(DIGEST).distinct()
        return single.unionByName(several).drop(DIGEST)
    digests = F.broadcast(store.open(repeated))
    single = tagged.join(digests, DIGEST, "left_anti")
    several = tagged.join(digests, DIGEST, "left_semi").distinct()
    return single.unionByName(several).drop(DIGEST)


def _place(bits: int) -> Column:
    """The bit that stands for a digest."""
    return F.pmod(F.col(DIGEST), F.lit(bits).cast("long"))


def _word(bits: int) -> Column:
    """Its word in the slot."""
    return F.shiftright(_place(bits), 6).bitwiseAND(F.lit(WORDS - 1).cast("long"))


def _bit(bits: int) -> Column:
    """Its bit in the word."""
    return _place(bits).bitwiseAND(F.lit(63).cast("long")).cast("int")


def _marked(tagged: DataFrame, digests: DataFrame, bits: int, store: TableStore) -> DataFrame:
    """`tagged` with, in place of the digest, whether its bit is set."""
    slot = F.shiftright(_place(bits), SLOT_BITS.bit_length() - 1).alias(SLOT)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), _bit(bits))
    words = digests.groupBy(slot, _word(bits).alias("word")).agg(F.bit_or(one).alias("bits"))
    by_word = F.map_from_entries(F.collect_list(F.struct("word", "bits")))
    every = F.sequence(F.lit(0).cast("long"), F.lit(WORDS - 1).cast("long"))
    none = F.lit(0).cast("long")
    slots = words.groupBy(SLOT).agg(by_word.alias("by_word")).select(
        SLOT,
        F.transform(every, lambda w: F.coalesce(F.try_element_at("by_word", w), none)).alias(MARKS),
    )
    slots = store.open(store.write("marked_digests", slots))
    word = F.get(F.col(MARKS), _word(bits).cast("int"))
    is_set = F.coalesce(F.getbit(word, _bit(bits)) == 1, F.lit(False))
    # At most as many bytes as the broadcast limit. A slot without repeated digests has no entry.
    found = tagged.withColumn(SLOT, slot).join(F.broadcast(slots), SLOT, "left")
    return found.withColumn(DIGEST, is_set).drop(SLOT, MARKS)
