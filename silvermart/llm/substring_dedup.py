"""Removal of word sequences that stand elsewhere too, with suffix automata over reference shards.

A window is `LEAST` words in a row. Two equal windows hold the same `GRAM` words of smallest hash, the
window's anchor, at the same place; so equal windows have equal anchors and every window has exactly
one. Neighbouring windows with one anchor form a run of at most `LEAST - GRAM + 1` windows, and only
runs that share their anchor with another run can hold repeated windows.

Runs whose words are equal as a whole repeat as a whole, which counting tells. What is left is an
anchor with different runs, mostly the edges of repeated passages. Those runs are the reference. It
is cut into shards of bounded size, all runs of an anchor in one, and the shard's suffix automaton
knows how often each sequence of its words occurs. The single runs of the documents are streamed
through the automaton of their shard; where the matching statistic reaches `LEAST` words in a state
that occurs twice or more, the window repeats. An automaton is handed to the one task that streams
against it: all of them together grow with the corpus and could not be sent everywhere.

An anchor with more than `MOST_RUNS` different runs would not fit a shard. The windows of those runs
are counted by two hashes each, which needs no group in one place, and gives the same answer.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from silvermart.llm.common import Scratch, add_columns, text_parts
from silvermart.llm.spans import _BACK, _STEP, U, _power, mixed, windows, words

LEAST = 35
GRAM = 8
PER_RUN = LEAST - GRAM + 1
# An automaton holds at most this many words, or the runs of one anchor.
SHARD_WORDS = 200_000
MOST_RUNS = 2_000

_PLACE_BITS = 28
_WORD = re.compile(r"[^\x20\x09-\x0D]+")

# A run's place: its first word, and in the low bits its length less 1.
_LENGTH_BITS = 5


def runs(texts: list[str | None]) -> tuple[np.ndarray, ...]:
    """All runs of the texts: text, first word, windows, anchor and hash of all its words."""
    found = words(texts)
    h, of = found.hashes, found.text_of()
    n = len(h) - LEAST + 1
    if n <= 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty, empty
    gram = windows(h, GRAM)
    low = (U(1) << U(_PLACE_BITS)) - U(1)
    least = (gram & ~low) | np.arange(len(gram), dtype=np.uint64)
    width = 1
    while 2 * width <= PER_RUN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < PER_RUN:
        rest = PER_RUN - width
        least = np.minimum(least[:-rest], least[rest:])
    at = (least & low).astype(np.int64)
    valid = of[:n] == of[LEAST - 1 :]
    opens = valid.copy()
    opens[1:] &= ~valid[:-1] | (at[1:] != at[:-1])
    starts = np.flatnonzero(opens)
    # A run ends where the next one opens or the text has no more windows.
    edge = np.flatnonzero(np.r_[opens[1:] | ~valid[1:], True])
    stops = edge[np.searchsorted(edge, starts)] + 1
    count = stops - starts
    ends = stops + LEAST - 1
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _power(_STEP, len(h)), out=total[1:])
    whole = mixed(
        (total[ends] - total[starts]) * _power(_BACK, len(h))[starts] + count.astype(U)
    )
    text = of[starts]
    return (
        text,
        starts - found.first[text],
        count,
        gram[at[starts]].view(np.int64),
        whole.view(np.int64),
    )


def _key(docs: DataFrame, id_column: str, text_column: str) -> list[Column]:
    """The id and the text's hash, which tells rows with equal ids, or without one, apart."""
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    return [
        F.coalesce(F.col(f"`{id_column}`").cast("long"), F.lit(-(1 << 63))).alias("__doc"),
        F.xxhash64(text).alias("__part"),
    ]


def find_runs(keyed: DataFrame) -> DataFrame:
    """One row per run: anchor, whole, doc, part, place."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in text_parts(batch, "text"):
                text, start, count, anchor, whole = runs(rows.column("text").to_pylist())
                doc, part = rows.column("__doc").to_numpy(), rows.column("__part").to_numpy()
                place = (start << _LENGTH_BITS) | (count - 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (anchor, whole, doc[text], part[text], place)],
                    names=["anchor", "whole", "doc", "part", "place"],
                )

    return keyed.mapInArrow(read, "anchor long, whole long, doc long, part long, place long")


def _start(place: Column) -> Column:
    return F.shiftright(place, _LENGTH_BITS)


def _count(place: Column) -> Column:
    return place.bitwiseAND(F.lit((1 << _LENGTH_BITS) - 1)) + 1


class Automaton:
    """Suffix automaton of several word sequences, with how often each of its sequences occurs."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.seen = [-1], [0], [0]
        self.order: list[int] | None = None

    def _state(self, length: int, like: int | None = None) -> int:
        self.next.append({} if like is None else dict(self.next[like]))
        self.link.append(-1 if like is None else self.link[like])
        self.length.append(length)
        self.seen.append(0)
        return len(self.length) - 1

    def _split(self, state: int, word, target: int) -> int:
        """A state of its own for the suffixes of `target` that end here."""
        copy = self._state(self.length[state] + 1, like=target)
        self.link[target] = copy
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def add(self, sequence: Iterable, times: int) -> None:
        nexts, link, length = self.next, self.link, self.length
        last = 0
        for word in sequence:
            known = nexts[last].get(word)
            if known is not None:
                if length[known] != length[last] + 1:
                    known = self._split(last, word, known)
                last = known
            else:
                fresh, state = self._state(length[last] + 1), last
                while state >= 0 and word not in nexts[state]:
                    nexts[state][word] = fresh
                    state = link[state]
                if state < 0:
                    link[fresh] = 0
                else:
                    target = nexts[state][word]
                    link[fresh] = (
                        target
                        if length[target] == length[state] + 1
                        else self._split(state, word, target)
                    )
                last = fresh
            self.seen[last] += times

    def close(self) -> None:
        """Adds up the occurrences; nothing can be added afterwards."""
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            self.seen[self.link[state]] += self.seen[state]

    def repeats(self, sequence: Iterable, least: int) -> Iterator[int]:
        """The ends (exclusive) of stretches of `least` words that occur twice or more."""
        nexts, link, length, seen = self.next, self.link, self.length, self.seen
        state = matched = 0
        for end, word in enumerate(sequence, 1):
            while state and word not in nexts[state]:
                state = link[state]
                matched = length[state]
            if word in nexts[state]:
                state, matched = nexts[state][word], matched + 1
            if matched >= least:
                while length[link[state]] >= least:
                    state = link[state]
                matched = min(matched, length[state])
                if seen[state] >= 2:
                    yield end


def _masks(shard: list[tuple[int, int, int, str]], least: int) -> Iterator[tuple[int, int, int]]:
    """(anchor, whole, mask) of the single runs of a shard that hold repeated windows."""
    automaton = Automaton()
    sequences = [text.split(" ") for *_, text in shard]
    for (_, _, times, _), sequence in zip(shard, sequences):
        automaton.add(sequence, times)
    automaton.close()
    for (anchor, whole, times, _), sequence in zip(shard, sequences):
        if times == 1:
            mask = sum(1 << (end - least) for end in automaton.repeats(sequence, least))
            if mask:
                yield anchor, whole, mask


def _by_automata(reference: DataFrame, least: int, shard_words: int) -> DataFrame:
    """Masks of single runs, (anchor, whole, mask); bit i is the run's i-th window."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard: list[tuple[int, int, int, str]] = []
        held, last = 0, None

        def answer() -> pd.DataFrame:
            return pd.DataFrame(
                list(_masks(shard, least)), columns=["anchor", "whole", "mask"]
            ).astype("int64")

        for batch in batches:
            for row in batch[["anchor", "whole", "times", "words"]].itertuples(index=False):
                if held >= shard_words and row.anchor != last:
                    yield answer()
                    shard, held = [], 0
                shard.append((row.anchor, row.whole, row.times, row.words))
                held += row.words.count(" ") + 1
                last = row.anchor
        yield answer()

    # All runs of an anchor in one task, and there next to each other.
    return (
        reference.repartition("anchor")
        .sortWithinPartitions("anchor")
        .mapInPandas(read, "anchor long, whole long, mask long")
    )


def _by_counting(reference: DataFrame, least: int) -> DataFrame:
    """The same for anchors with very many runs: windows counted by two hashes."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = words(list(batch["words"]))
            at = np.flatnonzero(
                found.text_of()[: max(0, len(found.hashes) - least + 1)]
                == found.text_of()[least - 1 :]
            )
            of = found.text_of()[at]
            yield pd.DataFrame(
                {
                    "anchor": batch["anchor"].to_numpy()[of],
                    "whole": batch["whole"].to_numpy()[of],
                    "times": batch["times"].to_numpy()[of],
                    "bit": at - found.first[of],
                    "one": windows(found.hashes, least)[at].view(np.int64),
                    "two": windows(found.hashes[::-1], least)[::-1][at].view(np.int64),
                }
            )

    each = reference.mapInPandas(
        read, "anchor long, whole long, times long, bit long, one long, two long"
    )
    one = F.lit(1).cast("long")
    repeated = (
        each.groupBy("anchor", "one", "two").agg(F.sum("times").alias("all")).where("all >= 2")
    )
    return (
        each.join(repeated.drop("all"), ["anchor", "one", "two"], "left_semi")
        .groupBy("anchor", "whole")
        .agg(F.bit_or(F.call_function("shiftleft", one, F.col("bit").cast("int"))).alias("mask"))
    )


def _reference(kinds: DataFrame, keyed: DataFrame, least: int) -> DataFrame:
    """The words of one run of each kind: anchor, whole, times, variants, words."""
    wanted = (
        kinds.where("variants >= 2")
        .select("anchor", "whole", "times", "variants", "one.doc", "one.part", "one.place")
        .groupBy(F.col("doc").alias("__doc"), F.col("part").alias("__part"))
        .agg(
            F.collect_list(
                F.struct(
                    "anchor",
                    "whole",
                    "times",
                    "variants",
                    _start(F.col("place")).alias("start"),
                    _count(F.col("place")).alias("count"),
                )
            ).alias("runs")
        )
    )

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, own in zip(batch["text"], batch["runs"]):
                split = _WORD.findall(text)
                for r in own:
                    span = split[r["start"] : r["start"] + r["count"] + least - 1]
                    rows.append(
                        (r["anchor"], r["whole"], r["times"], r["variants"], " ".join(span))
                    )
            yield pd.DataFrame(rows, columns=["anchor", "whole", "times", "variants", "words"])

    # Rows with equal id and text are one key; either serves.
    return (
        keyed.join(wanted, ["__doc", "__part"])
        .select("text", "runs")
        .mapInPandas(read, "anchor long, whole long, times long, variants long, words string")
        .dropDuplicates(["anchor", "whole"])
    )


def _cut(rows: DataFrame, text_column: str, least: int) -> DataFrame:
    """What the removed windows leave of every text; `__runs` says which windows repeat."""
    def cut(text: str | None, own) -> tuple[int, int, list[dict], str]:
        split = _WORD.findall(text) if text else []
        if own is None or not len(own):
            return len(split), 0, [], " ".join(split)
        edge = np.zeros(len(split) + 1, np.int64)
        for r in own:
            for i in range(r["count"]):
                if r["mask"] >> i & 1:
                    edge[r["start"] + i] += 1
                    edge[r["start"] + i + least] -= 1
        gone = np.cumsum(edge[:-1]) > 0
        turns = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
        spans = [{"from": int(a), "to": int(b)} for a, b in zip(turns[::2], turns[1::2])]
        kept = " ".join([w for w, g in zip(split, gone) if not g])
        return len(split), int(gone.sum()), spans, kept

    def read(batch: pa.RecordBatch):
        span = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
        kinds = (pa.int64(), pa.int64(), span, pa.string())
        for part in text_parts(batch, text_column):
            texts, own = part.column(text_column).to_pylist(), part.column("__runs").to_pylist()
            found = [cut(t, r) for t, r in zip(texts, own)]
            yield part, [pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)]

    span = T.StructType([T.StructField("from", T.LongType()), T.StructField("to", T.LongType())])
    fields = [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("spans", T.ArrayType(span)),
        T.StructField("kept", T.StringType()),
    ]
    return add_columns(rows, fields, read, without=("__runs", "__doc", "__part"))


def remove_repeats(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    least: int = LEAST,
    shard_words: int = SHARD_WORDS,
    most_runs: int = MOST_RUNS,
) -> DataFrame:
    """`docs` with what is left of every text: n_words, n_removed, spans and kept.

    `spans` are the removed stretches of words, [from, to); `kept` are the other words with one
    space between. A word goes when a window of `least` words that covers it also starts anywhere
    else, in the same document or another; every copy loses it. NULL texts have no words; rows with
    equal ids are told apart by their texts; repeated rows are copies of each other; texts of fewer
    than `least` words stay as they are; an empty table stays empty.
    """
    if least != LEAST:
        raise ValueError(f"windows have {LEAST} words")
    scratch = Scratch(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("n_words", "n_removed", "spans", "kept")]
    key = _key(docs, id_column, text_column)
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    keyed = docs.select(*key, text.alias("text"))

    found = scratch.store("runs", find_runs(keyed))
    # Stored by itself, so that the join below can split an anchor that very many runs share.
    often = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").drop("n")
    often = scratch.store("often", often)
    shared = scratch.store("shared", found.join(often, "anchor", "left_semi"))
    scratch.discard("runs", "often")

    kinds = shared.groupBy("anchor", "whole").agg(
        F.count(F.lit(1)).alias("times"), F.min(F.struct("doc", "part", "place")).alias("one")
    )
    variants = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("variants"))
    kinds = scratch.store("kinds", kinds.join(variants, "anchor"))
    reference = scratch.store("reference", _reference(kinds, keyed, least))
    few = F.col("variants") <= most_runs
    masks = _by_automata(reference.where(few), least, shard_words).unionByName(
        _by_counting(reference.where(~few & (F.col("variants") > 0)), least)
    )
    whole = kinds.where("times >= 2").select(
        "anchor", "whole", F.lit((1 << PER_RUN) - 1).cast("long").alias("mask")
    )
    single = masks.join(kinds.where("times = 1"), ["anchor", "whole"], "left_semi")
    decided = scratch.store("decided", whole.unionByName(single))

    removed = (
        shared.join(decided, ["anchor", "whole"])
        .groupBy(F.col("doc").alias("__doc"), F.col("part").alias("__part"))
        .agg(
            F.collect_set(
                F.struct(
                    _start(F.col("place")).alias("start"),
                    _count(F.col("place")).alias("count"),
                    "mask",
                )
            ).alias("__runs")
        )
    )
    rows = docs.select(*[F.col(f"`{c}`") for c in names], *key)
    return _cut(rows.join(removed, ["__doc", "__part"], "left"), text_column, least)
