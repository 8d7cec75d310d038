"""Exact join of documents by the Jaccard similarity of their word n-grams.

Sets with similarity of at least `PER_CENT` differ in a bounded number of elements. The universe of
elements is hashed into segments, so two such sets are equal on all segments but that many: of any
more segments, at least one is equal (pigeonhole). Sets are compared within bands of sizes; a set
is indexed under its own band and under the band below where a smaller partner may be. From a set's
size follows how many segments it needs, and it takes the first so many, so that two sets of
different sizes share the segments that the smaller needs.

A segment is indexed by its content as a whole, which covers one difference, or with all its
one-deletion neighbours, which covers two at the price of an entry per element. Per band the
cheaper allocation counts: entries plus what segments of few elements cost in false partners, for
these are found everywhere. Empty segments are left out altogether: each set has `spare` segments
more than it needs, and one with at most `spare` empty ones loses nothing by skipping them.

Sets that share an entry are candidates. Their sizes and a parity sketch, whose distance never exceeds
the true difference, rule pairs out before any text moves; the others are verified on their whole
texts. Only connectivity is asked for, so not all pairs of a group are formed: first every set is
compared with the least of its entries' groups; then groups that are still in several parts are
searched for pairs between the parts, first for enough of them to tie the parts together, then for
all that are left.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silvermart.llm.common import Scratch, text_parts
from silvermart.llm.components import components
from silvermart.llm.spans import SPACES, U, _STEP, mixed, windows, words

GRAM = 4
PER_CENT = 85
BAND_GROWTH = 1.5
# Cost model of the index: entries a small segment's false partners are worth, and the most
# entries that one-deletion neighbours may add to a set.
FALSE_PARTNERS = 256
MOST_NEIGHBOURS = 24
# The smallest sketch, and the elements of a larger set that add a byte to it.
SKETCH_BYTES = 64
ELEMENTS_PER_BYTE = 4
# Members of an index entry that are compared in one place.
BLOCK = 1024
# Pairs that a task looks at together, beyond those of one group, and bytes of sketches.
PAIRS_AT_ONCE = 1 << 20
PAIR_BYTES = 1 << 23

_ONES = np.bitwise_count(np.arange(256, dtype=np.uint8)).astype(np.uint16)


@dataclass(frozen=True)
class Similarity:
    """Bounds that follow from a least similarity in per cent, in whole numbers."""

    per_cent: int = PER_CENT

    def most_difference(self, size: int, other: int) -> int:
        """Of two sets of these sizes that are similar enough."""
        return (100 - self.per_cent) * (size + other) // (100 + self.per_cent)

    def largest_partner(self, size: int) -> int:
        return 100 * size // self.per_cent

    def smallest_partner(self, size: int) -> int:
        return -(-self.per_cent * size // 100)

    def needed(self, size: int) -> int:
        """Differences a set must be ready for with its largest partner, and one more."""
        return self.most_difference(size, self.largest_partner(size)) + 1


@dataclass(frozen=True)
class Band:
    """Sizes from `low` to `high` and how their elements are indexed."""

    number: int
    low: int
    high: int
    deletion: int  # segments with one-deletion neighbours, the first ones
    spare: int
    whole: int  # segments indexed as a whole

    @property
    def segments(self) -> int:
        return self.deletion + self.whole


def allocate(size: int, needed: int) -> int:
    """How many segments of a set get one-deletion neighbours, by cost."""

    def cost(deletion: int) -> float:
        whole = max(0, needed - 2 * deletion)
        elements = size / (deletion + whole)
        entries = whole + deletion * (1 + elements)
        false = whole * 2**-elements + deletion * (1 + elements) * 2 ** (1 - elements)
        return entries + FALSE_PARTNERS * false

    options = [0]
    if size + needed <= MOST_NEIGHBOURS:
        options += range(1, -(-needed // 2) + 1)
    return min(options, key=cost)


@cache
def band_of(size: int, similarity: Similarity) -> Band:
    """The band a size falls in; bands depend on the similarity alone."""
    number, low = 0, 1
    while True:
        high = max(low, int(low * BAND_GROWTH))
        if size <= high:
            needed = similarity.needed(high)
            deletion = allocate(low, similarity.needed(low))
            spare = 2 + -(-needed * 3 // 100) if needed > 2 * deletion else 0
            return Band(number, low, high, deletion, spare, max(0, needed - 2 * deletion) + spare)
        number, low = number + 1, high + 1


def roles(size: int, similarity: Similarity) -> list[tuple[Band, int]]:
    """The bands a set is indexed in, and how many whole segments it takes there."""
    if similarity.needed(size) == 1 and similarity.smallest_partner(size) == size:
        return []  # similar to equal sets only
    own = band_of(size, similarity)
    found = [(own, max(0, similarity.needed(size) - 2 * own.deletion) + own.spare)]
    least = similarity.smallest_partner(size)
    band = own
    while band.low > max(1, least):
        band = band_of(band.low - 1, similarity)
        needed = similarity.most_difference(band.high, size) + 1
        found.append((band, max(0, needed - 2 * band.deletion) + band.spare))
    return found


def shingles(texts: list[str | None], gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashed n-grams of each text in ascending order, and where each text's begin.

    Words are compared without regard to the case of A-Z. A text of fewer words is one n-gram.
    """
    found = words(texts, SPACES, lower=True)
    h, of, counts = found.hashes, found.text_of(), np.diff(found.first)
    n = max(0, len(h) - gram + 1)
    inside = of[:n] == of[gram - 1 :] if n else np.zeros(0, bool)
    value, text = windows(h, gram)[inside], of[:n][inside]
    short = np.flatnonzero((counts > 0) & (counts < gram))
    if len(short):
        extra = [
            windows(h[found.first[i] : found.first[i + 1]], int(counts[i]))[0] for i in short
        ]
        value = np.r_[value, np.array(extra, np.uint64)]
        text = np.r_[text, short]
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    value, text = value[fresh], text[fresh]
    return value, np.searchsorted(text, np.arange(len(texts) + 1))


def set_hashes(value: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of every set; 0 for an empty one."""
    out = []
    for salt in (1, 2):
        total = np.zeros(len(value) + 1, np.uint64)
        np.cumsum(mixed(value + U(salt)), out=total[1:])
        size = np.diff(first).astype(U)
        out.append(np.where(size > 0, mixed(total[first[1:]] - total[first[:-1]] + size), U(0)))
    return out[0], out[1]


def sketch_bytes(sizes: np.ndarray) -> np.ndarray:
    """Bytes of the sketches of sets: a power of two, so many that differences that rule a pair out
    are not drowned by others on the same bits."""
    wanted = np.maximum(sizes // ELEMENTS_PER_BYTE, SKETCH_BYTES)
    return 1 << np.ceil(np.log2(wanted)).astype(np.int64)


def parities(value: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Per set, for each of its sketch's bits, whether an odd number of elements falls on it."""
    sizes = np.diff(first)
    length = sketch_bytes(sizes)
    start = np.r_[0, np.cumsum(length)]
    low = np.repeat(length.astype(np.uint64) * U(8) - U(1), sizes)
    key = np.repeat(start[:-1] * 8, sizes) + (mixed(value + U(7)) & low).astype(np.int64)
    odd = (np.bincount(key, minlength=int(start[-1]) * 8) & 1).astype(np.uint8)
    packed = np.packbits(odd)
    return [packed[i:j] for i, j in zip(start[:-1], start[1:])]


def folded(sketches: list[bytes], length: int) -> np.ndarray:
    """Sketches of at least so many bytes as those that fewer bits would have given, one per row."""
    out = np.zeros((len(sketches), length), np.uint8)
    for i, s in enumerate(sketches):
        out[i] = np.bitwise_xor.reduce(np.frombuffer(s, np.uint8).reshape(-1, length), axis=0)
    return out


def distances(one: list[bytes], two: list[bytes]) -> np.ndarray:
    """How many bits differ, pair by pair, on as many as the smaller sketch has."""
    out = np.zeros(len(one), np.int64)
    length = np.array([min(len(a), len(b)) for a, b in zip(one, two)], np.int64)
    for size in np.unique(length).tolist():
        at = np.flatnonzero(length == size)
        x, y = (folded([side[i] for i in at], size) for side in (one, two))
        out[at] = _ONES[x ^ y].sum(axis=1)
    return out


def entries(
    value: np.ndarray, first: np.ndarray, similarity: Similarity
) -> tuple[np.ndarray, np.ndarray]:
    """Index entries of all sets, and the set each belongs to."""
    sizes = np.diff(first)
    uses: dict[Band, list[tuple[int, int]]] = {}
    for i in np.flatnonzero(sizes):
        for band, whole in roles(int(sizes[i]), similarity):
            uses.setdefault(band, []).append((int(i), whole))
    keys, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for band, sets in uses.items():
        mine = np.array([i for i, _ in sets])
        taken = band.deletion + np.array([w for _, w in sets])
        size = sizes[mine]
        starts = np.cumsum(size) - size
        element = value[
            np.arange(int(size.sum())) + np.repeat(first[mine] - starts, size)
        ]
        at = np.repeat(np.arange(len(mine)), size)
        spread = mixed(element ^ U((band.number + 1) * _STEP & 0xFFFFFFFFFFFFFFFF))
        segment = (spread % U(band.segments)).astype(np.int64)
        use = segment < taken[at]
        at, segment, weight = at[use], segment[use], mixed(element[use] + U(3))
        cell = at * band.segments + segment
        total = np.zeros(len(mine) * band.segments, np.uint64)
        np.add.at(total, cell, weight)
        held = np.bincount(cell, minlength=len(total))
        grid = np.arange(len(total))
        place, owner = grid % band.segments, grid // band.segments
        label = mixed(
            U((band.number + 1) << 32) + np.arange(band.segments, dtype=np.uint64)
        )

        inside = place < taken[owner]
        empty = inside & (held == 0) & (place >= band.deletion)
        many = np.bincount(owner[empty], minlength=len(mine)) > band.spare
        chosen = inside & (~empty | many[owner])
        keys.append(mixed(total[chosen] + label[place[chosen]]))
        owners.append(mine[owner[chosen]])
        if band.deletion:
            near = segment < band.deletion
            keys.append(mixed(total[cell[near]] - weight[near] + label[segment[near]]))
            owners.append(mine[at[near]])
    return np.concatenate(keys), np.concatenate(owners)


def _texts(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(
        F.col(f"`{id_column}`").cast("long").alias("doc"),
        F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("text"),
    )


def _sets(texts: DataFrame, gram: int) -> DataFrame:
    """doc, n_shingles, two hashes and the sketch of every document."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in text_parts(batch, "text"):
                value, first = shingles(rows.column("text").to_pylist(), gram)
                one, two = set_hashes(value, first)
                sketches = parities(value, first)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("doc"),
                        pa.array(np.diff(first)),
                        pa.array(one.view(np.int64)),
                        pa.array(two.view(np.int64)),
                        pa.array([s.tobytes() for s in sketches], pa.binary()),
                    ],
                    names=["doc", "n_shingles", "one", "two", "sketch"],
                )

    return texts.mapInArrow(
        read, "doc long, n_shingles long, one long, two long, sketch binary"
    )


def _index(texts: DataFrame, gram: int, similarity: Similarity) -> DataFrame:
    """(entry, one): the index, by the hash of the set, so that equal sets are one member."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for rows in text_parts(batch, "text"):
                value, first = shingles(rows.column("text").to_pylist(), gram)
                one, _ = set_hashes(value, first)
                # Copies met again in this task need no second entry.
                fresh = [
                    i for i, h in enumerate(one.tolist()) if h not in seen and not seen.add(h)
                ]
                if len(seen) > 200_000:
                    seen.clear()
                size = np.diff(first)[fresh]
                start = np.cumsum(size) - size
                held = np.arange(int(size.sum())) + np.repeat(first[fresh] - start, size)
                key, owner = entries(value[held], np.r_[start, size.sum()], similarity)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(one[fresh][owner].view(np.int64))],
                    names=["entry", "one"],
                )

    return texts.mapInArrow(read, "entry long, one long")


def _possible(pairs: DataFrame, classes: DataFrame, similarity: Similarity) -> DataFrame:
    """The pairs (a, b) that neither their sizes nor their sketches rule out."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n, m = (batch.column(c).to_numpy() for c in ("n", "m"))
            most = (100 - similarity.per_cent) * (n + m) // (100 + similarity.per_cent)
            keep = abs(n - m) <= most
            near = np.flatnonzero(keep)
            one, two = (batch.column(c).take(pa.array(near)).to_pylist() for c in ("one", "two"))
            keep[near] = distances(one, two) <= most[near]
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    known = classes.select("cid", "n", "sketch")
    left = known.toDF("a", "n", "one")
    right = known.toDF("b", "m", "two")
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "n", "m", "one", "two")
    return both.mapInArrow(read, "a long, b long")


# Partners that are compared with one copy of a set.
PARTNERS = 64


def _verified(
    pairs: DataFrame, texts: DataFrame, gram: int, per_cent: int, scratch: Scratch, name: str
) -> DataFrame:
    """The stored pairs (a, b) whose sets are similar enough, by their whole texts.

    The text of `a` is sent once for up to about PARTNERS of its pairs, and a set with more of them
    is dealt over several tasks. Only texts of a pair move.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: tuple[int, int] | None = None
        lefts: list[np.ndarray] = []  # several where rows of one id have different texts
        for batch in batches:
            for rows in text_parts(batch, "text"):
                value, first = shingles(rows.column("text").to_pylist(), gram)
                found = []
                for i, (a, chunk, b) in enumerate(
                    zip(*[rows.column(c).to_pylist() for c in ("a", "chunk", "b")])
                ):
                    mine = value[first[i] : first[i + 1]]
                    if b is None:
                        lefts = [*(lefts if own == (a, chunk) else []), mine.copy()]
                        own = a, chunk
                        continue
                    for left in lefts if own == (a, chunk) else []:
                        common = len(np.intersect1d(left, mine, assume_unique=True))
                        union = len(left) + len(mine) - common
                        if union and 100 * common >= per_cent * union:
                            found.append((a, b))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"]
                )

    counts = pairs.groupBy("a").agg(F.ceil(F.count("b") / PARTNERS).alias("chunks"))
    dealt = pairs.join(counts, "a").select(
        "a", F.pmod(F.xxhash64("b"), F.col("chunks")).alias("chunk"), "b"
    )
    asked = pairs.select(F.col("a").alias("doc")).unionByName(pairs.select(F.col("b").alias("doc")))
    involved = scratch.store(
        f"texts-{name}", texts.join(asked.distinct(), "doc", "left_semi")
    )
    rights = dealt.join(involved.withColumnRenamed("doc", "b"), "b")
    lefts = dealt.select("a", "chunk").distinct().join(involved.withColumnRenamed("doc", "a"), "a")
    # The set itself comes before its partners.
    both = lefts.withColumn("b", F.lit(None).cast("long")).unionByName(rights)
    ordered = both.repartition("a", "chunk").sortWithinPartitions("a", "chunk", "b")
    links = scratch.store(
        f"links-{name}",
        ordered.select("a", "chunk", "b", "text").mapInArrow(read, "a long, b long"),
    )
    scratch.discard(f"texts-{name}")
    return links


def _passing(
    rows: pd.DataFrame, ends: np.ndarray, similarity: Similarity
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows of one group in different parts that neither sizes nor sketches rule out.

    `ends` says for each row where its group ends. The third array orders pairs, the closest first.
    """
    part, size, side = (rows[c].to_numpy() for c in ("part", "n", "side"))
    later = ends - np.arange(len(rows)) - 1
    i = np.repeat(np.arange(len(rows)), later)
    j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(later) - later, later)
    apart = (part[i] != part[j]) & ((side[i] != side[j]) | (side[i] == 2))
    i, j = i[apart], j[apart]
    most = (100 - similarity.per_cent) * (size[i] + size[j]) // (100 + similarity.per_cent)
    close = abs(size[i] - size[j]) <= most
    i, j, most = i[close], j[close], most[close]

    sketches = rows["sketch"].to_numpy()
    length = np.fromiter(map(len, sketches), np.int64, len(sketches))
    shorter = np.minimum(length[i], length[j])
    distance = np.zeros(len(i), np.int64)
    for least in np.unique(shorter).tolist():
        at = np.flatnonzero(shorter == least)
        used, place = np.unique(np.r_[i[at], j[at]], return_inverse=True)
        matrix = folded(list(sketches[used]), least).view(np.uint64)
        one, two = place[: len(at)], place[len(at) :]
        step = max(1, PAIR_BYTES // least)
        for k in range(0, len(at), step):
            differ = matrix[one[k : k + step]] ^ matrix[two[k : k + step]]
            distance[at[k : k + step]] = np.bitwise_count(differ).sum(axis=1)
    near = distance <= most
    return i[near], j[near], distance[near] * 4096 // (most[near] + 1)


def _search(members: DataFrame, similarity: Similarity, tie_only: bool) -> DataFrame:
    """Pairs (a, b) between parts of the groups; with `tie_only` just enough to tie them.

    `members`: group, side, cid, n, part, sketch, dealt by group. Sides 0 and 1 are the two halves
    of a pair of blocks, between which pairs are sought; side 2 is a block compared with itself.
    A group with more pairs than were needed to tie it is named in a row of its own, without a pair:
    whatever is left to compare is in such groups, for parts only ever grow together.
    """

    def tying(part: list, i: list, j: list, order: np.ndarray) -> list[int]:
        up = {p: p for p in part}

        def top(x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        kept = []
        for k in np.argsort(order, kind="stable").tolist():
            a, b = top(part[i[k]]), top(part[j[k]])
            if a != b:
                up[a] = b
                kept.append(k)
        return kept

    def pairs_of(rows: pd.DataFrame, edges: np.ndarray) -> tuple[list, list]:
        """Pairs of some groups, and the groups with more of them."""
        i, j, order = _passing(rows, np.repeat(edges[1:], np.diff(edges)), similarity)
        cid, group, part = (rows[c].to_numpy() for c in ("cid", "group", "part"))
        more = []
        if tie_only and len(i):
            kept = []
            cut = np.flatnonzero(np.r_[True, group[i[1:]] != group[i[:-1]], True])
            for k, m in zip(cut[:-1], cut[1:]):
                where = np.unique(np.r_[i[k:m], j[k:m]])
                mine = tying(
                    part[where].tolist(),
                    np.searchsorted(where, i[k:m]).tolist(),
                    np.searchsorted(where, j[k:m]).tolist(),
                    order[k:m],
                )
                kept += [k + x for x in mine]
                if len(mine) < m - k:
                    more.append(int(group[i[k]]))
            i, j = i[kept], j[kept]
        a, b = cid[i], cid[j]
        return list(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist())), more

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        seen: set = set()

        def answer(rows: pd.DataFrame) -> pd.DataFrame:
            group = rows["group"].to_numpy()
            edges = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
            size = np.diff(edges)
            upto = np.r_[0, np.cumsum(size * (size - 1) // 2)]
            out, more, k = [], [], 0
            while k < len(size):
                m = max(k + 1, int(np.searchsorted(upto, upto[k] + PAIRS_AT_ONCE, "right")) - 1)
                part = rows.iloc[edges[k] : edges[m]]
                found, left_over = pairs_of(part, edges[k : m + 1] - edges[k])
                out += found
                more += [(None, None, g) for g in left_over]
                k = m
            fresh = [p for p in dict.fromkeys(out) if p not in seen]
            if len(seen) < 1_000_000:
                seen.update(fresh)
            answers = [*[(a, b, None) for a, b in fresh], *more]
            return pd.DataFrame(answers, columns=["a", "b", "group"], dtype="Int64")

        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            group = rows["group"].to_numpy()
            last = int(np.searchsorted(group, group[-1])) if len(rows) else 0
            held = rows.iloc[last:]
            if last:
                yield answer(rows.iloc[:last])
        if held is not None and len(held):
            yield answer(held)

    # The rows are few and the work on them is not, so the partitions are not to be merged.
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = members.repartition(tasks, "group").sortWithinPartitions("group", "cid")
    return dealt.select("group", "side", "cid", "n", "part", "sketch").mapInPandas(
        read, "a long, b long, group long"
    )


def _unsettled(shared: DataFrame) -> DataFrame:
    """The members of the entries in which pairs are left once all were compared with the least.

    The least member is settled with all others, so it goes, and with it all entries of two. Entries
    of the same members are one: the sets are told apart by size and 128 bits, as texts' sets are.
    """
    held = shared.groupBy("entry").agg(
        F.min("cid").alias("first"),
        F.count("*").alias("members"),
        *[F.bit_xor(F.xxhash64(F.lit(k), "cid")).alias(f"sum{k}") for k in (1, 2)],
    )
    alike = held.where("members > 2").groupBy("first", "members", "sum1", "sum2")
    chosen = alike.agg(F.min("entry").alias("entry")).select("entry", "first")
    return shared.join(chosen, "entry").where("cid <> first").select("entry", "cid")


def _divided(shared: DataFrame, parts: DataFrame, classes: DataFrame, block: int) -> DataFrame:
    """Members of the entries whose members are in several parts, in blocks of bounded size.

    An entry with more than `block` members is cut into blocks by a hash of the member, and each
    pair of blocks is a group of its own.
    """
    own = shared.join(parts.withColumnRenamed("node", "cid"), "cid", "left").select(
        "entry", "cid", F.coalesce("least", "cid").alias("part")
    )
    split = (
        own.groupBy("entry")
        .agg(
            F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("members")
        )
        .where("low <> high")
        .select("entry", F.ceil(F.col("members") / block).cast("int").alias("blocks"))
    )
    blocks = F.col("blocks")
    mine = F.pmod(F.xxhash64("cid"), blocks).cast("int")
    placed = (
        own.join(split, "entry")
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    )
    return placed.join(classes.select("cid", "n", "sketch"), "cid").select(
        F.xxhash64("entry", F.least("mine", "other"), F.greatest("mine", "other")).alias("group"),
        F.when(F.col("mine") == F.col("other"), 2)
        .when(F.col("mine") < F.col("other"), 0)
        .otherwise(1)
        .alias("side"),
        "cid",
        "n",
        "part",
        "sketch",
    )


def link_documents(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    gram: int = GRAM,
    per_cent: int = PER_CENT,
    block: int = BLOCK,
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of `docs`.

    Two documents link when the sets of their distinct word n-grams have a Jaccard similarity of at
    least `per_cent`; the component is the least id that links lead to. NULL and empty texts have
    no n-gram and link with nothing; texts of fewer words than an n-gram has are one n-gram; rows
    with equal ids are one node; rows without an id belong to the component of an equal text with
    one, or to none (NULL); an empty table gives an empty result.
    """
    similarity = Similarity(per_cent)
    scratch = Scratch(docs.sparkSession)
    texts = _texts(docs, id_column, text_column)
    sets = scratch.store("sets", _sets(texts, gram))
    same = ["one", "two", "n_shingles"]
    # One class per distinct set; its id is the least of its documents.
    classes = scratch.store(
        "classes",
        sets.where("n_shingles > 0 and doc is not null")
        .groupBy(*same)
        .agg(F.min("doc").alias("cid"), F.first("sketch").alias("sketch"))
        .withColumnRenamed("n_shingles", "n"),
    )
    every = scratch.store("every", _index(texts, gram, similarity))
    bounds = every.groupBy("entry").agg(F.min("one").alias("low"), F.max("one").alias("high"))
    index = every.join(bounds.where("low <> high").select("entry"), "entry", "left_semi")
    shared = scratch.store(
        "shared", index.join(classes.select("one", "cid"), "one").select("entry", "cid").distinct()
    )
    scratch.discard("every")

    least = shared.groupBy("entry").agg(F.min("cid").alias("a"))
    pairs = shared.join(least, "entry").where("a <> cid").select("a", F.col("cid").alias("b"))
    pairs = scratch.store("pairs-0", _possible(pairs.distinct(), classes, similarity).distinct())
    links = _verified(pairs, texts, gram, per_cent, scratch, "0")
    tried = pairs
    parts = components(links, scratch, "parts-0")
    unsettled = scratch.store("unsettled", _unsettled(shared))
    scratch.discard("shared")
    more = None
    for turn, tie_only in ((1, True), (2, False)):
        members = _divided(unsettled, parts, classes, block)
        if more is not None:
            members = members.join(more, "group", "left_semi")
        found = scratch.store(f"found-{turn}", _search(members, similarity, tie_only))
        more = found.where("a is null").select("group").distinct()
        pairs = found.where("a <> b").select("a", "b").distinct()
        pairs = scratch.store(f"pairs-{turn}", pairs.join(tried, ["a", "b"], "left_anti"))
        links = links.unionByName(
            _verified(pairs, texts, gram, per_cent, scratch, str(turn))
        )
        tried = tried.unionByName(pairs)
        parts = components(links, scratch, f"parts-{turn}")
    scratch.discard("unsettled", "found-1", "found-2")
    scratch.discard(*[f"{kind}-{k}" for kind in ("pairs", "links") for k in range(3)])

    labelled = classes.join(
        parts.withColumnRenamed("node", "cid"), "cid", "left"
    ).select("one", "two", F.col("n").alias("n_shingles"), F.coalesce("least", "cid").alias("label"))
    labelled = labelled.groupBy(*same).agg(F.min("label").alias("label"))
    return sets.join(labelled, same, "left").select(
        F.col("doc").alias("doc_id"),
        "n_shingles",
        F.coalesce("label", "doc").alias("component_id"),
    )
