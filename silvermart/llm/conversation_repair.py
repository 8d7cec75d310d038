"""Cheapest repair of the turn structure of conversations, with an audit of the edits.

A dynamic programme over the rows of a conversation keeps, for each state of the wanted structure
`(s?(ua)+)?`, the cheapest edits so far and among those the ASCII-least. Edits are not kept as texts:
every prefix is a node linked to the prefix it extends, so all states share what they have in common
(a persistent list). A node knows its ancestors at distances of powers of two and a rolling hash of
its text, so two prefixes of equal cost are compared by searching for their longest common prefix;
where hashes agree, the links are followed until they meet, so a collision cannot decide.

Conversations are cut into blocks of bounded size. A block gives, for each state before it and each
state after it, the cheapest edits between: such tables join like products, so a conversation of any
length is put together from its blocks, in a pass that sees a row per block. Texts do not take part;
they are read once more, in order, for the digest of the repaired conversation, which has to see
them one after the other and holds one batch at a time. The audit of a conversation is one value, a
byte per edit, and has to fit a task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from silvermart.llm.common import SPACES, Scratch
from silvermart.llm.numbering import numbered

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
TRUNCATED_COST = 5
ROLES = {"u": "user", "a": "assistant"}
# States of the structure: nothing yet, after s, after u, after a. Where a role's initial leads:
START, SYSTEM, USER, ASSISTANT = range(4)
STEPS = {
    "s": {START: SYSTEM},
    "u": {START: USER, SYSTEM: USER, ASSISTANT: USER},
    "a": {USER: ASSISTANT},
}
COMPLETE = (START, ASSISTANT)
ALLOWED_PAIRS = {"su", "ua", "au"}
# Rows of a conversation that are repaired in one piece.
BLOCK = 512

_BASE, _PRIME = 1_000_003, (1 << 61) - 1


class Trails:
    """Texts that grow at their end and share their beginnings; node 0 is the empty text.

    A link adds a piece: one edit within a block, a block's edits when blocks are put together.
    """

    def __init__(self, prime: int = _PRIME):
        self.prime = prime
        self.parent, self.piece, self.note = [0], [""], [None]
        self.depth, self.length, self.hash = [0], [0], [0]
        self.jumps: list[list[int]] = [[]]  # ancestors at distances 1, 2, 4, ...

    def add(self, node: int, piece: str, note=None) -> int:
        value = self.hash[node]
        for c in piece:
            value = (value * _BASE + ord(c)) % self.prime
        jumps, far, k = [node], node, 0
        while node and k < len(self.jumps[far]):
            far = self.jumps[far][k]
            jumps.append(far)
            if not far:
                break
            k += 1
        self.parent.append(node)
        self.piece.append(piece)
        self.note.append(note)
        self.depth.append(self.depth[node] + 1)
        self.length.append(self.length[node] + len(piece))
        self.hash.append(value)
        self.jumps.append(jumps)
        return len(self.parent) - 1

    def at(self, node: int, depth: int) -> int:
        """The ancestor at a depth."""
        while (rest := self.depth[node] - depth) > 0:
            node = self.jumps[node][min(rest.bit_length(), len(self.jumps[node])) - 1]
        return node

    def links(self, node: int, depth: int = 0) -> list[int]:
        """The nodes from below a depth to the node itself."""
        found = []
        while self.depth[node] > depth:
            found.append(node)
            node = self.parent[node]
        return found[::-1]

    def text(self, node: int, depth: int = 0) -> str:
        return "".join(self.piece[x] for x in self.links(node, depth))

    def _alike(self, a: int, b: int) -> bool:
        return a == b or (self.length[a], self.hash[a]) == (self.length[b], self.hash[b])

    def _same(self, a: int, b: int) -> bool:
        """Whether two nodes of one depth have the same text, by following links to where they meet."""
        while a != b and self.piece[a] == self.piece[b]:
            a, b = self.parent[a], self.parent[b]
        return a == b or self.text(a) == self.text(b)

    def common(self, a: int, b: int) -> int:
        """A depth to which both have the same text: of links of one edit each, the largest.

        The search halves the distance and goes by the hashes; its end is verified, and if a
        collision has misled it, nothing counts as common.
        """
        depth = min(self.depth[a], self.depth[b])
        a, b = self.at(a, depth), self.at(b, depth)
        if not self._alike(a, b):
            k = len(self.jumps[a]) - 1
            while k >= 0:
                if k < min(len(self.jumps[a]), len(self.jumps[b])):
                    x, y = self.jumps[a][k], self.jumps[b][k]
                    if not self._alike(x, y):
                        a, b = x, y
                k -= 1
            a, b = self.parent[a], self.parent[b]
        return self.depth[a] if self._same(a, b) else 0

    def less(self, a: int, b: int) -> bool:
        """Whether the text of `a` comes before that of `b`."""
        depth = self.common(a, b)
        if min(self.depth[a], self.depth[b]) > depth:
            x, y = self.piece[self.at(a, depth + 1)], self.piece[self.at(b, depth + 1)]
            if len(x) == len(y) and x != y:
                return x < y
        return self.text(a, depth) < self.text(b, depth)


Layer = dict[int, tuple[int, int]]


def offer(trails: Trails, layer: Layer, state: int, cost: int, node: int, piece: str, note=None):
    """Take a way to a state if it is cheaper than what is known, or as cheap and ASCII-less."""
    known = layer.get(state)
    if known is None or cost < known[0]:
        layer[state] = cost, trails.add(node, piece, note)
    elif cost == known[0]:
        mine = trails.add(node, piece, note)
        if trails.less(mine, known[1]):
            layer[state] = cost, mine


def with_inserts(trails: Trails, layer: Layer) -> Layer:
    """The states that inserted rows lead to as well; two suffice to reach any of them."""
    out = dict(layer)
    for start in (START, SYSTEM, ASSISTANT):
        if start in out:
            offer(trails, out, USER, out[start][0] + COST[INSERT], out[start][1], INSERT)
    if USER in out:
        offer(trails, out, ASSISTANT, out[USER][0] + COST[INSERT], out[USER][1], INSERT)
    return out


def after_row(trails: Trails, layer: Layer, initial: str, must_go: bool, truncated: bool) -> Layer:
    """The states after one more row."""
    out: Layer = {}
    extra = TRUNCATED_COST if truncated else 0
    for state, (cost, node) in layer.items():
        offer(trails, out, state, cost + COST[DELETE], node, DELETE)
        if must_go:
            continue
        if state in STEPS.get(initial, {}):
            offer(trails, out, STEPS[initial][state], cost + COST[KEEP] + extra, node, KEEP)
        for role in ROLES:
            if role != initial and state in STEPS[role]:
                offer(trails, out, STEPS[role][state], cost + COST[REROLE] + extra, node, REROLE)
    return out


def moves_of(rows: list[tuple[str, bool, bool]], starts: Iterable[int]) -> list[tuple]:
    """(state before, state after, cost, edits) of a block's rows (initial, must go, truncated)."""
    found = []
    for start in starts:
        trails = Trails()
        layer: Layer = {start: (0, 0)}
        for initial, must_go, truncated in rows:
            layer = after_row(trails, with_inserts(trails, layer), initial, must_go, truncated)
        found += [(start, s, cost, trails.text(node)) for s, (cost, node) in layer.items()]
    return found


def chosen(blocks: Iterable[list[tuple]]) -> tuple[int, list[tuple[int, str]]]:
    """The cost of the best repair, and per block the state before it and its edits."""
    trails = Trails()
    layer: Layer = {START: (0, 0)}
    for moves in blocks:
        out: Layer = {}
        for before, after, cost, edits in moves:
            if before in layer:
                offer(trails, out, after, layer[before][0] + cost, layer[before][1], edits, before)
        layer = out
    layer = with_inserts(trails, layer)
    best = None
    for state in COMPLETE:
        if state in layer:
            cost, node = layer[state]
            if best is None or cost < best[0] or (cost == best[0] and trails.less(node, best[1])):
                best = cost, node
    cost, node = best
    pieces: list[tuple[int, str]] = []
    for link in trails.links(node):
        if trails.note[link] is None:  # inserted at the end
            before, edits = pieces.pop() if pieces else (START, "")
            pieces.append((before, edits + trails.piece[link]))
        else:
            pieces.append((trails.note[link], trails.piece[link]))
    return cost, pieces


def repaired(rows: Iterable[tuple[str, str]], state: int, edits: str) -> Iterator[tuple[str, str]]:
    """The (role, text) that edits make of rows, from a state on; the rows are read as needed."""
    rows = iter(rows)
    for edit in edits:
        role, text = ("", "") if edit == INSERT else next(rows)
        if edit == DELETE:
            continue
        initial = role[:1] if edit == KEEP else "a" if state == USER else "u"
        yield (role if edit == KEEP else ROLES[initial]), text
        state = STEPS[initial][state]


# -- tasks -----------------------------------------------------------------------------------


def _tuples(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch.column(c).to_pylist() for c in columns])


BLOCK_SCHEMA = (
    "conv string, block long, blank long, duplicate long, truncated long, illegal long, "
    "first string, last string, low long, high long, turns long, "
    "moves array<struct<before: int, after: int, cost: long, edits: string>>"
)


def _judged(conv: str, block: int, rows: Iterable[tuple]) -> dict:
    """A block's faults and moves, from its rows in order."""
    faults = {"blank": 0, "duplicate": 0, "truncated": 0}
    seen: set[bytes] = set()
    judged, turns, illegal = [], [], 0
    for _, _, turn, initial, blank, truncated, who, before in rows:
        repeats = before or who in seen
        seen.add(who)
        fault = "blank" if blank else "duplicate" if repeats else "truncated" if truncated else ""
        if fault:
            faults[fault] += 1
        if judged and judged[-1][0] + initial not in ALLOWED_PAIRS:
            illegal += 1
        judged.append((initial, fault in ("blank", "duplicate"), fault == "truncated"))
        if turn is not None:
            turns.append(turn)
    starts = (START,) if block == 0 else range(4)
    return {
        "conv": conv,
        "block": block,
        **faults,
        "illegal": illegal,
        "first": judged[0][0],
        "last": judged[-1][0],
        "low": min(turns, default=None),
        "high": max(turns, default=None),
        "turns": len(set(turns)),
        "moves": [
            dict(zip(("before", "after", "cost", "edits"), m)) for m in moves_of(judged, starts)
        ],
    }


CHOSEN_SCHEMA = (
    "conv string, block long, state int, edits string, gaps long, blank long, duplicate long, "
    "truncated long, illegal long, cost long, audit string"
)


def _summed(conv: str, blocks: Iterable[tuple]) -> list[dict]:
    """A row per block with its edits; the first has the conversation's figures and audit as well."""
    total = {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
    low = high = last = None
    turns = 0

    def moves() -> Iterator[list[tuple]]:
        nonlocal low, high, last, turns
        for _, _, blank, duplicate, truncated, illegal, first, end, a, b, count, found in blocks:
            total["blank"] += blank
            total["duplicate"] += duplicate
            total["truncated"] += truncated
            total["illegal"] += illegal
            if last is not None and last + first not in ALLOWED_PAIRS:
                total["illegal"] += 1
            last = end
            if a is not None:
                turns += count - (a == high)
                low = a if low is None else low
                high = b
            yield [(m["before"], m["after"], m["cost"], m["edits"]) for m in found]

    cost, pieces = chosen(moves())
    if low is not None:
        total["gaps"] = high - low + 1 - turns
    out = [
        {"conv": conv, "block": k, "state": state, "edits": edits}
        for k, (state, edits) in enumerate(pieces)
    ]
    out[0] |= total | {"cost": cost, "audit": "".join(edits for _, edits in pieces)}
    return out


def _in_groups(rows: DataFrame, keys: int, schema: str, answer) -> DataFrame:
    """`answer(key, rows)` of each run of rows with equal first columns, streamed."""
    names = rows.columns
    returned = T.StructType.fromDDL(schema)
    fields, arrow = returned.names, to_arrow_schema(returned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for key, group in groupby(_tuples(batches, names), key=lambda r: r[:keys]):
            held += answer(*key, group)
            if len(held) >= 1000:
                yield pa.RecordBatch.from_pylist(
                    [{f: h.get(f) for f in fields} for h in held], schema=arrow
                )
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(
                [{f: h.get(f) for f in fields} for h in held], schema=arrow
            )

    return rows.mapInArrow(run, returned)


def _hashed(conv: str, rows: Iterable[tuple]) -> list[dict]:
    """The digest of a conversation's repaired rows, which are read once and not held."""
    seen, first = sha256(), True
    for _, block in groupby(rows, key=lambda r: r[1]):
        head = next(block)
        state, edits = head[5], head[6]

        def texts(head=head, block=block):
            yield head[3], head[4]
            for row in block:
                yield row[3], row[4]

        for role, text in repaired(texts(), state, edits):
            seen.update(f"{'' if first else chr(10)}{role}:{text}".encode())
            first = False
    return [{"conv": conv, "repaired_sha256": seen.hexdigest()}]


# -- the operator ----------------------------------------------------------------------------


def _key(conv_id: Column) -> Column:
    """Conversations by name; those without an id are one of their own."""
    return F.when(conv_id.isNull(), "").otherwise(F.concat(F.lit("+"), conv_id.cast("string")))


def _rows(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows with their place in the conversation, block and faults."""
    text = F.coalesce(F.col("text"), F.lit(" "))
    role = F.coalesce(F.col("role"), F.lit(" "))
    trimmed = F.btrim(text, F.lit(SPACES))
    rows = conversations.select(
        _key(F.col("conv_id")).alias("conv"),
        "turn",
        role.alias("role"),
        text.alias("text"),
        F.substring(role, 1, 1).alias("initial"),
        (trimmed == "").alias("blank"),
        (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("truncated"),
        F.unhex(
            F.sha2(
                F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256
            )
        ).alias("who"),
        F.monotonically_increasing_id().alias("tag"),
    )
    rows = scratch.store("rows", rows)
    placed = numbered(rows, "conv", ["turn", "role", "who", "tag"], scratch, "sliced")
    return placed.drop("tag")


def repair(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), a row per
    conversation, from the columns conv_id, turn (whole numbers), role and text.

    Rows stand by turn, NULLs first; rows of one turn by role, then by the hash of role and text, so
    equal rows are adjacent. A NULL role or text counts as one space, so such a text is blank; rows
    without a conv_id are one conversation. Equal rows are duplicates but for the first. An empty
    table gives an empty result. Other columns play no part.
    """
    spark = conversations.sparkSession
    scratch = Scratch(spark)
    rows = scratch.store(
        "placed",
        _rows(conversations, scratch).withColumn("block", F.floor(F.col("place") / block)),
    )

    # Rows seen in an earlier block; a conversation of one block has none.
    where = rows.where(F.col("total") > block).select("conv", "who", "block").distinct()
    first = where.groupBy("conv", "who").agg(F.min("block").alias("first"))
    again = where.join(first, ["conv", "who"]).where("block > first")
    again = scratch.store("again", again.select("conv", "who", "block", F.lit(True).alias("before")))
    judged = rows.select("conv", "block", "place", "turn", "initial", "blank", "truncated", "who").join(
        again, ["conv", "who", "block"], "left"
    )
    in_blocks = (
        judged.repartition("conv", "block")
        .sortWithinPartitions("conv", "block", "place")
        .select("conv", "block", "turn", "initial", "blank", "truncated", "who", "before")
    )
    blocks = scratch.store(
        "blocks", _in_groups(in_blocks, 2, BLOCK_SCHEMA, lambda c, b, g: [_judged(c, b, g)])
    )
    ordered = blocks.repartition("conv").sortWithinPartitions("conv", "block")
    found = scratch.store("chosen", _in_groups(ordered, 1, CHOSEN_SCHEMA, _summed))

    edits = found.select("conv", "block", "state", "edits")
    texts = (
        rows.select("conv", "block", "place", "role", "text")
        .join(edits, ["conv", "block"])
        .repartition("conv")
        .sortWithinPartitions("conv", "place")
        .select("conv", "block", "place", "role", "text", "state", "edits")
    )
    hashes = _in_groups(texts, 1, "conv string, repaired_sha256 string", _hashed)
    figures = found.where("block = 0").drop("block", "state", "edits")
    return figures.join(hashes, "conv")


def repair_all(conversations: DataFrame, damaged: DataFrame, block: int = BLOCK) -> DataFrame:
    """`repair` of `damaged` for every conversation of the original, also one that has lost all."""
    ids = conversations.select("conv_id").distinct().withColumn("conv", _key(F.col("conv_id")))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    nothing = sha256(b"").hexdigest()
    return ids.join(repair(damaged, block), "conv", "left").select(
        "conv_id",
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"),
    )


def damage(conversations: DataFrame, kinds: int = 20) -> DataFrame:
    """Conversations with planted faults, by the crc32 of `conv_id:turn` modulo `kinds`.

    0 drops a row, 1 empties its text, 2 removes its sentence marks, 3 repeats it, 4 makes it the
    user's. NULLs are read as one space, in the key as in role and text.
    """
    space = F.lit(" ")
    known = {c: F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn", "role", "text")}
    key = F.concat(known["conv_id"], F.lit(":"), known["turn"])
    text = (
        F.when(F.col("fault") == 1, "")
        .when(F.col("fault") == 2, F.translate(known["text"], ".!?", ""))
        .otherwise(known["text"])
    )
    times = F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    narrow = conversations.select("conv_id", "turn", "role", "text")
    marked = narrow.withColumn("fault", F.crc32(key.cast("binary")) % kinds).where("fault <> 0")
    return marked.select(
        "conv_id",
        "turn",
        F.when(F.col("fault") == 4, "user").otherwise(known["role"]).alias("role"),
        text.alias("text"),
        F.explode(times).alias("copy"),
    ).drop("copy")
