from __future__ import annotations

import heapq
import random
import re
from hashlib import sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from silvermart.llm import conversation_repair as cr
from tests.llm.conftest import SMALL

SCHEMA = "conv_id long, turn long, role string, text string"


def faults(rows):
    """First fault of each (role, text), in order."""
    seen, out = set(), []
    for role, text in rows:
        words = text.strip(" \t\n\x0b\x0c\r")
        out.append(
            "blank" if not words else "duplicate" if (role, text) in seen
            else "truncated" if words[-1] not in ".!?" else ""
        )
        seen.add((role, text))
    return out


def plain(rows):
    """Cost and audit by trying all edits in the order of cost and text."""
    found = faults(rows)
    heap, done = [(0, "", 0, 0)], set()
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        # The structure is read off the audit's own states, so the first way here is the best.
        done.add((i, state))
        if i == len(rows) and state in (0, 3):
            return cost, audit
        ways = {0: "su", 1: "u", 2: "a", 3: "u"}[state]
        to = {"s": 1, "u": 2, "a": 3}
        for c in ways:
            if c != "s":
                heapq.heappush(heap, (cost + 5, audit + "I", i, to[c]))
        if i < len(rows):
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state))
            if found[i] not in ("blank", "duplicate"):
                extra = 5 * (found[i] == "truncated")
                for c in ways:
                    if rows[i][0][:1] == c:
                        heapq.heappush(heap, (cost + extra, audit + "K", i + 1, to[c]))
                    elif c != "s":
                        heapq.heappush(heap, (cost + extra + 1, audit + "R", i + 1, to[c]))


def rebuilt(rows, audit):
    lines, rows = [], iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        shift = bool(lines) and lines[0][0][:1] == "s"
        role = role if edit == "K" else ("user", "assistant")[(len(lines) - shift) % 2]
        lines.append((role, text))
    assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in lines))
    return sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()


ROW = st.tuples(st.sampled_from(["system", "user", "assistant", "tool", ""]), st.sampled_from(["a.", "b", " ", "c?", "d!"]))


@settings(max_examples=400, deadline=None)
@given(st.lists(ROW, max_size=9))
def test_edits_are_the_cheapest_and_least(rows):
    judged = [
        (role[:1], f in ("blank", "duplicate"), f == "truncated")
        for (role, _), f in zip(rows, faults(rows))
    ]
    for size in (1, 2, 100):
        blocks = [
            cr.moves_of(judged[i : i + size], (0,) if i == 0 else range(4))
            for i in range(0, len(judged), size)
        ]
        cost, pieces = cr.chosen(blocks)
        assert (cost, "".join(p for _, p in pieces)) == plain(rows)


@pytest.mark.parametrize("prime", [2, 3, 7, (1 << 61) - 1])
def test_comparison_survives_collisions(prime):
    draw = random.Random(prime)
    trails = cr.Trails(prime)
    nodes = [0]
    for _ in range(400):
        nodes.append(trails.add(draw.choice(nodes), draw.choice("DIKR")))
    for _ in range(3000):
        a, b = draw.choice(nodes), draw.choice(nodes)
        assert trails.less(a, b) == (trails.text(a) < trails.text(b))
    pieces = cr.Trails(prime)
    nodes = [0]
    for _ in range(200):
        nodes.append(pieces.add(draw.choice(nodes), draw.choice(["", "K", "KI", "IK", "D", "DD"])))
    for _ in range(2000):
        a, b = draw.choice(nodes), draw.choice(nodes)
        assert pieces.less(a, b) == (pieces.text(a) < pieces.text(b))


def expected(rows):
    """conv_id -> figures by plain loops; rows are (conv_id, turn, role, text)."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = [(t, role if role is not None else " ", x if x is not None else " ") for c, t, role, x in rows if c == conv]
        own.sort(key=lambda r: (
            r[0] is not None, r[0] or 0, r[1].encode(),
            sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest(),
        ))
        pairs = [(role, x) for _, role, x in own]
        found, turns = faults(pairs), [t for t, _, _ in own if t is not None]
        cost, audit = plain(pairs)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            found.count("blank"), found.count("duplicate"), found.count("truncated"),
            sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, _), (b, _) in zip(pairs, pairs[1:])),
            cost, audit, rebuilt(pairs, audit),
        )
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def answers(df, block):
    found = df.collect()
    assert len({r["conv_id"] for r in found}) == len(found)
    return {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in found}


@pytest.mark.parametrize("block", [1, 3, 512])
def test_conversations_match_plain_loops(spark, block):
    draw = random.Random(block)
    rows = []
    for conv in [None, *range(12)]:
        for k in range(draw.choice([1, 2, 7, 40])):
            turn = draw.choice([None, k, k, k + 3])
            role = draw.choice(["system", "user", "assistant", "assistant", "user", None, "", "tool"])
            rows.append((conv, turn, role, draw.choice(["a.", "b", None, "", "c?\n", "ü!", "ü", "e. "])))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert answers(cr.repair_all(df, df, block), block) == expected(rows)


def test_long_texts_and_other_columns(spark):
    rows = [(1, 0, "user", "x" * 500_000 + "."), (1, 1, "assistant", "y" * 500_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    wide = df.selectExpr("*", "1 conv", "2 block", "3 place", "4 who", "5 tag", "6 total", "7 edits")
    assert answers(cr.repair_all(wide, wide), 512) == expected(rows)


def test_empty_tables_and_conversations_that_lose_all(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert cr.repair_all(empty, empty).count() == 0
    one = spark.createDataFrame([(4, 0, "user", "a.")], SCHEMA)
    assert answers(cr.repair_all(one, empty), 512) == {
        4: (0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest())
    }


def test_damage_by_hash(spark):
    import zlib

    rows = [(c, t, "assistant", "A. b? c!") for c in [None, *range(30)] for t in (None, 0, 1)]
    found = cr.damage(spark.createDataFrame(rows, SCHEMA)).collect()
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = {1: "", 2: "A b c"}.get(kind, text)
        want += [(c, t, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)


def test_the_given_table(spark):
    df = spark.read.parquet(f"{SMALL}/conversations.parquet")
    damaged = cr.damage(df)
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in damaged.collect()]
    found = answers(cr.repair_all(df, damaged), 512)
    assert {k: v for k, v in found.items() if k in {r[0] for r in rows}} == expected(rows)
