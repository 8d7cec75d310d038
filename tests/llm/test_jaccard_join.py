from __future__ import annotations

import random
import re

import numpy as np
import pytest

from silvermart.llm import jaccard_join as join
from silvermart.llm.common import Scratch
from silvermart.llm.components import components
from tests.llm.conftest import LARGER, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(rows: list[tuple]) -> dict:
    sets = {}
    for doc, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        sets[doc] = {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()
    up = {d: d for d in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    holders: dict = {}
    for doc, found in sets.items():
        for x in found:
            holders.setdefault(x, []).append(doc)
    pairs = {(a, b) for h in holders.values() if len(h) < 400 for a in h for b in h if a < b}
    for a, b in pairs:
        common = len(sets[a] & sets[b])
        if 100 * common >= 85 * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            up[y] = x
    return {d: (len(sets[d]), top(d)) for d in sets}


def found(frame, **options) -> dict:
    return {r.doc_id: (r.n_shingles, r.component_id) for r in join.link_documents(frame, **options).collect()}


def near_copies(seed: int, copies: int, sizes: tuple[int, ...]) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for size in sizes:
        base = [f"w{rng.randrange(9000)}" for _ in range(size)]
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.randrange(1 + size // 25)):
                words[rng.randrange(len(words))] = f"n{rng.randrange(99)}"
            if rng.random() < 0.3:
                words = words[: len(words) - rng.randrange(1 + size // 8)]
            rows.append((len(rows), " ".join(words)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [1024, 7])
def test_near_copies(docs, block):
    rows = near_copies(1, 25, (3, 4, 5, 9, 10, 14, 20, 30, 60, 120, 300))
    assert found(docs(*rows), block=block) == expected(rows)


def test_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in table("documents", LARGER)]
    assert found(spark.read.parquet(f"{LARGER}/documents.parquet")) == expected(rows)


@pytest.mark.parametrize("size", [*range(1, 40), 75, 151, 400])
def test_every_similar_pair_shares_an_entry(size):
    """Both members of a pair that just links are in one index entry, wherever they differ."""
    rng = np.random.default_rng(size)
    similarity = join.Similarity()
    for _ in range(12):
        universe = rng.integers(0, 1 << 63, 2 * size + 10, dtype=np.int64).astype(np.uint64)
        for other in {size, similarity.largest_partner(size), (size + similarity.largest_partner(size)) // 2}:
            most = similarity.most_difference(size, other)
            common = (size + other - most + 1) // 2
            common = min(size, max(common, -(-85 * (size + other) // 185)))
            a = np.sort(universe[:size])
            b = np.sort(np.r_[universe[:common], universe[size : size + other - common]])
            if 100 * common < 85 * (size + other - common):
                continue
            value = np.r_[a, b]
            key, owner = join.entries(value, np.array([0, len(a), len(value)]), similarity)
            if size == other == common:
                continue
            assert set(key[owner == 0].tolist()) & set(key[owner == 1].tolist())


def test_sketch_never_exceeds_the_difference():
    rng = np.random.default_rng(3)
    for _ in range(50):
        pool = rng.integers(0, 1 << 62, 300, dtype=np.int64).astype(np.uint64)
        a, b = np.unique(rng.choice(pool, 150)), np.unique(rng.choice(pool, 140))
        sketch = join.parities(np.r_[a, b], np.array([0, len(a), len(a) + len(b)]))
        distance = int(join._ONES[sketch[0] ^ sketch[1]].sum())
        assert distance <= len(np.setxor1d(a, b))


def test_small_texts_take_deletion_neighbours():
    kinds = {join.band_of(n, join.Similarity()).deletion > 0 for n in range(6, 24)}
    assert True in kinds and join.band_of(200, join.Similarity()).deletion == 0


def test_odd_rows(docs):
    rows = [
        (9, None), (8, ""), (7, " \n"), (6, "One two"), (5, "one  TWO"), (4, "one two three"),
        (3, "x " * 30_000), (2, "x x x x x"), (1, "É a b c"), (0, "é a b c"),
    ]
    assert found(docs(*rows)) == expected(rows)
    repeated = docs((4, "a b c d e"), (4, "a b c d e"), (None, "a b c d e"), (None, "q r s t"))
    got = sorted(
        (r.doc_id or -1, r.n_shingles, r.component_id or -1)
        for r in join.link_documents(repeated).collect()
    )
    assert got == [(-1, 1, -1), (-1, 2, 4), (4, 2, 4), (4, 2, 4)]
    assert join.link_documents(repeated.limit(0)).count() == 0
    clash = docs((1, "a"), (2, "a")).withColumnRenamed("lang", "component_id")
    assert {r.component_id for r in join.link_documents(clash).collect()} == {1}


def test_components_of_long_chains(spark):
    rng = random.Random(5)
    names = rng.sample(range(10_000), 300)
    chain = list(zip(names, names[1:]))
    star = [(20_000, 20_000 + i) for i in range(1, 80)]
    links = spark.createDataFrame(chain + star + [(5, 5)], "a long, b long")
    got = {r.node: r.least for r in components(links, Scratch(spark), "chain").collect()}
    least = min(names)
    assert got == {
        **{n: least for n in names if n != least}, **{20_000 + i: 20_000 for i in range(1, 80)}
    }


def test_rows_of_one_id_are_compared_by_all_their_texts(docs):
    one, two = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    df = docs((1, one), (1, two), (2, one + " more"), (3, two + " more"), (4, "else"))
    found = {(r["doc_id"], r["component_id"]) for r in join.link_documents(df).collect()}
    assert found == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_one_set_with_many_partners_is_dealt_out(docs, monkeypatch):
    monkeypatch.setattr(join, "PARTNERS", 3)
    words = [f"w{i}" for i in range(100)]
    df = docs(*[(i, " ".join([*words, f"x{i}"])) for i in range(40)], (99, "w1 w2 w3 w4 w5"))
    found = {r["doc_id"]: r["component_id"] for r in join.link_documents(df).collect()}
    assert found == {**{i: 0 for i in range(40)}, 99: 99}


def test_sketches_of_any_two_sizes_never_exceed_the_difference():
    draw = random.Random(5)
    pool = [draw.getrandbits(64) for _ in range(6000)]
    sets = [sorted(set(draw.sample(pool, n))) for n in (1, 40, 255, 256, 300, 900, 1500, 2600, 5000)]
    sets += [sorted({*sets[6][:-9], 1, 2}), sorted({*sets[8][9:]}), []]
    value = np.array([v for s in sets for v in s], np.uint64)
    first = np.r_[0, np.cumsum([len(s) for s in sets])]
    sketches = join.parities(value, first)
    assert len({len(s) for s in sketches}) > 3
    for i, a in enumerate(sets):
        found = join.distances([sketches[i]] * len(sets), sketches)
        for distance, b in zip(found.tolist(), sets):
            assert distance <= len(set(a) ^ set(b))
    # Far sets of thousands are told apart.
    assert join.distances([sketches[7]], [sketches[8]])[0] > join.Similarity(80).most_difference(2600, 5000)
