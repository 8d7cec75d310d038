from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from silvermart.llm.substring_dedup import LEAST, Automaton, remove_repeats
from tests.llm.conftest import SMALL, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected(texts: list[str | None]) -> list[tuple[int, int, str]]:
    split = [WORD.findall(t or "") for t in texts]
    windows = Counter(
        tuple(w[i : i + LEAST]) for w in split for i in range(len(w) - LEAST + 1)
    )
    found = []
    for w in split:
        gone = set()
        for i in range(len(w) - LEAST + 1):
            if windows[tuple(w[i : i + LEAST])] > 1:
                gone.update(range(i, i + LEAST))
        found.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return found


def check(frame, rows: list[tuple], **options) -> None:
    want = Counter(
        (doc, *e) for (doc, _), e in zip(rows, expected([t for _, t in rows]))
    )
    got = remove_repeats(frame, **options).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == want
    for r in got:
        assert sum(s["to"] - s["from"] for s in r.spans) == r.n_removed


def made(seed: int) -> list[tuple]:
    """Texts with shared passages, near copies, repeats inside one text and few different words."""
    rng = random.Random(seed)

    def prose(n: int, vocabulary: int = 500) -> list[str]:
        return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]

    passage, base = prose(70), prose(150)
    rows = []
    for i in range(60):
        words = prose(rng.randrange(120))
        kind = i % 6
        if kind == 0:
            cut = rng.randrange(40)
            words[10:10] = passage[cut : cut + 30 + rng.randrange(20)]
        elif kind == 1:
            words = list(base)
            for _ in range(3):
                words[rng.randrange(150)] = "new"
        elif kind == 2:
            words = words + words[: rng.randrange(60)]
        elif kind == 3:
            words = prose(80, 1 + rng.randrange(3))
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_made_texts(docs, seed):
    rows = made(seed)
    check(docs(*rows), rows)


@pytest.mark.parametrize("options", [{"most_runs": 1}, {"shard_words": 1}])
def test_hot_anchors_and_small_shards(docs, options):
    rows = made(7)
    check(docs(*rows), rows, **options)


def test_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in table("documents")]
    check(spark.read.parquet(f"{SMALL}/documents.parquet"), rows)


def test_odd_rows(docs):
    text = " ".join(f"v{i}" for i in range(60))
    rows = [
        (1, None), (2, ""), (3, " \n "), (4, "few words"), (5, text), (5, text),
        (6, " ".join(f"u{i}" for i in range(50))), (6, text[30:]), (None, text + " end"),
        (7, "same " * 3000), (8, " ".join(f"x{i}" for i in range(20_000))),
    ]
    check(docs(*rows), rows)
    clash = docs(*rows).withColumnRenamed("lang", "kept").withColumnRenamed("source", "spans")
    assert remove_repeats(clash).columns == [
        "doc_id", "text", "n_chars", "n_words", "n_removed", "spans", "kept",
    ]
    assert remove_repeats(docs(*rows).limit(0)).count() == 0


def test_automaton_counts_every_sequence():
    rng = random.Random(1)
    sequences = [[rng.randrange(3) for _ in range(rng.randrange(1, 30))] for _ in range(12)]
    automaton = Automaton()
    for i, s in enumerate(sequences):
        automaton.add(s, 1 + i % 2)
    automaton.close()
    for least in (1, 3, 6):
        seen = Counter()
        for i, s in enumerate(sequences):
            for j in range(len(s) - least + 1):
                seen[tuple(s[j : j + least])] += 1 + i % 2
        for s in sequences:
            want = [
                j + least
                for j in range(len(s) - least + 1)
                if seen[tuple(s[j : j + least])] >= 2
            ]
            assert list(automaton.repeats(s, least)) == want


def test_rows_without_or_with_equal_ids_never_answer_for_each_other(docs):
    """Many different texts under one id or none: only what repeats goes."""
    import hashlib

    def text(seed):
        return " ".join(hashlib.md5(f"{seed}-{i}".encode()).hexdigest()[:6] for i in range(40))

    rows = [(None, text(i)) for i in range(6000)] + [(5, text(i)) for i in range(6000, 12_000)]
    rows += [(7, text(3)), (8, text(11_000))]
    found = remove_repeats(docs(*rows)).where("n_removed > 0").collect()
    assert sorted(r["text"] for r in found) == sorted([text(3)] * 2 + [text(11_000)] * 2)
