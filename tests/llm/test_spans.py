from __future__ import annotations

import re

import numpy as np

from silvermart.llm import spans

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_words_match_the_rule(monkeypatch):
    texts = ["a  b\tc", None, "", " \n ", "é\x0bü x", "one", "a b a", "x" * 500 + " y " * 300]
    for limit in (1 << 21, 64, 7):
        monkeypatch.setattr(spans, "CHUNK_BYTES", limit)
        found = spans.words(texts)
        for i, text in enumerate(texts):
            raw = (text or "").encode()
            mine = slice(found.first[i], found.first[i + 1])
            got = [
                raw[a:b].decode() for a, b in zip(found.starts[mine], found.ends[mine])
            ]
            assert got == WORD.findall(text or "")


def test_equal_words_have_equal_hashes():
    found = spans.words(["ab Ab ab", "AB"], lower=True)
    assert len(set(found.hashes.tolist())) == 1
    found = spans.words(["ab Ab ba a b ab"])
    assert len(set(found.hashes.tolist())) == 5


def test_windows_depend_on_the_order():
    h = spans.words(["a b a b b a"]).hashes
    pairs = spans.windows(h, 2).tolist()
    assert pairs[0] == pairs[2] and pairs[0] != pairs[1] and len(spans.windows(h, 7)) == 0


def test_slices_cover_all_rows():
    assert list(spans.slices([5, 1, 1, 9, 2], 6)) == [(0, 2), (2, 3), (3, 4), (4, 5)]
    assert list(spans.slices([], 6)) == []


def test_classes_are_counted_per_word():
    kinds = np.zeros(256, np.uint8)
    kinds[ord("!")] = 1
    found = spans.words(["ab! !!", None], classes=kinds)
    assert found.classes.tolist() == [[2, 1], [0, 2]]
