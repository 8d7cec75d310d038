from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from silvermart.llm.mixing import by_length, mix, targets
from silvermart.llm.queries import op7_mixing
from tests.llm.conftest import LARGER


@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=12))
@settings(max_examples=100, deadline=None)
def test_targets_are_the_fixed_point(sizes):
    given_sizes = {f"s{i:02d}": n for i, n in enumerate(sizes)}
    given_sizes[None] = 7
    found = targets(given_sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(given_sizes)}
    assert sum(found.values()) == pytest.approx(1.5 * sum(given_sizes.values()))
    free = [s for s in found if found[s] < 2 * given_sizes[s]]
    assert all(found[s] <= 2 * given_sizes[s] + 1e-6 for s in found)
    per_weight = [found[s] / weight[s] for s in free]
    if per_weight:
        assert max(per_weight) == pytest.approx(min(per_weight))
        full = [s for s in found if s not in free and given_sizes[s]]
        assert all(found[s] / weight[s] <= max(per_weight) * (1 + 1e-9) for s in full)


def test_targets_are_met_and_runs_agree(spark):
    rows = op7_mixing(spark, LARGER).collect()
    assert len(rows) == 1000
    again = {r.doc_id: r.taken for r in op7_mixing(spark, LARGER).collect()}
    assert all(again[r.doc_id] == r.taken and r.taken in (0, r.size, 2 * r.size) for r in rows)
    by_source: dict = {}
    for r in rows:
        by_source.setdefault(r.source, []).append(r)
    for found in by_source.values():
        longest = max(r.size for r in found)
        assert sum(r.size for r in found) == found[0].source_size
        assert abs(sum(r.taken for r in found) - found[0].target) <= longest / 2 + 1


def test_one_bin_and_many_agree_on_the_targets(docs):
    rows = [(i, "w " * (1 + i % 17), None, "ab"[i % 2]) for i in range(400)]
    for bins in (1, 7, 1 << 14):
        got = mix(docs(*rows), "doc_id", "text", "source", lean=by_length, bins=bins)
        sums = got.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("w"))
        assert all(abs(r.t - r.w) <= 9 for r in sums.collect())


def test_inclusion_follows_the_odds(docs):
    rows = [(i, "w " * (10 if i % 2 else 1000), None, "s") for i in range(4000)]
    got = mix(docs(*rows), "doc_id", "text", "source", share=0.5, lean=by_length)
    rates = {
        r["size"]: r.rate
        for r in got.groupBy("size").agg(F.avg("copies").alias("rate")).collect()
    }
    assert rates[10] < 0.15 < 0.4 < rates[1000]


def test_odd_rows(docs):
    rows = [
        (1, None, None, "a"), (2, "", None, None), (3, "x y", None, None), (3, "x y", None, None),
        (None, "z " * 5000, None, "b"), (5, "q", None, "c"),
    ]
    got = mix(docs(*rows).withColumnRenamed("lang", "size"), "doc_id", "text", "source").collect()
    assert len(got) == len(rows)
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    assert {r.taken for r in got if r.doc_id in (1, 2)} == {0}
    assert len({r.taken for r in got if r.doc_id == 3}) == 1
    assert mix(docs(*rows).limit(0), "doc_id", "text", "source").count() == 0
