from __future__ import annotations

from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from silvermart.llm.tree_dedup import LOWER, UPPER, drop_copies, exact_groups
from tests.llm.conftest import LARGER, table


def normal(text):
    return (text or "").translate(str.maketrans(UPPER, LOWER))


def expected(rows):
    """Sorted (doc_id, keep_id, group_size, text_sha256), and how many rows stay."""
    groups: dict[str, list] = {}
    for key, text in rows:
        groups.setdefault(normal(text), []).append(key)
    out = []
    for text, keys in groups.items():
        most = max((k for k in keys if k is not None), default=None)
        digest = sha256(text.encode()).hexdigest()
        out += [(k, most, len(keys), digest) for k in keys]
    return sorted(out, key=str), len(groups)


def check(df, rows, bits=3):
    found = exact_groups(df, bits=bits).collect()
    want, groups = expected(rows)
    assert sorted([(r[0], r[1], r[2], r["text_sha256"]) for r in found], key=str) == want
    kept = [r for r in found if r["kept"]]
    assert len(kept) == groups and all(r["doc_id"] == r["keep_id"] for r in kept)


ODD = [
    (1, "Abc"), (2, "aBC"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, "İK"), (8, "İk"),
    (9, " abc"), (10, "x" * 1_000_000), (11, "X" * 1_000_000), (None, "abc"), (None, "only"),
    (None, "only"), (2, "abc"), (2, "abc"), (-5, "K"), (12, "k"), (13, "ß"), (14, "SS"),
]


@pytest.mark.parametrize("bits", [1, 3])
@pytest.mark.parametrize("partitions", [1, 9, 40])
def test_odd_texts_and_ids(spark, bits, partitions):
    df = spark.createDataFrame(ODD, "doc_id long, text string").repartition(partitions)
    check(df, ODD, bits)


def test_one_group_with_a_third_of_all_rows(spark):
    rows = [(i, "same" if i % 3 else f"text {i // 2}") for i in range(3000)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(33), rows, 1)


def test_the_given_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in table("documents", LARGER)]
    df = spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "text")
    check(df.repartition(20), rows)


def test_whole_rows_stay_with_clashing_columns(docs):
    names = ("run", "tag", "id", "digest", "best", "rows", "row", "own", "kept", "keep_id")
    df = docs((1, "a"), (3, "A"), (2, "b"), (3, "a")).withColumns({n: F.lit(n) for n in names})
    found = drop_copies(df)
    assert found.dtypes == df.dtypes
    assert sorted((r["doc_id"], r["kept"]) for r in found.collect()) == [(2, "kept"), (3, "kept")]
    assert exact_groups(df).count() == 4


def test_empty_table_and_text_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert exact_groups(empty).count() == 0 and drop_copies(empty).count() == 0
    named = spark.createDataFrame([("x", "a"), ("y", "A")], "doc_id string, text string")
    assert {r["keep_id"] for r in exact_groups(named).collect()} == {"y"}


def test_no_python_in_the_plan(spark, capsys):
    df = spark.read.parquet(f"{LARGER}/documents.parquet")
    exact_groups(df).explain("formatted")
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
