from __future__ import annotations

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from silvermart.llm.merkle_manifest import build, one_more, tampered_ids
from tests.llm.conftest import SMALL, table


def h(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf(row, n_chars=None) -> str:
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    n = row["n_chars"] if n_chars is None else n_chars
    return h("".join(map(field, (row["doc_id"], row["source"], row["lang"], n, row["text"]))))


def tree(nodes: list[str], place: int) -> tuple[str, list[tuple[str, int]]]:
    """Root, and the siblings of one leaf with the side they stand on."""
    siblings = []
    while len(nodes) > 1:
        if place ^ 1 < len(nodes):
            siblings.append((nodes[place ^ 1], place % 2))
        else:
            siblings.append(("", 0))
        nodes = [h("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)]
        place //= 2
    return nodes[0], siblings


def expected(rows) -> list[tuple]:
    langs = sorted({r["lang"] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    of = {}
    for lang in langs:
        own = [r for r in rows if r["lang"] == lang]
        own.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        of[lang] = own
    subroots = [tree([leaf(r) for r in of[lang]], 0)[0] for lang in langs]
    out = []
    for k, lang in enumerate(langs):
        leaves = [leaf(r) for r in of[lang]]
        root, upper = tree(subroots, k)
        for i, row in enumerate(of[lang]):
            siblings = tree(leaves, i)[1] + upper
            node = leaves[i]
            key = row["doc_id"]
            if key is not None and zlib.crc32(str(key).encode()) % 7 == 0 and row["n_chars"] is not None:
                node = leaf(row, row["n_chars"] + 1)
            for other, left in siblings:
                node = h(other + node if left else node + other)
            proof = h("".join(s for s, _ in siblings))
            out.append((key, leaves[i], subroots[k], root, proof, node))
    return sorted(out, key=str)


def proofs(df, bits):
    manifest = build(
        df, tampered=tampered_ids(F.col("doc_id")), changes={"n_chars": one_more(F.col("n_chars"))},
        bits=bits,
    )
    columns = ("id", "leaf", "subroot", "root", "proof_sha256", "folded_root")
    return manifest, sorted([tuple(r) for r in manifest.proofs().select(*columns).collect()], key=str)


@pytest.mark.parametrize("bits", [1, 2, 10])
def test_proofs_match_a_plain_tree(spark, bits):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert proofs(df, bits)[1] == expected(table("documents"))


ODD = [
    (5, "a", "en", "s", 1), (7, None, "en", None, None), (None, "", None, "s", 3),
    (9, "ü\U0001f600", "", "", 2**63 - 1), (14, "x" * 300_000, "zz", "s", 4), (3, "b", "en", "s", 1),
    (3, "c", "en", "s", 1), (5, "a", "en", "s", 1), (21, "d", "Ã", "s", 0),
]


@pytest.mark.parametrize("bits", [1, 3])
def test_nulls_ties_repeated_rows_and_lone_leaves(docs, bits):
    rows = [dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r)) for r in ODD]
    assert proofs(docs(*ODD), bits)[1] == expected(rows)


def test_one_row_and_an_empty_table(docs):
    row = (1, "a", "en", "s", 1)
    found = proofs(docs(row), 2)[1]
    assert len(found) == 1 and found[0][1] == found[0][2] == found[0][3] and found[0][4] == h("")
    assert proofs(docs(row).limit(0), 2)[1] == []


def test_other_columns_play_no_part(docs):
    plain = docs(*ODD)
    names = ("digest", "place", "total", "block", "group_key", "path", "root", "tag", "id", "changed")
    assert proofs(plain.withColumns({n: F.lit(1) for n in names}), 2)[1] == proofs(plain, 2)[1]


def test_a_version_copies_the_way_to_the_root_and_nothing_else(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    manifest, found = proofs(df, 2)
    roots = {r[0]: (r[3], r[5]) for r in found}
    versions: dict[int, list] = {}
    for r in manifest.versions().collect():
        versions.setdefault(r["id"], []).append((r["height"], r["digest"]))
    assert set(versions) == {k for k in roots if zlib.crc32(str(k).encode()) % 7 == 0}
    steps = {r["id"]: r["path"] for r in manifest.paths().collect()}
    for key, nodes in versions.items():
        nodes.sort()
        assert [n for n, _ in nodes] == list(range(len(steps[key]) + 1))
        assert nodes[-1][1] == roots[key][1] != roots[key][0]
