from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from silvermart.llm import toxicity
from silvermart.llm.queries import tokenizer_path
from silvermart.llm.word_bpe import tokenizer
from tests.llm.conftest import LARGER, SMALL, table
from tests.llm.test_jaccard_join import expected as components_of
from tests.llm.test_substring_dedup import expected as kept_of


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows before the first and after every stage."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = [docs.collect()]
    for name, stage in pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        found.append(docs.collect())
    return found


COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_every_stage_but_the_last_returns_documents(stages):
    for rows in stages[:-1]:
        assert list(rows[0].asDict()) == COLUMNS


def test_toxic_documents_go(spark, stages):
    before, after = stages[0], stages[1]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    scores = dict(zip([r.doc_id for r in before], model.scores([r.text for r in before])))
    assert {r.doc_id for r in after} == {d for d, s in scores.items() if s < 0.5}
    assert set(map(tuple, after)) <= set(map(tuple, before))


def test_one_document_of_each_group_stays(stages):
    before, after = stages[1], stages[2]
    component = components_of([(r.doc_id, r.text) for r in before])
    assert sorted(r.doc_id for r in after) == sorted(d for d, (_, c) in component.items() if d == c)
    assert set(map(tuple, after)) <= set(map(tuple, before))


LABELS = "doc_id long, quality int, toxic int"


@pytest.mark.parametrize(
    "marks", [[], [(1, 1, None), (2, 0, None)], [(i, 1, 1) for i in range(1, 9)], [(None, 1, 1)]]
)
def test_nothing_goes_without_both_labels(spark, docs, tmp_path, marks):
    spark.createDataFrame(marks, LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    rows = docs((None, "no id"), (0, None), *[(i, f"you fool {i}") for i in range(1, 9)])
    got = pipeline.drop_toxic(spark, rows, str(tmp_path)).collect()
    assert sorted(map(str, got)) == sorted(map(str, rows.collect()))


def test_texts_without_words_stay(spark, docs, monkeypatch):
    none = np.zeros(0, np.int32)
    model = toxicity.Model(none, none.astype(np.float32), 1.0)
    monkeypatch.setattr(toxicity, "train", lambda docs, marks: model)
    rows = docs((1, None), (2, ""), (3, " .\n!?"), (4, "a"), (5, "é"), (6, "7"))
    got = pipeline.drop_toxic(spark, rows, SMALL).collect()
    assert sorted(r.doc_id for r in got) == [1, 2, 3]


# Three documents with near copies that shingles of four words miss, and their groups.
NEAR = (1, 255, 278, 582, 615, 709, 773, 830, 875, 944, 991)


def near_groups(rows: list[tuple]) -> dict:
    """The least id that pairs of five-word similarity from 80 per cent on lead to."""
    sets = {}
    for doc, text in rows:
        w = (text or "").lower().split()
        sets[doc] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    least = {d: d for d in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]) and least[a] != least[b]:
            x, y = sorted((least[a], least[b]))
            least = {d: x if c == y else c for d, c in least.items()}
    return least


def test_near_copies_from_four_fifths_of_five_word_shingles_go(spark, docs):
    rows, of = [], 0
    for size in (60, 104, 220):
        for changed in range(0, size // 12, 2):
            of += 1
            words = [f"t{of}w{i}" for i in range(size)]
            rows.append((len(rows), " ".join(words)))
            for k in range(changed):
                words[7 + 11 * k] = f"x{k}"
            rows.append((len(rows), " ".join(words)))
    # The first words alone keep 96 and 100 of the 120 shingles.
    for cut in (24, 20):
        words = [f"c{cut}w{i}" for i in range(124)]
        rows.append((len(rows), " ".join(words)))
        rows.append((len(rows), " ".join(words[: 124 - cut])))
    least = near_groups(rows)
    got = pipeline.keep_one_of_each_group(spark, docs(*rows), SMALL).collect()
    assert sorted(r.doc_id for r in got) == sorted(d for d, c in least.items() if d == c)
    assert len(least) > len(got) > len(least) // 2


def test_one_of_each_group_stays_of_the_larger_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in table("documents", LARGER)]
    least = near_groups([r for r in rows if r[0] in NEAR])
    frame = spark.read.parquet(f"{LARGER}/documents.parquet").where(F.col("doc_id").isin(*NEAR))
    got = pipeline.keep_one_of_each_group(spark, frame, SMALL).collect()
    assert sorted(r.doc_id for r in got) == sorted(d for d, c in least.items() if d == c)
    assert not {255, 875, 944} & {r.doc_id for r in got}


def test_repeats_are_cut(stages):
    before, after = stages[2], {r.doc_id: r for r in stages[3]}
    assert len(after) == len(before)
    for r, (_, removed, kept) in zip(before, kept_of([r.text for r in before])):
        assert after[r.doc_id].text == (kept if removed else r.text)
        assert not removed or after[r.doc_id].n_chars == len(kept)


def test_documents_are_taken_whole(stages):
    before = {r.doc_id: r for r in stages[3]}
    times: dict = {}
    for r in stages[4]:
        assert r == before[r.doc_id]
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert max(times.values()) == 2
    size = {d: len((r.text or "").split()) for d, r in before.items()}
    taken = sum(size[d] * n for d, n in times.items())
    assert abs(taken - 1.5 * sum(size.values())) <= 0.1 * sum(size.values())


def test_ids_stand_for_the_texts(stages):
    known = tokenizer(tokenizer_path())
    texts = {r.doc_id: r.text or "" for r in stages[4]}
    assert len(stages[5]) == len(stages[4])
    for r in stages[5]:
        ids = known.encode(texts[r.doc_id], add_special_tokens=False).ids
        decoded = known.decode(ids, skip_special_tokens=False)
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_run_gives_the_last_stage(spark, stages):
    got = pipeline.run(spark, SMALL).collect()
    assert sorted((r.doc_id, r.ids) for r in got) == sorted((r.doc_id, r.ids) for r in stages[5])


@pytest.mark.parametrize("name, stage", pipeline.STAGES)
def test_odd_documents(spark, docs, name, stage):
    text = " ".join(f"w{i}" for i in range(50))
    rows = docs(
        (1, None), (2, "", None, "s", 0), (3, text), (3, text), (4, text + " end", "en", "s", None),
        (None, "no id", None, "t", 5), ((1 << 60) + 1, "y " * 4000, "en", "t", 8000),
    )
    got = stage(spark, rows, SMALL)
    found = got.collect()
    if name != "word_bpe":
        assert got.columns == COLUMNS
    if name == "near_duplicates":
        assert sorted(r.doc_id or 0 for r in found) == [0, 1, 2, 3, (1 << 60) + 1]
    if name in ("substring_dedup", "word_bpe"):
        assert len(found) == 7
    assert stage(spark, rows.limit(0), SMALL).count() == 0


@pytest.mark.parametrize("stage", ["substring_dedup", "mixing", "near_duplicates"])
def test_stages_keep_columns_of_any_name(spark, stage):
    """Columns that an operator uses itself come out as they went in."""
    step = dict(pipeline.STAGES)[stage]
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{text} {i}" if i % 2 else f"u{i} v{i}", "en", "ab"[i % 2], 5) for i in range(8)]
    names = (
        "kept", "spans", "n_words", "n_removed", "missing", "certain", "last_bin", "last_rank",
        "source_key", "taken", "size", "copies", "target", "part", "doc",
    )
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df = plain.withColumns({n: F.lit(f"own {n}") for n in names})
    found = step(spark, df, SMALL)
    assert found.columns == df.columns
    expected = step(spark, plain, SMALL)
    assert sorted(map(tuple, found.select(*plain.columns).collect())) == sorted(map(tuple, expected.collect()))
    assert all(r[n] == f"own {n}" for r in found.collect() for n in names)
