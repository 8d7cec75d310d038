"""The trained operators: held-out accuracy, gradients, and rows that hold little."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from silvermart.llm import language_rnn, quality_mil, toxicity
from silvermart.llm.queries import op3_language, op4_quality, op9_toxicity
from tests.llm.conftest import LARGER, table


def is_held_out(doc: int) -> bool:
    return zlib.crc32(str(doc).encode()) % 5 == 0


@pytest.fixture(scope="module")
def marks():
    return {r["doc_id"]: r for r in table("labels", LARGER)}


def auc(score: np.ndarray, mark: np.ndarray) -> float:
    above = score[mark == 1][:, None] - score[mark == 0][None, :]
    return float((above > 0).mean() + (above == 0).mean() / 2)


def test_language_on_held_out_documents(spark):
    languages = {r["doc_id"]: r["lang"] for r in table("documents", LARGER)}
    got = op3_language(spark, LARGER).collect()
    assert len(got) == len(languages)
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {d for d in languages if is_held_out(d)}
    assert np.mean([r.lang_pred == languages[r.doc_id] for r in held]) >= 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_quality_on_held_out_documents(spark, marks):
    got = [r for r in op4_quality(spark, LARGER).collect() if r.held_out and r.doc_id in marks]
    score = np.array([r.score for r in got])
    mark = np.array([marks[r.doc_id]["quality"] for r in got])
    assert auc(score, mark) >= 0.95
    assert [r.predicted for r in got] == [int(r.score >= 0.3) for r in got]


def test_toxicity_on_held_out_documents(spark, marks):
    got = [r for r in op9_toxicity(spark, LARGER).collect() if r.held_out and r.doc_id in marks]
    score = np.array([r.score for r in got])
    mark = np.array([marks[r.doc_id]["toxic"] for r in got])
    assert auc(score, mark) >= 0.85
    assert [r.predicted for r in got] == [int(r.score >= 0.5) for r in got]


def test_recurrent_gradient():
    rng = np.random.default_rng(0)
    texts = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in (47, 10, 48, 3)]
    data, of, length = language_rnn.pieces([t.decode() for t in texts])
    target = np.arange(len(of)) % 2
    # A few steps from the start, so that no weight is still zero.
    model = language_rnn.fit(texts, np.array([0, 1, 0, 1]), ["x", "y"], steps=3, batch=8)
    exact = {k: v.astype(np.float64) for k, v in model.weights.items()}

    def loss(weights) -> float:
        labels = language_rnn.Model(["x", "y"], weights)
        chance = labels.labels(labels.states(data, length))
        inside = np.arange(language_rnn.PIECE)[:, None] < length[None]
        return float(-(np.log(chance[:, np.arange(len(of)), target]) * inside).sum() / inside.sum())

    slope = language_rnn._gradient(model, data, length, target)
    for name, values in exact.items():
        steepest = np.unravel_index(np.abs(slope[name]).argmax(), values.shape)
        moved = []
        for step in (0.01, -0.01):
            weights = {k: v.copy() for k, v in exact.items()}
            weights[name][steepest] += step
            moved.append(loss(weights))
        numeric = (moved[0] - moved[1]) / 0.02
        assert abs(numeric - slope[name][steepest]) <= 0.03 * abs(numeric) + 1e-4


def test_attention_gradient():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(9, quality_mil.FEATURES))
    first = np.array([0, 4, 5, 9])
    marks = np.array([1.0, 0.0, 1.0])
    model = quality_mil.fit(x, first, marks, epochs=3, batch=2)

    def loss(weights) -> float:
        p, _ = quality_mil.Model(model.centre, model.spread, weights).bags(x, first)
        return float(-(marks * np.log(p) + (1 - marks) * np.log(1 - p)).sum())

    p, kept = model.bags(x, first)
    slope = quality_mil._gradient(model.weights, kept, p - marks)
    for name, values in model.weights.items():
        at = np.unravel_index(np.abs(slope[name]).argmax(), values.shape)
        moved = []
        for step in (1e-5, -1e-5):
            weights = {k: v.copy() for k, v in model.weights.items()}
            weights[name][at] += step
            moved.append(loss(weights))
        assert abs((moved[0] - moved[1]) / 2e-5 - slope[name][at]) < 1e-4


def test_ftrl_keeps_only_what_the_labels_support():
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(10, 3000, 40)).astype(np.int32) for _ in range(300)]
    marks = (rng.random(300) < 0.5).astype(float)
    rows = [np.unique(np.r_[r, 5]).astype(np.int32) if m else r for r, m in zip(rows, marks)]
    model = toxicity.fit(rows, marks)
    assert 5 in model.ids and len(model.ids) < 100
    assert model.weights[list(model.ids).index(5)] > 0


def test_grams_are_those_of_each_text():
    one, two, none = toxicity.features(["You fool, you!", "you FOOL you", None])
    assert one.tolist() == two.tolist() and len(none) == 0
    alone = toxicity.features(["a b c d", "e"])
    together = toxicity.features(["a b c d"]) + toxicity.features(["e"])
    assert [a.tolist() for a in alone] == [t.tolist() for t in together]


ODD = [(1, None), (2, ""), (3, " \n "), (4, "1234 !!"), (5, "x" * 5000), (5, "x" * 5000), (None, "ab cd")]


def test_odd_rows(docs, spark):
    rows = docs(*ODD).withColumnRenamed("n_chars", "score")
    model = language_rnn.train(
        docs(*[(i, f"{w} " * 30, w) for i in range(40) for w in ("ja", "no")])
    )
    got = language_rnn.identify(rows, model).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(ODD)
    for doc in (1, 2, 3, 4):
        assert by_id[doc].lang_pred == "und" and by_id[doc].score == 0.0
    assert by_id[5].lang_pred in ("ja", "no") and by_id[None].lang_pred in ("ja", "no")

    labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    for operator, column in ((quality_mil, "quality"), (toxicity, "toxicity")):
        fitted = operator.train(docs(*ODD), labels)
        scored = operator.score(docs(*ODD), fitted).collect()
        assert len(scored) == len(ODD) and all(0 <= r[column] <= 1 for r in scored)
        assert len({r[column] for r in scored if r.doc_id in (1, 2, 3)}) == 1
        assert operator.score(docs(*ODD).limit(0), fitted).count() == 0


def test_nothing_to_learn_from(docs, spark):
    empty = docs((1, "abc")).limit(0)
    assert language_rnn.identify(docs((1, "abc")), language_rnn.train(empty)).first().lang_pred == "und"
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score(docs((1, "abc")), toxicity.train(empty, labels)).first().toxicity == 0.5
    assert quality_mil.score(docs((1, "abc")), quality_mil.train(empty, labels)).first().quality == 0.5


def test_large_ids_survive_nulls(docs):
    big = (1 << 60) + 1
    model = language_rnn.fit([], np.zeros(0, np.int64), [])
    got = language_rnn.identify(docs((big, "a"), (None, "b")).repartition(1), model)
    assert {r.doc_id for r in got.collect()} == {big, None}


def test_labels_of_other_documents_and_double_labels_do_not_count(spark):
    from silvermart.llm.toxicity import labelled

    docs = spark.createDataFrame([(i, f"t{i}") for i in range(200)], "doc_id long, text string")
    marks = [(i, i % 2) for i in range(5000)] + [(4, 1), (6, 1), (8, 0), (9, None)]
    table = spark.createDataFrame(marks, "doc_id long, toxic int")
    found = labelled(docs, table, "toxic", 1000, "seed").collect()
    learned = {r["id"] for r in found}
    import zlib

    usable = {i for i in range(200) if zlib.crc32(str(i).encode()) % 5} - {4, 6}
    assert learned == usable and all(r["mark"] == r["id"] % 2 for r in found)
