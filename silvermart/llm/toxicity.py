"""Toxicity by logistic regression on hashed word n-grams and skip-grams, learned with FTRL-proximal.

Each coordinate has its own learning rate, and the L1 term keeps all weights at zero that the labels
do not support, so what is sent to the tasks is a short list of weights, whatever the corpus holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from silvermart.llm.common import add_columns, held_out, text_parts
from silvermart.llm.spans import PUNCTUATION, U, Words, mixed, slices, words

BITS = 20
# Documents learned from, per label; ids in the order of a hash, whole texts.
MOST_PER_LABEL = 3000
GRAMS = ((0,), (0, 1), (0, 2), (0, 3))  # word; pair; pairs that skip one and two words
BATCH_CHARS = 1 << 20


def grams(found: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per kind of gram the hashed feature of each place and the text it is from."""
    of = found.text_of()
    for k, places in enumerate(GRAMS):
        n = len(found.hashes) - places[-1]
        if n <= 0:
            continue
        value = np.full(n, k + 1, np.uint64)
        for p in places:
            value = mixed(value * U(31) + found.hashes[p : p + n])
        same = of[:n] == of[places[-1] : places[-1] + n]
        yield (value[same] >> U(64 - BITS)).astype(np.int32), of[:n][same]


def features(texts: list[str | None]) -> list[np.ndarray]:
    """The distinct features of each text, in ascending order."""
    found = words(texts, PUNCTUATION, lower=True)
    parts = list(grams(found))
    if not parts:
        return [np.zeros(0, np.int32) for _ in texts]
    key = np.unique(
        np.concatenate([(t.astype(np.int64) << BITS) | f for f, t in parts])
    )
    edges = np.searchsorted(key, np.arange(len(texts) + 1, dtype=np.int64) << BITS)
    ids = (key & ((1 << BITS) - 1)).astype(np.int32)
    return [ids[a:b] for a, b in zip(edges[:-1], edges[1:])]


@dataclass(frozen=True)
class Model:
    """The weights that are not zero, the constant, and whether both labels were learned from."""

    ids: np.ndarray
    weights: np.ndarray
    constant: float
    both_labels: bool = True

    def scores(self, texts: list[str | None]) -> np.ndarray:
        table = np.zeros(1 << BITS, np.float32)
        table[self.ids] = self.weights
        total = np.full(len(texts), self.constant)
        sizes = [len(t or "") + 1 for t in texts]
        for a, b in slices(sizes, BATCH_CHARS):
            found = words(texts[a:b], PUNCTUATION, lower=True)
            keys = [np.zeros(0, np.int64)]
            for feature, of in grams(found):
                hit = table[feature] != 0
                keys.append((of[hit].astype(np.int64) << BITS) | feature[hit])
            key = np.unique(np.concatenate(keys))
            total[a:b] += np.bincount(
                key >> BITS, table[key & ((1 << BITS) - 1)], minlength=b - a
            )[: b - a]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(
    rows: list[np.ndarray],
    marks: np.ndarray,
    alpha: float = 1.0,
    beta: float = 1.0,
    l1: float = 30.0,
    l2: float = 1.0,
    epochs: int = 6,
    seed: int = 3,
) -> Model:
    """FTRL-proximal over the rows' features; without rows every score is a half.

    Both labels weigh the same in total, however rare one is.
    """
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    z0 = n0 = constant = 0.0
    order = np.random.default_rng(seed)
    positive = float(marks.sum())
    balance = {
        1.0: max(1.0, (len(rows) - positive) / max(1.0, positive)),
        0.0: max(1.0, positive / max(1.0, len(rows) - positive)),
    }

    def weights(at) -> np.ndarray:
        held = z[at]
        return np.where(
            np.abs(held) <= l1,
            0.0,
            -(held - np.sign(held) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2),
        )

    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at = rows[i]
            w = weights(at)
            constant = -z0 / ((beta + n0**0.5) / alpha)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + constant, -30, 30)))
            g = (p - marks[i]) * balance[marks[i]]
            # All features of a row have the value one, so they share the gradient.
            held = n[at]
            z[at] += g - (np.sqrt(held + g * g) - np.sqrt(held)) / alpha * w
            n[at] = held + g * g
            z0 += g - ((n0 + g * g) ** 0.5 - n0**0.5) / alpha * constant
            n0 += g * g
    ids = np.flatnonzero(np.abs(z) > l1)
    both = 0 < positive < len(rows)
    return Model(ids.astype(np.int32), weights(ids).astype(np.float32), float(constant), both)


def labelled(
    docs: DataFrame, marks: DataFrame, mark: str, per_label: int, seed: str
) -> DataFrame:
    """(text, mark) of at most `per_label` learnable documents of each label.

    Which ones depends on a hash of the id alone. Rows with NULL in the label or id are left out, and
    so are ids with both labels. Labels of other documents do not count towards the bound.
    """
    known = marks.select(F.col("doc_id").alias("id"), F.col(mark).cast("int").alias("mark")).where(
        F.col("mark").isin(0, 1) & ~held_out(F.col("id"))
    )
    single = known.groupBy("id").agg(F.min("mark").alias("mark"), F.max("mark").alias("other"))
    there = docs.select(F.col("doc_id").alias("id"))
    ids = single.where("mark = other").drop("other").join(there, "id", "left_semi")
    order = (F.xxhash64(F.lit(seed), F.col("id")), F.col("id"))
    chosen = [ids.where(F.col("mark") == v).orderBy(*order).limit(per_label) for v in (0, 1)]
    # At most 2 * per_label ids.
    picked = F.broadcast(chosen[0].unionByName(chosen[1]))
    texts = docs.select(F.col("doc_id").alias("doc"), F.col("text").alias("text"))
    return texts.join(picked, F.col("doc") == F.col("id")).select("id", "text", "mark")


def train(docs: DataFrame, marks: DataFrame, per_label: int = MOST_PER_LABEL) -> Model:
    """Learns from at most `per_label` documents of each label that are not held out."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = features(list(batch["text"]))
            yield pd.DataFrame(
                {"id": batch["id"], "mark": batch["mark"], "grams": [f.tobytes() for f in found]}
            )

    chosen = labelled(docs, marks, "toxic", per_label, "toxicity")
    sample = chosen.mapInPandas(encode, "id long, mark int, grams binary").toPandas()
    sample = sample.sort_values(["id", "mark"], kind="stable").reset_index(drop=True)
    rows = [np.frombuffer(g, np.int32) for g in sample["grams"]]
    return fit(rows, sample["mark"].to_numpy(dtype=float))


def score(docs: DataFrame, model: Model, column: str = "toxicity") -> DataFrame:
    """`docs` with the chance of being toxic; a column of that name is replaced.

    NULL and empty texts get the score of the constant alone; rows are scored one by one, so
    repeated rows get equal scores; an empty table stays empty.
    """

    def read(batch: pa.RecordBatch):
        for part in text_parts(batch, "text"):
            scores = model.scores(part.column("text").to_pylist())
            yield part, [pa.array(scores, pa.float64())]

    return add_columns(docs, [T.StructField(column, T.DoubleType())], read)


def has_words(text: Column) -> Column:
    """Whether a text has a word that counts; NULL has none."""
    return F.coalesce(text.rlike("[0-9A-Za-z]|[^\\x00-\\x7F]"), F.lit(False))


def is_toxic(value: Column, threshold: float = 0.5) -> Column:
    return value >= threshold
