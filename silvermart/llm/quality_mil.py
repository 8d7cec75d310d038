"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages and only the bag has a label. Every passage is encoded by a small
network, a gated attention learned from the document labels weighs the passages, and the weighted
sum of their codes is scored. Training is plain numpy on a bounded sample; scoring runs in tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from silvermart.llm.common import add_columns, text_parts
from silvermart.llm.spans import slices, windows, words
from silvermart.llm.toxicity import labelled

PASSAGE_WORDS = 40
# Documents learned from, per label; ids in the order of a hash, whole texts.
MOST_PER_LABEL = 3000
CODE, GATE = 12, 8
BATCH_CHARS = 1 << 20

# Byte classes that tell prose from junk.
_CLASSES = np.full(256, 9, np.uint8)  # other marks
for _k, _bytes in enumerate(
    (
        range(97, 123), range(65, 91), range(48, 58), range(128, 256),
        b".", b",;:?'\"()", b"!", b"|", b"#*$%&<>",
    )
):
    _CLASSES[list(_bytes)] = _k
FEATURES = 10 + 7


def _seen_before(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Whether an equal value stands earlier in the same group."""
    order = np.lexsort((value, group))
    again = np.zeros(len(value), bool)
    g, v = group[order], value[order]
    again[order[1:]] = (g[1:] == g[:-1]) & (v[1:] == v[:-1])
    return again


def passages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage, and the first passage of each text; a text has at least one."""
    found = words(texts, classes=_CLASSES)
    counts = np.diff(found.first)
    per_text = np.maximum(1, -(-counts // PASSAGE_WORDS))
    first = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(per_text, out=first[1:])
    out = np.zeros((int(first[-1]), FEATURES), np.float32)
    if not len(found.hashes):
        return out, first
    of = found.text_of()
    place = np.arange(len(of)) - found.first[of]
    passage = first[of] + place // PASSAGE_WORDS
    heads = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
    rows = passage[heads]
    size = np.diff(np.r_[heads, len(of)]).astype(np.float32)

    def mean(flags: np.ndarray) -> np.ndarray:
        return np.add.reduceat(flags, heads, axis=0).astype(np.float32) / size

    tally = np.add.reduceat(found.classes, heads, axis=0).astype(np.float32)
    total = tally.sum(axis=1)
    out[rows, :10] = tally / total[:, None]
    out[rows, 10] = np.minimum(total / size, 40) / 10
    repeat = np.zeros(len(of), np.float32)
    repeat[1:] = (found.hashes[1:] == found.hashes[:-1]) & (of[1:] == of[:-1])
    out[rows, 11] = mean(repeat)
    out[rows, 12] = mean(_seen_before(passage, found.hashes))
    seen = np.zeros(len(of), np.float32)
    seen[: max(0, len(of) - 2)] = _seen_before(of[: len(of) - 2], windows(found.hashes, 3))
    out[rows, 13] = mean(seen)
    capital = found.classes[:, 1] > 0
    out[rows, 14] = mean(capital.astype(np.float32))
    out[rows, 15] = np.log1p(counts[of[heads]]) / 10
    out[rows, 16] = 1
    return out, first


@dataclass(frozen=True)
class Model:
    """Weights of encoder, gated attention and scorer, and the scale of the features."""

    centre: np.ndarray
    spread: np.ndarray
    weights: dict[str, np.ndarray]

    def bags(self, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, dict]:
        """Chance of label 1 for each bag of passages, and what the gradient needs."""
        w = self.weights
        x = np.clip((x - self.centre) / self.spread, -8, 8)
        h = np.tanh(x @ w["E"] + w["e"])
        v, u = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-np.clip(h @ w["U"], -30, 30)))
        s = (v * u) @ w["a"]
        heads, sizes = first[:-1], np.diff(first)
        top = np.maximum.reduceat(s, heads)
        a = np.exp(s - np.repeat(top, sizes))
        a /= np.repeat(np.add.reduceat(a, heads), sizes)
        z = np.add.reduceat(a[:, None] * h, heads, axis=0)
        p = 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["b"], -30, 30)))
        return p, {"x": x, "h": h, "v": v, "u": u, "a": a, "z": z, "sizes": sizes, "heads": heads}

    def scores(self, texts: list[str | None]) -> np.ndarray:
        result = np.zeros(len(texts))
        for i, j in slices([len(t or "") + 1 for t in texts], BATCH_CHARS):
            result[i:j] = self.bags(*passages(texts[i:j]))[0]
        return result


def _gradient(w: dict, k: dict, error: np.ndarray) -> dict[str, np.ndarray]:
    """Of the log loss, given `error`, its derivative by the score before the sigmoid."""
    def by_bag(t: np.ndarray) -> np.ndarray:
        return np.repeat(t, k["sizes"], axis=0)

    dz = error[:, None] * w["c"][None, :]
    dz_each = by_bag(dz)
    dh = k["a"][:, None] * dz_each
    da = (k["h"] * dz_each).sum(axis=1)
    ds = k["a"] * (da - by_bag(np.add.reduceat(k["a"] * da, k["heads"])))
    gate = k["v"] * k["u"]
    dg = ds[:, None] * w["a"][None, :]
    dv = dg * k["u"] * (1 - k["v"] ** 2)
    du = dg * k["v"] * k["u"] * (1 - k["u"])
    dh += dv @ w["V"].T + du @ w["U"].T
    de = dh * (1 - k["h"] ** 2)
    return {
        "E": k["x"].T @ de, "e": de.sum(axis=0), "V": k["h"].T @ dv, "U": k["h"].T @ du,
        "a": gate.T @ ds, "c": k["z"].T @ error, "b": error.sum(keepdims=True),
    }


def fit(
    x: np.ndarray,
    first: np.ndarray,
    marks: np.ndarray,
    epochs: int = 30,
    batch: int = 128,
    rate: float = 0.01,
    decay: float = 1e-4,
    seed: int = 5,
) -> Model:
    """Adam on the log loss of the bags; without bags every score is a half."""
    rng = np.random.default_rng(seed)
    centre = x.mean(axis=0) if len(x) else np.zeros(FEATURES)
    spread = x.std(axis=0) + 1e-3 if len(x) else np.ones(FEATURES)
    w = {
        "E": rng.normal(0, FEATURES**-0.5, (FEATURES, CODE)), "e": np.zeros(CODE),
        "V": rng.normal(0, CODE**-0.5, (CODE, GATE)), "U": rng.normal(0, CODE**-0.5, (CODE, GATE)),
        "a": rng.normal(0, GATE**-0.5, GATE), "c": np.zeros(CODE), "b": np.zeros(1),
    }
    model = Model(centre, spread, w)
    speed = {k: np.zeros_like(v) for k, v in w.items()}
    power = {k: np.zeros_like(v) for k, v in w.items()}
    step = 0
    for _ in range(epochs if len(marks) else 0):
        order = rng.permutation(len(marks))
        for i in range(0, len(order), batch):
            chosen = order[i : i + batch]
            sizes = first[chosen + 1] - first[chosen]
            heads = np.r_[0, np.cumsum(sizes)]
            rows = np.repeat(first[chosen] - heads[:-1], sizes) + np.arange(heads[-1])
            p, kept = model.bags(x[rows], heads)
            slope = _gradient(w, kept, (p - marks[chosen]) / len(chosen))
            step += 1
            for name, g in slope.items():
                g = g + decay * w[name]
                speed[name] += 0.1 * (g - speed[name])
                power[name] += 0.001 * (g * g - power[name])
                w[name] -= (
                    rate
                    * (speed[name] / (1 - 0.9**step))
                    / (np.sqrt(power[name] / (1 - 0.999**step)) + 1e-8)
                )
    return model


def train(docs: DataFrame, marks: DataFrame, per_label: int = MOST_PER_LABEL) -> Model:
    """Learns from at most `per_label` documents of each label that are not held out."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x, first = passages(list(batch["text"]))
            bags = [x[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
            yield pd.DataFrame({"id": batch["id"], "mark": batch["mark"], "bag": bags})

    chosen = labelled(docs, marks, "quality", per_label, "quality")
    sample = chosen.mapInPandas(encode, "id long, mark int, bag binary").toPandas()
    sample = sample.sort_values(["id", "mark"], kind="stable")
    bags = [np.frombuffer(b, np.float32).reshape(-1, FEATURES) for b in sample["bag"]]
    first = np.r_[0, np.cumsum([len(b) for b in bags])].astype(np.int64)
    x = np.concatenate(bags) if bags else np.zeros((0, FEATURES), np.float32)
    return fit(x, first, sample["mark"].to_numpy(dtype=float))


def score(docs: DataFrame, model: Model, column: str = "quality") -> DataFrame:
    """`docs` with the chance of being good; a column of that name is replaced.

    NULL and empty texts are one empty passage and get its score; rows are scored one by one, so
    repeated rows get equal scores; an empty table stays empty.
    """

    def read(batch: pa.RecordBatch):
        for part in text_parts(batch, "text"):
            scores = model.scores(part.column("text").to_pylist())
            yield part, [pa.array(scores, pa.float64())]

    return add_columns(docs, [T.StructField(column, T.DoubleType())], read)

