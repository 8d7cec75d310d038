"""Language of a text from a bidirectional gated recurrent network over its bytes.

A text is cut into pieces of `PIECE` bytes. One recurrent layer reads each piece forwards and one
backwards; the two states at a byte give it a distribution over the languages, and the document's
is the mean over all its bytes. Weights are learned in numpy by backpropagation through time from a
bounded sample of labelled pieces; whole texts are read when predicting.

The unit is the minimal gated one: f = (1 + s(h U + x)) / 2, c = s((f h) V + y), h = h + f (c - h),
where x and y are rows of two tables by byte and s(z) = z / (1 + |z|).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from silvermart.llm.common import add_columns, held_out, text_parts, uniform
from silvermart.llm.spans import slices

PIECE = 48
STATE = 8
# Texts learned from, per language, and pieces taken from each.
MOST_PER_LANGUAGE = 400
PIECES_PER_TEXT = 4
UNKNOWN = "und"
BATCH_BYTES = 1 << 17


def _soft(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), in place: the squashing function, a fraction of the cost of tanh."""
    scale = np.abs(x)
    scale += 1
    x /= scale
    return x


def pieces(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all pieces, (step, piece); the text of each piece; its length."""
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    sizes = np.array([len(r) for r in raw], np.int64)
    per_text = -(-sizes // PIECE)
    of = np.repeat(np.arange(len(raw)), per_text)
    number = np.arange(len(of)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    length = np.minimum(PIECE, sizes[of] - number * PIECE)
    padded = np.frombuffer(
        b"".join(r + bytes(-len(r) % PIECE) for r in raw), np.uint8
    ).reshape(-1, PIECE)
    return np.ascontiguousarray(padded.T), of, length


@dataclass(frozen=True)
class Model:
    """Weights of both directions (0 forwards, 1 backwards) and of the output."""

    languages: list[str]
    weights: dict[str, np.ndarray]

    def states(self, data: np.ndarray, length: np.ndarray, keep: bool = False):
        """States after every byte in reading order, (step, direction, piece, unit)."""
        w = self.weights
        steps, n = data.shape
        # Backwards, padding comes first; a state stays zero until the piece begins.
        both = np.stack([data, data[::-1]]).astype(np.intp)
        begun = (np.arange(steps)[::-1, None] < length[None, :]).astype(np.float32)
        h = np.zeros((2, n, STATE), np.float32)
        after = np.empty((steps, 2, n, STATE), np.float32)
        gates, parts = [], []
        x = np.empty_like(h)
        for t in range(steps):
            f = np.matmul(h, w["U"])
            for d in (0, 1):
                np.take(w["X"][d], both[d, t], axis=0, out=x[d])
            f += x
            f = _soft(f)
            f *= 0.5
            f += 0.5
            c = np.matmul(f * h, w["V"])
            for d in (0, 1):
                np.take(w["Y"][d], both[d, t], axis=0, out=x[d])
            c += x
            c = _soft(c)
            if keep:
                gates.append(f)
                parts.append(c)
            fresh = c - h
            fresh *= f
            fresh += h
            fresh[1] *= begun[t][:, None]
            after[t] = h = fresh
        return (after, gates, parts, both, begun) if keep else after

    def labels(self, after: np.ndarray) -> np.ndarray:
        """Distribution over the languages at every byte, (step, piece, language)."""
        w = self.weights
        score = np.matmul(after[:, 0], w["O"][0])
        score += np.matmul(after[::-1, 1], w["O"][1])
        score += w["o"]
        np.clip(score, -40, 40, out=score)
        np.exp(score, out=score)
        score /= np.matmul(score, np.ones((score.shape[2], 1), np.float32))
        return score

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and its pooled chance; `UNKNOWN` and 0 for texts without a letter."""
        names, chances = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return names, chances
        sizes = [len(t or "") + 1 for t in texts]
        for a, b in slices(sizes, BATCH_BYTES):
            data, of, length = pieces(texts[a:b])
            pooled = np.zeros((b - a, len(self.languages)))
            for i in range(0, len(of), BATCH_BYTES // PIECE):
                part = slice(i, i + BATCH_BYTES // PIECE)
                labelled = self.labels(self.states(data[:, part], length[part]))
                inside = (np.arange(PIECE)[:, None] < length[part][None, :]).astype(np.float32)
                sums = np.einsum("tnl,tn->nl", labelled, inside)
                np.add.at(pooled, of[part], sums)
            total = pooled.sum(axis=1)
            for i in range(a, b):
                if total[i - a] and any(c.isalpha() for c in texts[i]):
                    best = int(pooled[i - a].argmax())
                    names[i] = self.languages[best]
                    chances[i] = min(1.0, pooled[i - a, best] / total[i - a])
        return names, chances


def _gradient(model: Model, data: np.ndarray, length: np.ndarray, target: np.ndarray) -> dict:
    """Of the mean log loss over all bytes, by backpropagation through time."""
    w = model.weights
    steps, n = data.shape
    after, gates, parts, both, begun = model.states(data, length, keep=True)
    slope = model.labels(after)
    slope[:, np.arange(n), target] -= 1
    inside = (np.arange(steps)[:, None] < length[None, :]).astype(np.float32)
    slope *= inside[:, :, None] / max(1.0, inside.sum())
    grads = {k: np.zeros_like(v) for k, v in w.items()}
    grads["o"] = slope.sum(axis=(0, 1))
    grads["O"][0] = np.einsum("tnu,tnl->ul", after[:, 0], slope, optimize=True)
    grads["O"][1] = np.einsum("tnu,tnl->ul", after[::-1, 1], slope, optimize=True)
    from_output = np.stack(
        [np.matmul(slope, w["O"][0].T), np.matmul(slope, w["O"][1].T)[::-1]], axis=1
    )
    back = np.zeros((2, n, STATE), np.float32)
    zero = np.zeros((2, n, STATE), np.float32)
    ut, vt = w["U"].transpose(0, 2, 1), w["V"].transpose(0, 2, 1)
    for t in range(steps - 1, -1, -1):
        back = back + from_output[t]
        back[1] *= begun[t][:, None]
        before = after[t - 1] if t else zero
        f, c = gates[t], parts[t]
        dc = back * f * (1 - np.abs(c)) ** 2
        through = np.matmul(dc, vt)
        df = (back * (c - before) + through * before) * 0.5 * (1 - np.abs(2 * f - 1)) ** 2
        grads["V"] += np.matmul((f * before).transpose(0, 2, 1), dc)
        grads["U"] += np.matmul(before.transpose(0, 2, 1), df)
        for d in (0, 1):
            np.add.at(grads["X"][d], both[d, t], df[d])
            np.add.at(grads["Y"][d], both[d, t], dc[d])
        back = back * (1 - f) + through * f + np.matmul(df, ut)
    return grads


def fit(
    texts: list[bytes],
    target: np.ndarray,
    languages: list[str],
    steps: int = 240,
    batch: int = 192,
    rate: float = 0.02,
    seed: int = 11,
) -> Model:
    """Adam on batches that hold every language equally often."""
    rng = np.random.default_rng(seed)

    def drawn(*shape: int, scale: float) -> np.ndarray:
        return rng.normal(0, scale, shape).astype(np.float32)

    n = len(languages)
    w = {
        "X": drawn(2, 256, STATE, scale=0.5),
        "Y": drawn(2, 256, STATE, scale=0.5),
        "U": drawn(2, STATE, STATE, scale=STATE**-0.5),
        "V": drawn(2, STATE, STATE, scale=STATE**-0.5),
        "O": drawn(2, STATE, n, scale=0.3),
        "o": np.zeros(n, np.float32),
    }
    model = Model(languages, w)
    if n < 2:
        return model
    speed = {k: np.zeros_like(v) for k, v in w.items()}
    power = {k: np.zeros_like(v) for k, v in w.items()}
    by_language = [np.flatnonzero(target == i) for i in range(n)]
    share = max(1, batch // n)
    size = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(t.ljust(PIECE, b"\0") for t in texts), np.uint8)
    data = data.reshape(-1, PIECE).T
    for step in range(1, steps + 1):
        chosen = np.concatenate([rng.choice(rows, share) for rows in by_language])
        slope = _gradient(model, data[:, chosen], size[chosen], target[chosen])
        norm = np.sqrt(sum(float((g * g).sum()) for g in slope.values()))
        pace = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for name, g in slope.items():
            g = g * min(1.0, 1.0 / (norm + 1e-12))
            speed[name] += 0.1 * (g - speed[name])
            power[name] += 0.01 * (g * g - power[name])
            w[name] -= (
                pace
                * (speed[name] / (1 - 0.9**step))
                / (np.sqrt(power[name] / (1 - 0.99**step)) + 1e-8)
            )
    return model


def train(
    docs: DataFrame,
    per_language: int = MOST_PER_LANGUAGE,
    per_text: int = PIECES_PER_TEXT,
) -> Model:
    """Learns from `per_text` pieces of about `per_language` texts of each language.

    Held-out documents, NULL texts and NULL languages are left out. Which texts is decided by a hash
    of id and text against the share that gives `per_language` on average, and never more than twice
    as many; the pieces of a text are spread evenly over it. Only pieces reach the driver.
    """
    known = docs.select("doc_id", "text", "lang").where(
        F.col("text").isNotNull()
        & F.col("lang").isNotNull()
        & (F.length("text") > 0)
        & ~held_out(F.col("doc_id"))
    )
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return fit([], np.zeros(0, np.int64), [])
    draw = uniform(F.col("doc_id"), F.xxhash64("text"), seed=11)
    share = F.coalesce(
        *[F.when(F.col("lang") == k, min(1.0, per_language / n)) for k, n in counts.items()]
    )

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text, lang in zip(batch["doc_id"], batch["text"], batch["lang"]):
                raw = text.encode("utf-8", "surrogatepass")
                last = max(0, len(raw) - PIECE)
                starts = {round(last * i / max(1, per_text - 1)) for i in range(per_text)}
                rows += [(doc, s, lang, raw[s : s + PIECE]) for s in sorted(starts)]
            yield pd.DataFrame(rows, columns=["doc_id", "at", "lang", "piece"])

    most = 2 * per_language * per_text * len(languages)
    sample = (
        known.where(draw < share)
        .mapInPandas(cut, "doc_id long, at long, lang string, piece binary")
        .limit(most)
        .toPandas()
        .sort_values(["lang", "doc_id", "at", "piece"], kind="stable")
    )
    found = sorted(sample["lang"].unique())
    place = {name: i for i, name in enumerate(found)}
    target = np.array([place[name] for name in sample["lang"]], np.int64)
    return fit(list(sample["piece"]), target, found)


def identify(
    docs: DataFrame, model: Model, language: str = "lang_pred", chance: str = "score"
) -> DataFrame:
    """`docs` with the predicted language and its chance; columns of those names are replaced.

    NULL texts and texts without a letter, or a model that has learned nothing, give `UNKNOWN` and 0.
    Rows are read one by one, so repeated rows get equal results; an empty table stays empty.
    """

    def read(batch: pa.RecordBatch):
        for part in text_parts(batch, "text"):
            names, chances = model.predict(part.column("text").to_pylist())
            yield part, [pa.array(names, pa.string()), pa.array(chances, pa.float64())]

    fields = [T.StructField(language, T.StringType()), T.StructField(chance, T.DoubleType())]
    return add_columns(docs, fields, read)
