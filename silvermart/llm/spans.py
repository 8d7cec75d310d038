"""Words of many texts at once: byte spans and 64-bit hashes, computed on arrays inside a task."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np

U = np.uint64
_STEP = 0x9E3779B97F4A7C15  # odd; the base of the word hash
_BACK = pow(_STEP, -1, 1 << 64)
CHUNK_BYTES = 1 << 19


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the whole word (finaliser of splitmix64)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * U(_STEP))

# Byte classes: white space of the word rule, and everything that is no letter or digit.
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
PUNCTUATION = np.ones(256, dtype=bool)
PUNCTUATION[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64, at least n of them."""
    held = _powers.get(base)
    if held is None or len(held) < n:
        held = np.full(max(n, CHUNK_BYTES + 1), base, dtype=np.uint64)
        held[0] = 1
        _powers[base] = held = np.cumprod(held, dtype=np.uint64)
    return held[:n]


def _pieces(text: bytes, breaks: np.ndarray) -> Iterator[bytes]:
    """A long text in parts of bounded size that end between words, where words are that short."""
    at = 0
    while len(text) - at > CHUNK_BYTES:
        cut = at + CHUNK_BYTES
        window = breaks[np.frombuffer(text, np.uint8, CHUNK_BYTES, at)]
        spaces = np.flatnonzero(window)
        if len(spaces):
            cut = at + int(spaces[-1]) + 1
        else:
            while cut < len(text) and not breaks[text[cut]]:
                cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:]


@dataclass
class Words:
    """Words of several texts: `first[i]:first[i + 1]` are those of text i."""

    hashes: np.ndarray
    starts: np.ndarray  # byte offsets in the text the word is from
    ends: np.ndarray
    first: np.ndarray
    classes: np.ndarray | None = None  # bytes of each class per word

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(
    texts: Iterable[str | None],
    breaks=SPACES,
    lower: bool = False,
    classes: np.ndarray | None = None,
) -> Words:
    """Words between `breaks`, hashed without regard to case if `lower`; none for NULL.

    With `classes`, the class number of every byte, each word's bytes are counted by class.
    """
    hashes, starts, ends, counts = [], [], [], []
    kinds = 0 if classes is None else int(classes.max()) + 1
    tallies = [np.zeros((0, kinds), np.int32)]
    pending: list[tuple[int, int, bytes]] = []  # text, offset in it, bytes
    held = 0

    def flush() -> None:
        nonlocal held
        if not pending:
            return
        joined = np.frombuffer(b" ".join([p[2] for p in pending]) + b" ", np.uint8)
        inside = ~breaks[joined]
        inside_before = np.empty_like(inside)
        inside_before[0], inside_before[1:] = False, inside[:-1]
        s = np.flatnonzero(inside & ~inside_before)
        e = np.flatnonzero(~inside & inside_before)
        values = _BYTE[LOWER[joined] if lower else joined] * _power(_STEP, len(joined))
        total = np.empty(len(joined) + 1, np.uint64)
        total[0] = 0
        np.cumsum(values, out=total[1:])
        hashes.append(
            mixed((total[e] - total[s]) * _power(_BACK, len(joined))[s] + (e - s).astype(U))
        )
        if kinds:
            kind, tally = classes[joined], np.empty((len(s), kinds), np.int32)
            running = np.zeros(len(joined) + 1, np.int32)
            for k in range(kinds):
                np.cumsum(kind == k, out=running[1:])
                tally[:, k] = running[e] - running[s]
            tallies.append(tally)
        sizes = np.array([len(p[2]) + 1 for p in pending])
        begins = np.cumsum(sizes) - sizes
        of = np.searchsorted(begins, s, side="right") - 1
        shift = np.array([p[1] for p in pending]) - begins
        starts.append(s + shift[of])
        ends.append(e + shift[of])
        for (text, _, _), n in zip(pending, np.bincount(of, minlength=len(pending))):
            counts[text] += int(n)
        pending.clear()
        held = 0

    for i, text in enumerate(texts):
        counts.append(0)
        raw = text.encode("utf-8", "surrogatepass") if text else b""
        offset = 0
        for piece in _pieces(raw, breaks) if len(raw) > CHUNK_BYTES else (raw,):
            pending.append((i, offset, piece))
            offset += len(piece)
            held += len(piece) + 1
            if held >= CHUNK_BYTES:
                flush()
    flush()
    first = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=first[1:])
    empty = np.zeros(0, np.int64)
    return Words(
        np.concatenate(hashes) if hashes else np.zeros(0, np.uint64),
        np.concatenate(starts) if starts else empty,
        np.concatenate(ends) if ends else empty,
        first,
        np.concatenate(tallies) if kinds else None,
    )


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Order-sensitive hash of every `size` neighbours, as if all were one text."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(size):
        total = total * U(_STEP) + hashes[i : i + n]
    return mixed(total)


def slices(sizes: Iterable[int], limit: int) -> Iterator[tuple[int, int]]:
    """Neighbouring rows in groups of at most `limit` in sum, or of one row."""
    start, held, i = 0, 0, -1
    for i, size in enumerate(sizes):
        if held and held + size > limit:
            yield start, i
            start, held = i, 0
        held += size
    if i >= start:
        yield start, i + 1
