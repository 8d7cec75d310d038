"""BPE encoding and decoding through a table of distinct words.

White space always separates words for this kind of tokenizer, so a text's ids are its words' ids
in a row. Each task splits its texts, gives every distinct word a place in a table, encodes a word
when it first meets it, and puts the ids back by position; decoding looks the pieces up by id, a
table as long as the vocabulary.

The table belongs to the task and not to the whole corpus: putting ids back through a shuffle moves
every word of every text, several times the size of the texts (see README).
"""

from __future__ import annotations

import os
import re
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from silvermart.llm.common import add_columns, text_parts

# The table is emptied when it holds this many words; memory stays bounded, results are the same.
MOST_WORDS = 150_000
BATCH_CHARS = 1 << 19

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
# Letters that no normal form changes, then marks that start no contraction and no special piece:
# the tokenizer splits such a word between the two, whatever the letters are.
_SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:;=?@\[-`{-~]*)")


def tokenizer(path: str):
    """The tokenizer in a file, without truncation and padding; kept within a Python worker."""
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        loaded = Tokenizer.from_file(path)
        loaded.no_truncation()
        loaded.no_padding()
        _tokenizers[path] = loaded
    return _tokenizers[path]


_tokenizers: dict = {}


@cache
def pieces_of(path: str) -> list[str | None]:
    """The piece of every id."""
    known = tokenizer(path)
    return [known.id_to_token(i) for i in range(known.get_vocab_size(with_added_tokens=True))]


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies.

    Printable bytes stand for themselves, the others for the code points from 256 on.
    """
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class WordTable:
    """Ids of distinct words, each encoded once."""

    def __init__(self, path: str, most_words: int = MOST_WORDS):
        self.tokenizer = tokenizer(path)
        self.most_words = most_words
        letters = byte_letters()
        self.spelled = {
            ord(c): "".join(letters[b] for b in c.encode()) for c in map(chr, range(192, 256))
        }
        self._empty()

    def _empty(self) -> None:
        self.place: dict[str, int] = {}
        self.parts: dict[str, list[int]] = {}
        self.ids = np.zeros(0, np.int32)
        self.start = np.zeros(1, np.int64)

    def _part(self, part: str) -> list[int]:
        found = self.parts.get(part)
        if found is None:
            spelled = part if part.isascii() else part.translate(self.spelled)
            found = self.parts[part] = [t.id for t in self.tokenizer.model.tokenize(spelled)]
        return found

    def _word(self, word: str) -> list[int]:
        simple = _SIMPLE.fullmatch(word)
        if not simple:
            return self.tokenizer.encode(word, add_special_tokens=False).ids
        core, marks = simple.groups()
        found = self._part(core.lower())
        return found + self._part(marks) if marks else found

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where those of each text begin; NULL counts as empty."""
        if len(self.place) > self.most_words:
            self._empty()
        place = self.place
        split = [_WORD.findall(t) if t else [] for t in texts]
        flat = list(chain.from_iterable(split))
        words = list(map(place.get, flat))
        if None in words:
            new = dict.fromkeys(w for w, known in zip(flat, words) if known is None)
            ids: list[int] = []
            ends = []
            for w in new:
                place[w] = len(place)
                ids += self._word(w)
                ends.append(len(ids))
            self.start = np.concatenate([self.start, np.array(ends) + len(self.ids)])
            self.ids = np.concatenate([self.ids, np.array(ids, np.int32)])
            words = list(map(place.get, flat))
        at_words = np.array(words, np.int64)
        counts = np.fromiter(map(len, split), np.int64, len(split))
        begin, size = self.start[at_words], self.start[at_words + 1] - self.start[at_words]
        upto = np.cumsum(size)
        at = np.arange(upto[-1] if len(upto) else 0) + np.repeat(begin - (upto - size), size)
        text_end = np.r_[0, upto][np.cumsum(counts)]
        return self.ids[at], np.r_[0, text_end]


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """`docs` with the ids of every whole text; a column of that name is replaced.

    NULL and empty texts have no ids; repeated rows get equal ids; an empty table stays empty.
    """

    tables: list[WordTable] = []

    def read(batch: pa.RecordBatch):
        for part in text_parts(batch, text, limit=BATCH_CHARS):
            flat, starts = _table(tables, path).encode(part.column(text).to_pylist())
            yield part, [pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(flat))]

    return add_columns(docs, [T.StructField(ids, T.ArrayType(T.IntegerType()))], read)


def _table(tables: list[WordTable], path: str) -> WordTable:
    """The task's table, made when the first batch comes."""
    if not tables:
        tables.append(WordTable(path))
    return tables[0]


def spelled(flat: np.ndarray, ends: np.ndarray, path: str) -> list[str]:
    """The texts that rows of ids stand for; row i ends at `ends[i]`."""
    known, pieces = tokenizer(path), pieces_of(path)
    size, found, a = len(pieces), [], 0
    for b in ends.tolist():
        mine, a = flat[a:b].tolist(), b
        if known.decoder is None:
            named = [pieces[i] for i in mine if 0 <= i < size]
            found.append(" ".join([p for p in named if p is not None]))
        else:
            found.append(known.decode(mine, skip_special_tokens=False))
    return found


def decode(docs: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """`docs` with the text that lists of ids stand for, special pieces included.

    NULL and empty lists give an empty text; ids outside the vocabulary give nothing.
    """

    def read(batch: pa.RecordBatch):
        for part in text_parts(batch, ids, limit=BATCH_CHARS):
            column = part.column(ids)
            flat = column.flatten().to_numpy(zero_copy_only=False)
            sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            yield part, [pa.array(spelled(flat, np.cumsum(sizes), path), pa.string())]

    return add_columns(docs, [T.StructField(text, T.StringType())], read)


def round_trip(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """`docs` with ids and decoded text, as encode and decode give them, in one pass."""
    tables: list[WordTable] = []

    def read(batch: pa.RecordBatch):
        for part in text_parts(batch, text, limit=BATCH_CHARS):
            flat, starts = _table(tables, path).encode(part.column(text).to_pylist())
            listed = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(flat))
            yield part, [listed, pa.array(spelled(flat, starts[1:], path), pa.string())]

    fields = [
        T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("decoded", T.StringType()),
    ]
    return add_columns(docs, fields, read)
