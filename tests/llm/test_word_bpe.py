from __future__ import annotations

import random

from silvermart.llm.queries import tokenizer_path
from silvermart.llm.word_bpe import WordTable, byte_letters, decode, encode, round_trip, tokenizer
from tests.llm.conftest import SMALL, table

PATH = tokenizer_path()


def library(text: str) -> tuple[list[int], str]:
    known = tokenizer(PATH)
    ids = known.encode(text, add_special_tokens=False).ids
    return ids, known.decode(ids, skip_special_tokens=False)


def test_whole_table(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in table("documents")}
    rows = round_trip(spark.read.parquet(f"{SMALL}/documents.parquet"), PATH).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.ids, r.decoded) == library(texts[r.doc_id])


def test_any_text():
    random.seed(4)
    parts = [
        "a", "B", "İ", "ß", "é", "é", "É", "ÿ", "×", "́", "'s", "'", "it's", "-", "&",
        "<|endoftext|>", "<|startoftext|>", " ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0",
        " ", "​", "1", "22", "漢", "!", "?!", ".,", "$$$", "_", "😀", "Σ", "ς", "ﬁ", "`",
    ]
    table_ = WordTable(PATH, most_words=50)
    for _ in range(3000):
        text = "".join(random.choice(parts) for _ in range(random.randint(0, 12)))
        flat, starts = table_.encode([None, text])
        assert flat.tolist() == library(text)[0] and starts.tolist() == [0, 0, len(flat)]


def test_byte_letters_are_those_of_the_vocabulary():
    assert len(set(byte_letters())) == 256
    vocabulary = tokenizer(PATH).get_vocab()
    assert all(letter in vocabulary for letter in byte_letters())


def test_odd_rows(docs, spark):
    long = "word! " * 50_000
    rows = docs((1, None), (2, ""), (3, " \n"), (4, long), (4, long), (None, "A"))
    got = encode(rows.withColumnRenamed("lang", "ids"), PATH).collect()
    assert sorted(len(r.ids) for r in got) == [0, 0, 0, 1, 100_000, 100_000]
    assert encode(rows.limit(0), PATH).count() == 0
    ids = spark.createDataFrame(
        [([49407, 320],), (None,), ([],), ([10**7],)], "ids array<int>"
    )
    assert sorted(r.decoded for r in decode(ids, PATH).collect()) == [
        "", "", "", tokenizer(PATH).decode([49407, 320], skip_special_tokens=False),
    ]
