import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from llm.helpers import documents
from trustscore.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts():
    draw = random.Random(2)
    letters = [chr(c) for c in (*range(9, 14), *range(28, 127), 0x85, 0xA0, 0xE9, 0x2003, 0x3000, 0x65E5, 0x1F600, 0x300)]
    made = ["".join(draw.choices(letters, k=draw.randrange(80))) for _ in range(800)]
    long = ["a" * 300, "ab" * 700, "é" * 200, " " * 500, "1234567890" * 50, "".join(draw.choices("etaoin", k=5000))]
    special = ["<|endoftext|>", "a<|endoftext|>b<|endoftext|>", "<|endoftext|", "<|endoftext|> x"]
    return ["", " ", "don't I'LL we've", *made, *long, *special]


def test_ids_and_texts_match_the_library(spark, library):
    rows = [(i, text) for i, text in enumerate(texts())] + [(-1, None)]
    got = {r.doc_id: r for r in bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()}
    for number, text in rows:
        wanted = library.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(got[number].ids, "<u4").tolist() == wanted
        assert got[number].decoded == library.decode(wanted, skip_special_tokens=False) == (text or "")


def test_heap_and_array_merge_alike():
    known, draw = bpe.Encoder(PATH), random.Random(4)
    for _ in range(400):
        word = bytes(draw.choices(b"aeinrst th\xc3\xa9", k=draw.randrange(1, 90)))
        assert known.merge(word) == known.merge_long(word)


def test_small_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_WORDS", 3)
    small, large = bpe.Encoder(PATH), bpe.Encoder(PATH)
    monkeypatch.setattr(bpe, "CACHED_WORDS", 10_000)
    text = " ".join(f"word{i % 17} other{i % 5}" for i in range(300))
    assert small.encode(text) == large.encode(text)


def test_edges(spark):
    assert bpe.encode(documents(spark, []), PATH).count() == 0
    frame = spark.createDataFrame([(1, "a", "x"), (1, "a", "x")], "doc_id long, text string, ids string")
    assert bpe.encode(frame, PATH).count() == 2
    with pytest.raises(ValueError):
        bpe.encode(frame, PATH, ("doc_id", "ids"))
