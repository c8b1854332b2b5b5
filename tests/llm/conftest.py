"""Small tables for the operators' tests."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def prose(rng: random.Random, n: int, vocabulary: int = 300) -> str:
    words = ["".join(rng.choice(LETTERS) for _ in range(2 + k % 6)) for k in range(vocabulary)]
    return " ".join(rng.choice(words) for _ in range(n))


def odd_texts() -> list:
    """Nulls, empties, white space, ties, special strings, scripts, astral letters, marks and a very long text."""
    rng = random.Random(5)
    long = prose(rng, 30_000)
    return [
        None, "", " ", "\n\t \r\n", "a", "a b", "a b c", "The MIT License.", "It's a dog's life, isn't it?  Yes...", "İstanbul ÇAĞ ſ ﬁ Ώ é",
        "<|endoftext|>", "x<|endoftext|> <|startoftext|>y <|EndOfText|>", "日本語のテキスト。中文 한국어", "😀 𝔘𝔫𝔦𝔠𝔬𝔡𝔢 👩‍👩‍👧", "tab\tand\x0bvt\x0cff\x85nel\xa0nbsp em​zw﻿", "١٢٣ ४५६ 123,456.7",
        "a" * 5_000, "ab " * 3_000, long, long, long[:-1], long + "!", "Ends. With, comma,", "''' ''s 'll I'LL", "\x00\x01\x7f\x80", "   lead and trail   ",
    ]


@pytest.fixture(scope="session")
def odd(spark):
    """The odd texts as documents: some ids null or repeated, one row twice, and columns with the operators' inner names."""
    from pyspark.sql import functions as F

    texts = odd_texts()
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)] + [(None, "null id text " * 30, None, None, None), (None, None, None, None, None), (3, "same id, other text " * 20, "en", "s", 1), (6, "a b c", "en", "s", 5)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3, F.xxhash64("text", "doc_id"))


@pytest.fixture(scope="session")
def clashing():
    """Adds columns named like what operators use inside."""
    from pyspark.sql import functions as F

    def add(docs):
        for name in ("did", "tag", "row", "spans", "score", "rank", "key", "fp", "least", "root", "toxic", "quality", "words", "sketch", "range", "own", "noise", "item_id"):
            docs = docs.withColumn(name, F.lit(7))
        return docs

    return add


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
