"""Token counts, the codec and the token store against the library itself."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lexspan.llm import bpe_codec, bytebpe, token_counts, token_store
from lexspan.llm.token_store import WaveletMatrix, pack

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def library(path):
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def ids_of(tok, text):
    return tok.encode(text or "", add_special_tokens=False).ids


def test_pieces_encode_as_the_library(documents):
    from tests.llm.conftest import odd_texts

    tok, encoder, counter = library(BYTE), bytebpe.Encoder(BYTE), bytebpe.Counter(BYTE)
    rng, parts = random.Random(1), ["a", "é", "Don't", ".", ",", " ", "  ", "\n", "\t", "1", " ", " ", "᠎", "​", "﻿", "日", "😀", "'s", "<|endoftext|>", "\x1c", "\x85", "ab", "İ"]
    texts = [t or "" for t in odd_texts()] + ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(3_000)] + [r.text for r in documents.limit(60).collect()]
    width = "<u2" if encoder.width == 2 else "<u4"
    for k in (1, 700):
        for at in range(0, len(texts) if k > 1 else 60, k):
            flat, size = encoder.batch(pa.array(texts[at : at + k]), 2)
            want = [[*ids_of(tok, t), 2] for t in texts[at : at + k]]
            assert size.tolist() == [len(w) for w in want] and flat.tolist() == [i for w in want for i in w]
    for t in texts:
        want = ids_of(tok, t)
        assert np.frombuffer(encoder(t), width).tolist() == want, t[:80]
        assert counter(t) == len(want), t[:80]


def test_counts(odd, clashing):
    tok = library(BYTE)
    want = Counter((r.doc_id, len((r.text or "").encode()), n := len(ids_of(tok, r.text)), n > 1024) for r in odd.collect())
    assert Counter(map(tuple, token_counts.token_counts(clashing(odd), BYTE).collect())) == want
    assert token_counts.token_counts(odd.limit(0), BYTE).count() == 0


def test_summaries_never_lose_a_frequent_piece():
    tally = token_counts._trimmed(Counter({f"w{k}": 1 for k in range(1_000)} | {"the": 500}), 10)
    assert "the" in tally and len(tally) <= 10


def digests(tok, text):
    ids = ids_of(tok, text)
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("hot_bytes", [bpe_codec.HOT_BYTES, 2_000])
def test_codec(odd, clashing, monkeypatch, hot_bytes):
    """With a table that fits, and with one so small that most words take the join."""
    monkeypatch.setattr(bpe_codec, "HOT_BYTES", hot_bytes)
    tok = library(WORD)
    want = Counter((r.doc_id, *digests(tok, r.text)) for r in odd.collect())
    assert Counter(map(tuple, bpe_codec.encode_digests(clashing(odd), WORD).collect())) == want
    assert bpe_codec.encode_digests(odd.limit(0), WORD).count() == 0


def test_codec_words_are_independent():
    tok, rng = library(WORD), random.Random(2)
    parts = ["a", "É", "Don't", ".", ",", " ", "  ", "\n", "1", " ", " ", "日", "'s", "<|endoftext|>", "<|ENDOFTEXT|>", "é", "Σ", "ς", "́", "I'LL", "_", "\x0b", "\x0c", "\x1c", "\x85"]
    for _ in range(3_000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        split = bpe_codec.Split(pa.array([t]))
        assert split.begin.tolist() == [0, len(split.at)]
        assert [i for w in split.words.take(pa.array(split.at)).to_pylist() for i in ids_of(tok, w)] == ids_of(tok, t), repr(t)


def test_codec_refuses_other_tokenizers():
    with pytest.raises(ValueError):
        bpe_codec.verified(BYTE)


def test_decoding_is_a_join(spark):
    tok = library(WORD)
    ids = [ids_of(tok, t) for t in ("Hello, world", "x", "hello hello", "")]
    table = spark.createDataFrame([(k, i) for k, i in enumerate(ids)], "k int, ids array<int>")
    got = {r.k: " ".join(r.pieces) for r in bpe_codec.decoded(table, ["k"], WORD).collect()}
    assert got == {k: tok.decode(i, skip_special_tokens=False) for k, i in enumerate(ids) if i}


def test_codec_gives_ids_and_texts(documents):
    tok = library(WORD)
    texts = {r.doc_id: r.text for r in documents.limit(20).collect()}
    for r in bpe_codec.encode_documents(documents.limit(20), WORD).collect():
        assert r.ids == ids_of(tok, texts[r.doc_id]) and r.decoded == tok.decode(r.ids, skip_special_tokens=False)


def test_store(odd, clashing, monkeypatch):
    monkeypatch.setattr(token_store, "SHARD_TOKENS", 5_000)  # several shards a partition
    monkeypatch.setattr(token_store, "BATCH_BYTES", 20_000)
    tok = library(BYTE)
    rows = clashing(odd).filter("doc_id is not null").dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
    want, at = set(), 0
    for r in rows:
        ids = np.array([*ids_of(tok, r.text), 2], "<u4")
        want.add((r.doc_id, at, len(ids), zlib.crc32(ids.tobytes()), int((ids == 2).sum())))
        at += len(ids)
    frame = odd.sparkSession.createDataFrame(rows, clashing(odd).schema)
    assert set(map(tuple, token_store.token_store(frame, BYTE).collect())) == want
    every = sorted((r.start, r.n_tokens) for r in token_store.token_store(odd, BYTE).collect())
    assert len(every) == odd.count() and all(a + n == b for (a, n), (b, _) in zip(every, every[1:], strict=False))
    assert token_store.token_store(odd.limit(0), BYTE).count() == 0


@pytest.mark.parametrize(("n", "planes"), [(0, 4), (1, 1), (63, 3), (64, 5), (1_000, 16), (777, 20)])
def test_wavelet_matrix(n, planes):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, min(1 << planes, 50), n).astype("<u2" if planes <= 16 else "<u4")
    m = WaveletMatrix(pack(ids, np.array([0, n])))
    assert m.decode().tolist() == ids.tolist() and [m.access(i) for i in range(n)] == ids.tolist()
    for v in {*ids.tolist()[:20], 0, (1 << planes) - 1}:
        places = np.flatnonzero(ids == v).tolist()
        assert m.count(v) == len(places) and m.occurrences(v) == places
        assert [m.rank(v, i) for i in (0, n // 2, n)] == [sum(p < i for p in places) for i in (0, n // 2, n)]
    assert m.count(1 << planes) == 0
    with pytest.raises(IndexError):
        m.access(n)
    with pytest.raises(IndexError):
        m.select(0, n)


def test_wavelet_matrix_is_compressed():
    """Planes and directory take about the ids' entropy, and a skewed code has levels of unlike lengths."""
    rng = np.random.default_rng(3)
    ids = np.minimum(rng.zipf(1.6, 200_000), 40_000).astype("<u2")
    p = np.bincount(ids) / len(ids)
    entropy = -(p[p > 0] * np.log2(p[p > 0])).sum()
    blob = pack(ids, np.array([0, len(ids)]))
    m = WaveletMatrix(blob)
    assert len(blob) * 8 / len(ids) < entropy * 1.25 + 0.5 and (m.decode() == ids).all()
    assert m.sizes.tolist() == sorted(m.sizes.tolist(), reverse=True) and m.sizes[-1] < len(ids) / 100
    places = rng.integers(0, len(ids) + 1, 50)
    for v in (1, 2, 7, 39_999, 40_000):
        assert m.ranks(v, places).tolist() == [(ids[:i] == v).sum() for i in places.tolist()]


def test_one_doc_id_many_texts(spark):
    docs = spark.createDataFrame([(5, f"text number {k} " * 9) for k in range(200)], "doc_id long, text string").repartition(4)
    tok, got = library(BYTE), token_store.token_store(docs, BYTE).collect()
    assert sorted(r.n_tokens for r in got) == sorted(len(ids_of(tok, r.text)) + 1 for r in docs.collect())
    ends = sorted((r.start, r.n_tokens) for r in got)
    assert ends[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(ends, ends[1:], strict=False))
