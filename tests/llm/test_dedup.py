"""Repeated bytes and near duplicates against brute force."""

from __future__ import annotations

import hashlib
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from lexspan.llm import common, simhash, suffix_dedup
from tests.llm.conftest import SCHEMA, prose


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts, strict=True)], SCHEMA).repartition(3)


def removed_spans(texts):
    """Maximal byte runs that the repeated 200-byte strings cover, by counting every string of every text."""
    raws = [(t or "").encode() for t in texts]
    seen = Counter(hashlib.md5(r[i : i + 200]).digest() for r in raws for i in range(len(r) - 199))
    out = []
    for r in raws:
        cover = np.zeros(len(r), bool)
        for i in range(len(r) - 199):
            if seen[hashlib.md5(r[i : i + 200]).digest()] > 1:
                cover[i : i + 200] = True
        out.append(cover)
    return raws, out


def wanted(texts):
    out = []
    for raw, cover in zip(*removed_spans(texts), strict=True):
        edges = np.diff(np.concatenate(([0], cover.astype(int), [0])))
        out.append((len(raw), int(cover.sum()), int((edges == 1).sum()), hashlib.sha256(np.frombuffer(raw, np.uint8)[~cover].tobytes()).hexdigest()))
    return out


def repetitive():
    rng = random.Random(3)
    base = prose(rng, 400)
    word = base.split(" ")
    edited = [" ".join(w if rng.random() > 0.02 else "zz" for w in word) for _ in range(12)]
    shared = prose(rng, 60)
    return [
        None, "", "a" * 199, "a" * 200, "a" * 201, "b" * 700, "ab" * 300, base, base, base[1:], base[:-1], *edited, base[:300] + "é" + base[301:],
        *(prose(rng, 30) + " " + shared + " " + prose(rng, 30) for _ in range(6)), base[:210] + base[:210], "é" * 150, "xé" + "é" * 120, prose(rng, 500), base[:199], base[200:399] + "!",
        "".join(rng.choice("ab") for _ in range(3_000)), "日本" * 90, ("q" * 37 + "r") * 20, ("q" * 37 + "r") * 20 + "q",
    ]


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 1])
def test_repeated_bytes(spark, clashing, monkeypatch, hot):
    """With words' classes ranked in a task, and (hot 1) by the distributed aggregation."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    texts = repetitive()
    got = suffix_dedup.dedup_digests(clashing(frame(spark, texts))).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == dict(enumerate(wanted(texts)))


def test_repeats_are_read_from_the_arrays():
    """rim_order against comparing all strings of all rims, on rims of few letters that agree to all depths."""
    rng, repeats = random.Random(14), 0
    for _ in range(30):
        word, before, more, raw = [], [], [], []
        for g in range(5):
            trigger = bytes(rng.choice(b"xy") for _ in range(65))
            stems = [bytes(rng.choice(b"ab\x00\xf4") for _ in range(136)) for _ in range(2)]
            tails = [bytes(rng.choice(b"cd\x00\xf4") for _ in range(136)) for _ in range(2)]
            for _ in range(rng.randrange(1, 9)):
                stem, tail = bytearray(rng.choice(stems)), bytearray(rng.choice(tails))
                for part in (stem, tail):
                    if rng.random() < 0.7:
                        part[rng.randrange(136)] = 99
                t = rng.randrange(136)
                m = rng.randrange(t + 1)
                word.append(g), before.append(t), more.append(m)
                raw.append(bytes(stem[136 - t :]) + trigger + bytes(tail[: 135 - t + m]))
        strings = Counter((g, t - i, r[i : i + 200]) for g, t, m, r in zip(word, before, more, raw, strict=True) for i in range(m + 1))
        want = []
        for g, t, m, r in zip(word, before, more, raw, strict=True):
            hits = [i for i in range(m + 1) if strings[g, t - i, r[i : i + 200]] > 1]
            want.append((min(hits, default=-1), max(hits, default=-1)))
        first, last = suffix_dedup.rim_order(np.array(word), np.array(before), np.array(more), raw)
        assert list(zip(first.tolist(), last.tolist(), strict=True)) == want
        repeats += sum(b >= 0 for _, b in want)
    assert repeats > 100


def test_many_texts_of_one_id_and_any_columns(spark):
    rng = random.Random(17)
    shared = prose(rng, 60)
    texts = [f"{k} " + (shared if k % 3 == 0 else prose(rng, 60)) for k in range(300)]
    docs = frame(spark, texts, [4] * len(texts)).withColumn("a.b", F.lit(1)).withColumn("c d", F.struct(F.lit(2).alias("e-f")))
    got = Counter(tuple(r) for r in suffix_dedup.dedup_digests(docs).collect())
    assert got == Counter((4, *w) for w in wanted(texts))
    out, first = suffix_dedup.dedup_texts(docs), simhash.first_of_each(docs)
    assert out.columns == docs.columns == first.columns and out.count() == len(texts) and 1 <= first.count() <= len(texts)


def test_repeated_rows_and_null_ids(spark):
    rng = random.Random(9)
    one, two, three = (prose(rng, 80) for _ in range(3))
    texts, ids = [one, one, two, three, None, None, three + "x"], [1, 1, None, None, None, 2, 1]
    got = Counter(tuple(r) for r in suffix_dedup.dedup_digests(frame(spark, texts, ids)).collect())
    assert got == Counter((i, *w) for i, w in zip(ids, wanted(texts), strict=True))
    assert suffix_dedup.dedup_digests(frame(spark, ["a"]).limit(0)).count() == 0


def shuffled_files(spark):
    """Names of the shuffle files on this machine's disk."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for name in (files.apply(i).getName() for i in range(files.size())) if name.startswith("shuffle_")}


def none_left(spark, before):
    """Whether all shuffle files but those of before are gone within a few seconds."""
    for _ in range(50):
        if not (left := shuffled_files(spark) - before):
            return True
        time.sleep(0.1)
    return not left


def test_finished_shuffles_leave_no_files(spark):
    """The shuffles of a written table are gone while its frame is still held, those of op6's tables before its result is
    read; the result is the same, and the session's setting as it was."""
    setting, before = spark.conf.get(common._FILES_GO, None), shuffled_files(spark)
    held = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    table, _ = common.written(spark, held, "held")
    assert none_left(spark, before)
    assert sorted(map(tuple, table.collect())) == sorted(map(tuple, held.collect()))
    texts, before = repetitive(), shuffled_files(spark)
    out = suffix_dedup.dedup_digests(frame(spark, texts))
    assert none_left(spark, before)
    assert {r.doc_id: tuple(r)[1:] for r in out.collect()} == dict(enumerate(wanted(texts)))
    assert spark.conf.get(common._FILES_GO, None) == setting


def test_texts_lose_the_same_bytes(spark, clashing):
    texts = repetitive()
    docs = clashing(frame(spark, texts))
    out = suffix_dedup.dedup_texts(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    for i, (raw, cover) in enumerate(zip(*removed_spans(texts), strict=True)):
        left = np.frombuffer(raw, np.uint8)[~cover].tobytes().decode("utf-8", "ignore")
        assert got[i] == (left, len(left))


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=400), st.integers(2, 60))
def test_phrases_partition_the_starts(raw, depth):
    depth += suffix_dedup.TRIGGER
    span = max(1, depth - suffix_dedup.TRIGGER - 1)
    first, more, trigger = suffix_dedup.phrases(np.frombuffer(raw, np.uint8), depth, span)
    starts = [s for a, m in zip(first.tolist(), more.tolist(), strict=True) for s in range(a, a + m + 1)]
    assert starts == list(range(max(0, len(raw) - depth + 1)))
    assert all(a + m <= t < a + span for a, m, t in zip(first.tolist(), more.tolist(), trigger.tolist(), strict=True))
    assert len(set(trigger.tolist())) == len(trigger)


def naive_fingerprint(text):
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", lowered) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def naive_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprints(odd):
    for r in odd.collect():
        assert simhash.fingerprint(r.text or "") == naive_fingerprint(r.text), repr((r.text or "")[:60])


def test_near_duplicates(spark, clashing):
    rng = random.Random(4)
    base = prose(rng, 900)
    texts = [None, "", "  ", "One two", "one TWO", *(prose(rng, 40) for _ in range(60))]
    chain = base.split(" ")
    for k in range(60):  # a chain of small edits: links reach far
        chain[(k * 37) % len(chain)] = f"edit{k}"
        texts.append(" ".join(chain))
    texts += [base] * 30
    order = list(range(len(texts)))
    rng.shuffle(order)
    texts = [texts[i] for i in order]
    fps = [naive_fingerprint(t) for t in texts]
    want = {i: (f"{f:016x}", c) for i, (f, c) in enumerate(zip(fps, naive_components(fps), strict=True))}
    docs = clashing(frame(spark, texts))
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()} == want
    kept = simhash.first_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in want.values()})
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.first_of_each(docs.limit(0)).count() == 0


def test_near_duplicates_of_null_and_repeated_ids(spark):
    docs = frame(spark, ["a b c d", "a b c d", "a b c d", "x y z w", None], [None, 5, 5, None, 9])
    got = Counter((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == Counter({(None, 5): 1, (5, 5): 2, (None, None): 1, (9, 9): 1})
    assert Counter(r.doc_id for r in simhash.first_of_each(docs).collect()) == Counter({5: 1, None: 1, 9: 1})


def test_shard_links_find_all_near_pairs():
    """Random, clustered and dense fingerprints: the forest connects exactly what brute force does."""
    rng = np.random.default_rng(6)
    centre = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (40, 30), dtype=np.uint64)
    clustered = np.unique((centre[:, None] ^ flips).ravel())
    dense = np.unique(np.array([sum(1 << int(b) for b in rng.choice(20, 6, replace=False)) for _ in range(800)], np.uint64))
    for fps in (clustered, dense, rng.integers(0, 1 << 63, 500, dtype=np.uint64)):
        tree = simhash.top_tree(rng.permutation(fps)[:200], 6)
        idx, shard, home = simhash.routed(fps, tree, 2)
        assert sorted(idx[home].tolist()) == list(range(len(fps)))
        links = []
        for s in np.unique(shard):
            own = shard == s
            a, b = simhash.shard_links(fps[idx[own & home]], fps[idx[own & ~home]])
            links += zip(a.tolist(), b.tolist(), strict=True)
        assert all((a ^ b).bit_count() <= 2 or _joined(fps, a, b) for a, b in links)
        assert _groups(fps.tolist(), links) == _groups(fps.tolist(), [(x, y) for i, x in enumerate(fps.tolist()) for y in fps.tolist()[:i] if (x ^ y).bit_count() <= 2])


def _joined(fps, a, b):
    return {a, b} <= set(fps.tolist())


def _groups(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    out = defaultdict(set)
    for n in nodes:
        out[find(n)].add(n)
    return sorted(map(sorted, out.values()))
