"""Licenses, fingerprints, benchmark leaks, quality and toxicity."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lexspan.llm import decontamination, fingerprints, license_scan, quality, toxicity
from tests.conftest import DATA, assert_same
from tests.llm.conftest import SCHEMA, prose


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA).repartition(2)


# licenses


def naive_license(text):
    """Base places by walking over the words; method labels by counting a template's grams on near diagonals."""
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at, base = [], set()
    for label, phrase in license_scan.BASE:
        p = phrase.split(" ")
        found = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        at += found
        base |= {label} if found else set()
    labels, score = set(base), 1.0 if base else 0.0
    for label, phrase in license_scan.TEMPLATES:
        p = phrase.split(" ")
        grams = len(p) - 2
        hits = sorted({(i - j, j) for i in range(len(w) - 2) for j in range(grams) if w[i : i + 3] == p[j : j + 3]})
        runs = []
        for d, j in hits:
            if not runs or d - runs[-1][-1][0] > license_scan.SHIFT:
                runs.append([])
            runs[-1].append((d, j))
        for run in runs:
            cover = len({j for _, j in run}) / grams
            ends = [d + j for d, j in run]
            if cover >= license_scan.COVERAGE and max(ends) + 2 - min(ends) + 1 <= license_scan.STRETCH * len(p):
                labels.add(label)
                score = max(score, cover)
    return (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), round(score, 9))


def license_texts():
    rng = random.Random(8)
    t = [x for _, x in license_scan.TEMPLATES]
    cut = t[1].split(" ")
    out = [None, "", "...", "under the MIT license", "Under the mit\nLICENSE. under, the mit license", "Apache License, Version 2", "CC-BY-NC cc by nc", "cc by", "under the mit"]
    out += t + [prose(rng, 40) + " " + x + " " + prose(rng, 9) for x in t]
    out += [" ".join(cut[:10] + ["extra", "words"] + cut[10:30] + cut[33:]), " ".join(cut[:12]), " ".join(cut + cut), " ".join(w if rng.random() > 0.1 else "odd" for w in cut), "Ünder the MIT licenseé under the MIT license", t[6].replace("work", "wor\u212a"), t[6].replace("this", "th\u0130s").upper()]
    return out


def test_licenses(spark, odd, clashing):
    docs = clashing(frame(spark, license_texts()))
    got = {r.doc_id: (*tuple(r)[1:-1], round(r.score, 9)) for r in license_scan.license_scan(docs).collect()}
    assert got == {i: naive_license(t) for i, t in enumerate(license_texts())}
    want = Counter((r.doc_id, *naive_license(r.text)) for r in odd.collect())
    assert Counter((*tuple(r)[:-1], round(r.score, 9)) for r in license_scan.license_scan(odd).collect()) == want
    assert license_scan.license_scan(odd.limit(0)).count() == 0


def test_licenses_sql(spark, documents):
    assert_same(license_scan.license_scan(documents), license_scan.oracle(), DATA)


# fingerprints


def edited(texts):
    return [t[: len(t) - len(t) // 4] + texts[(i + 1) % len(texts)][: len(t) // 4] for i, t in enumerate(texts)]


def test_fingerprints(spark, documents, clashing):
    from tests.llm.conftest import odd_texts

    texts = [t or "" for t in odd_texts()] + [r.text for r in documents.orderBy("doc_id").limit(60).collect()]
    got = {r.doc_id: r for r in fingerprints.fingerprint_edits(clashing(frame(spark, texts))).collect()}
    assert len(got) == len(texts)
    for i, (t, e) in enumerate(zip(texts, edited(texts), strict=True)):
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and (r.fingerprint == "") == (t == "")
        if t == e:
            assert r.fingerprint == r.edited_fingerprint and r.near_edited == 1
        if t == texts[(i + 1) % len(texts)]:
            assert r.near_next == 1
    whole = [i for i, t in enumerate(texts) if len(t) > 400 and t != texts[(i + 1) % len(texts)]]
    assert np.mean([got[i].near_edited for i in whole]) > np.mean([got[i].near_next for i in whole]) + 0.3


def test_fingerprints_of_odd_rows(odd, spark):
    assert fingerprints.fingerprint_edits(odd).count() == odd.count()
    assert fingerprints.fingerprint_edits(odd.limit(0)).count() == 0
    (alone,) = fingerprints.fingerprint_edits(frame(spark, ["one two three four"])).collect()
    assert alone.near_next == 1.0
    nulls = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f g"), (None, None)], "doc_id long, text string")
    assert fingerprints.fingerprint_edits(nulls).count() == 3


def naive_sketch(text):
    """Closed syncmers of the text's pieces, chained XXH64 with seed 42 as Spark's hash of several columns."""

    def chained(*values):
        h = 42
        for v in values:
            h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v.to_bytes(8, "little"), seed=h)
        return h

    def signed(x):
        return x - (x >> 63 << 64)

    if not text:
        return []
    units = [chained(w[i : i + 3]) for w in re.findall(r"[^ \t\n\r]+", text) for i in range(0, len(w), 3)]
    inner = [chained(a, b) for a, b in zip(units, units[1:], strict=False)]
    found = set()
    for i in range(len(units) - 4):
        four = [signed(x) for x in inner[i : i + 4]]
        if min(four) in (four[0], four[3]):
            found.add(chained(inner[i], inner[i + 2], units[i + 4]))
    return sorted({x >> 24 for x in found or units or [chained(text)]})[:64]


def naive_likeness(a, b):
    union = sorted({*a, *b})[:64]
    return 1.0 if not union else len([x for x in union if x in a and x in b]) / len(union)


def test_fingerprints_by_brute_force(spark, documents):
    from tests.llm.conftest import odd_texts

    texts = [t or "" for t in odd_texts()] + [r.text for r in documents.collect()]
    got = {r.doc_id: r for r in fingerprints.fingerprint_edits(frame(spark, texts)).collect()}
    for i, (t, e) in enumerate(zip(texts, edited(texts), strict=True)):
        own, other, after = naive_sketch(t), naive_sketch(e), naive_sketch(texts[(i + 1) % len(texts)])
        assert got[i].fingerprint == "".join(f"{x:010x}" for x in own) and got[i].edited_fingerprint == "".join(f"{x:010x}" for x in other)
        assert (got[i].near_edited, got[i].near_next) == (naive_likeness(own, other), naive_likeness(own, after))


def test_fingerprints_move_smoothly_with_length(spark):
    """A small edit weighs alike at every length: no switch of units."""
    rng = random.Random(4)
    text = prose(rng, 300)
    for n in range(40, 900, 20):
        assert naive_likeness(naive_sketch(text[:n]), naive_sketch(text[: n + 8])) >= 0.7 - (n < 100) * 0.3


def test_ranges_split_one_doc_id(spark):
    """Rows of one id, of no id and of text ids are dealt over many ranges, and still meet their next row."""
    rng = random.Random(3)
    texts = [prose(rng, 12) for _ in range(300)]
    for doc_id in (7, None, "x"):
        kind = "string" if doc_id == "x" else "long"
        docs = spark.createDataFrame([(doc_id, t) for t in texts], f"doc_id {kind}, text string").repartition(4)
        rows = docs.withColumn("tie", F.xxhash64("text"))
        assert rows.select(fingerprints._range(rows).alias("range")).distinct().count() > 8
        order = [r.text for r in rows.orderBy("tie").collect()]
        want = sorted(hashlib.sha256(e.encode()).hexdigest() for e in edited(order))
        assert sorted(r.edited_sha256 for r in fingerprints.fingerprint_edits(docs).collect()) == want


def test_anchors_are_context_free(spark):
    rng = random.Random(12)
    passage, lead = prose(rng, 80), prose(rng, 17)
    a, b = (sorted((r.position, r.hash) for r in fingerprints.anchors(frame(spark, [t])).collect()) for t in (passage, lead + " " + passage + " " + prose(rng, 5)))
    pieces = len(re.findall(r"\S{1,3}", lead))
    inside = {(p - pieces, h) for p, h in b}
    assert a and all(x in inside for x in a)
    assert 0.3 < len(a) / len(re.findall(r"\S{1,3}", passage)) < 0.7  # two of four inner places choose a k-mer


# leaks


def naive_leaks(text, items):
    found = decontamination.words(text or "")
    out = {}
    for item_id, item in items:
        w = decontamination.shingles(want := decontamination.words(item or ""))
        if not w:
            continue
        best = max((decontamination.weighted_jaccard(decontamination.shingles(found[s : s + len(want)]), w) for s in range(max(1, len(found) - len(want) + 1))), default=0)
        if best >= decontamination.SIMILARITY:
            out[item_id] = round(best, 9)
    return out


def leak_tables(spark):
    rng = random.Random(21)
    items = [(i, prose(rng, rng.choice([3, 8, 20, 40, 60]))) for i in range(25)] + [(25, None), (26, ""), (27, "?!"), (None, prose(rng, 30)), (28, "one two"), (29, "same same same same same same same same")]
    texts = [None, "", "one two", "ONE, TWO! three", "same " * 30]
    for _, item in items[:25]:
        w = item.split(" ")
        texts += [prose(rng, 50) + " " + item.upper() + " " + prose(rng, 50), " ".join(w[: len(w) // 2]) + " " + prose(rng, 30), item]
        k = rng.randrange(len(w))
        texts.append(prose(rng, 20) + " " + " ".join([*w[:k], "changed", *w[k + 1 :]]) + " " + prose(rng, 20))
    texts.append(prose(rng, 30) + " " + items[28][1])
    return frame(spark, texts), spark.createDataFrame(items, "item_id long, text string"), texts, items


@pytest.mark.parametrize("block", [decontamination.ITEMS_BYTES, 200])
def test_leaks(spark, clashing, monkeypatch, block):
    """With all items in one block, and in many."""
    monkeypatch.setattr(decontamination, "ITEMS_BYTES", block)
    docs, items, texts, rows = leak_tables(spark)
    want = {(i, k, v) for i, t in enumerate(texts) for k, v in naive_leaks(t, rows).items()}
    got = {(r.doc_id, r.item_id, round(r.similarity, 9)) for r in decontamination.leaks(clashing(docs), items).collect()}
    assert got == want
    kept = decontamination.clean(clashing(docs), items)
    assert {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {i for i, _, _ in want} and kept.columns == clashing(docs).columns
    named = docs.select(F.col("doc_id").cast("decimal(20,0)").alias("doc_id"), "text", F.lit(1).alias("a.b"), F.struct(F.lit(2).alias("c d")).alias("e-f"))
    assert decontamination.clean(named, items).columns == named.columns and decontamination.clean(named, items).count() == kept.count()
    assert decontamination.leaks(named, items).count() == len(want)
    assert decontamination.leaks(docs.limit(0), items).count() == 0 and decontamination.leaks(docs, items.limit(0)).count() == 0


def test_index_finds_all_near_codes():
    rng = random.Random(2)
    index = decontamination.Index([(i, prose(rng, 30)) for i in range(30)])
    for n, (_, _, code) in enumerate(index.items):
        for k in (0, 1, 7, decontamination.RADIUS):
            off = sum(1 << b for b in rng.sample(range(64), k))
            assert n in index.near(code ^ off, 30) and n not in index.near(code ^ off, 31)
        assert n not in index.near(code ^ (1 << decontamination.RADIUS + 1) - 1, 30)


def test_only_the_blocks_propose():
    rng = random.Random(6)
    item = prose(rng, 30)
    index = decontamination.Index([(0, item)])
    text = prose(rng, 50) + " " + item + " " + prose(rng, 50)
    assert [m[0] for m in index.matches(text)] == [0]
    for table in index.blocks:
        table.clear()
    assert index.matches(text) == []


def test_the_radius_loses_hardly_any_window():
    """Recall of the fingerprints against all windows of similarity 0.8, with edits of every size and short items."""
    rng, true, found = random.Random(9), 0, 0
    for k in range(400):
        item = prose(rng, 8 + k % 50)
        w = item.split(" ")
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = "changed"
        text = prose(rng, 20) + " " + " ".join(w) + " " + prose(rng, 20)
        true += len(naive_leaks(text, [(0, item)]))
        found += len(decontamination.Index([(0, item)]).matches(text))
    assert true > 150 and found >= 0.99 * true


# quality


def quality_tables(spark):
    rng = random.Random(31)
    good, bad = prose(rng, 6_000, 200).split(" "), prose(rng, 6_000, 200).split(" ")
    texts = [" ".join(rng.choices(good if i % 4 else bad, k=80)) + ("!!" * 40 if i % 4 == 0 else ".") for i in range(400)]
    labels = [(i, int(i % 4 > 0), 0) for i in range(0, 400, 2)] + [(None, 1, 0), (3, None, None)]
    return frame(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_keeps_good_text(spark, clashing):
    docs, labels = quality_tables(spark)
    kept = {r.doc_id for r in quality.selection(clashing(docs), labels).collect()}
    good = {i for i in range(400) if i % 4}
    assert len(kept & good) > 0.97 * len(good) and len(kept - good) < 0.1 * (400 - len(good))
    named = docs.withColumn("a.b", F.lit(1)).withColumn("c d", F.struct(F.lit(2).alias("e-f")))
    assert quality.resampled(named, labels).columns == named.columns and quality.resampled(named, labels).count() == len(kept)
    out = quality.resampled(clashing(docs), labels)
    assert out.columns == clashing(docs).columns and {r.doc_id for r in out.collect()} == kept


def test_quality_by_brute_force(spark):
    """Counts, weights and the k largest keys, all anew in plain Python."""
    docs, labels = quality_tables(spark)
    rows = docs.withColumn("u", (F.shiftrightunsigned(F.xxhash64(F.lit(quality.SEED), "doc_id", "text"), 11) + 0.5) / float(1 << 53)).collect()
    target = {r.doc_id for r in labels.collect() if r.quality == 1 and r.doc_id is not None}
    grams = {r.doc_id: Counter(quality.features(r.text).tolist()) for r in rows}
    raw, aim = Counter(), Counter()
    for i, g in grams.items():
        raw += g
        if i in target:
            aim += g
    ratio = lambda b: math.log((aim[b] + quality.PRIOR) / (aim.total() * raw[b] / raw.total() + quality.PRIOR))
    weight = {i: sum(n * ratio(b) for b, n in g.items()) * quality.LENGTH / max(g.total(), quality.LENGTH) for i, g in grams.items()}
    k = math.ceil(sum(min(1.0, math.exp(w + quality.SLACK)) if w < 50 else 1.0 for w in weight.values()) - 1e-6)
    key = {r.doc_id: weight[r.doc_id] - math.log(-math.log(r.u)) for r in rows}
    want = set(sorted(key, key=key.get, reverse=True)[:k])
    assert {r.doc_id for r in quality.selection(docs, labels).collect()} == want
    best = sorted(key, key=key.get, reverse=True)
    for k in (0, 7, 390, 1_000):
        assert {r.doc_id for r in quality.selection(docs, labels, k).collect()} == set(best[:k])


def test_quality_of_odd_rows(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.selection(odd, none).count() == odd.count()
    labels = spark.createDataFrame([(18, 1, 0), (19, 1, 0), (0, 1, 0)], "doc_id long, quality int, toxic int")
    assert 0 < quality.selection(odd, labels).count() <= odd.count()
    assert quality.selection(odd.limit(0), labels).count() == 0 and quality.resampled(odd.limit(0), labels).count() == 0


def test_kth_largest(spark):
    values = [5, -3, 2**62, -(2**62), 0, 5, 5, 70_000, -70_000, -1]
    ranks = spark.createDataFrame([(v,) for v in values], "rank long")
    for k in range(1, len(values) + 1):
        assert quality.kth_largest(ranks, k) == sorted(values, reverse=True)[k - 1]


# toxicity


def test_held_out(spark):
    ids = [*range(200), None]
    frame_ = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    got = {r.doc_id: r.h for r in frame_.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h")).collect()}
    assert all(got[i] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(200))


def test_noisy_or_steps_move_the_blame():
    """A word that goes along with toxic sentences, elsewhere in the text: document log-odds blame it, the noisy-or much less."""
    rng = random.Random(44)
    texts, toxic = [], []
    for i in range(600):
        said = [prose(rng, 8) for _ in range(4)]
        bad = i % 3 == 0
        if bad:
            said[0] = f"you {rng.choice(['vilezor', 'snarvex'])} {prose(rng, 3)}"
        if rng.random() < (0.9 if bad else 0.15):
            said[2] += " harbour"
        texts.append(". ".join(said) + ".")
        toxic.append(int(bad))
    flagged = {}
    for rounds in (0, 150):
        score = toxicity.Scorer(toxicity.fit(texts, toxic, 1 / 3, rounds))
        flagged[rounds] = sum(score(t)[0] >= 0.5 for t, bad in zip(texts, toxic, strict=True) if not bad)
        assert all(score(t)[0] >= 0.5 for t, bad in zip(texts, toxic, strict=True) if bad) or rounds == 0
    assert flagged[150] < flagged[0] / 4, flagged


def toxic_tables(spark):
    rng = random.Random(41)
    lexicon = ["vilezor", "grumplak", "snarvex", "blorpid"]
    texts, toxic = [], []
    for i in range(600):
        sentences = [prose(rng, 9).capitalize() + "." for _ in range(6)]
        bad = i % 3 == 0
        if bad:
            sentences[3] = f"You {rng.choice(lexicon)} and {rng.choice(lexicon).upper()}, {prose(rng, 4)}."
        texts.append(" ".join(sentences))
        toxic.append(int(bad))
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], "doc_id long, quality int, toxic int")
    return frame(spark, texts), labels, texts, toxic


def test_toxic_documents_and_their_sentences(spark, clashing):
    docs, labels, texts, toxic = toxic_tables(spark)
    rows = toxicity.toxicity(clashing(docs), labels).collect()
    assert len(rows) == 600
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        if r.held_out:
            assert r.predicted == toxic[r.doc_id], texts[r.doc_id]
        if toxic[r.doc_id] and r.predicted:
            assert "You " in texts[r.doc_id][r.worst_begin : r.worst_end]


def test_held_out_labels_are_never_read(spark):
    docs, labels, _, _ = toxic_tables(spark)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted((r.doc_id, r.score) for r in toxicity.toxicity(docs, x).collect()) for x in (labels, flipped))
    assert a == b


def test_toxicity_of_odd_rows(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.score == pytest.approx(0.0, abs=1e-9) and r.predicted == 0 for r in toxicity.toxicity(odd, none).collect())
    _, labels, _, _ = toxic_tables(spark)
    rows = toxicity.toxicity(odd, labels.union(spark.createDataFrame([(None, 1, 1), (1, None, None)], labels.schema))).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.toxicity(odd.limit(0), labels).count() == 0


def test_noisy_or_is_the_product():
    score = toxicity.Scorer({"features": {"bad": 9.0}, "bias": -5.0})
    p = lambda z: 1 / (1 + math.exp(-z))
    assert score("bad one. good two! Bad")[0] == pytest.approx(1 - (1 - p(4)) * (1 - p(-5)) * (1 - p(4)))
    assert score("")[0] == pytest.approx(p(-5)) and score("fine. bad one.")[2:4] == (5, 14)
