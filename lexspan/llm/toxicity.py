"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled, a noisy-or joins them.

A document is toxic unless none of its sentences is: score = 1 - prod(1 - p(sentence)), p a logistic model over the
sentence's words and their beginnings. The weights are learned from document labels alone, by gradient steps on the
likelihood of the noisy-or, so the blame goes to the sentences that explain the label; the same weights then locate them
in any text. Only features that a label's documents hold far more often than chance has it get a weight. The steps start
from each feature's own log-odds and are held near them: a word that only toxic documents hold keeps its weight even if
other words of those documents would explain the labels too.

The model is fitted on a bounded sample: at most SAMPLE labelled documents of each label, those of the smallest hash of
doc_id, and at most SAMPLE_BYTES of their texts, only from rows with crc32(doc_id as text) mod 5 other than 0; each label is weighted back to its share among all
labelled rows. Its inputs are words of the text only.

Defined cases: null and empty texts, and texts without words, score the model's value of one empty sentence; labels of
null or repeated doc_ids: null ones are ignored, of repeated ones the largest counts; without labels of both kinds, all
scores are the share of toxic rows (0.0 without labels); every input row gives one row; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, known_to_workers, one_a_worker, released, text_of, written

SAMPLE = 3_000
SAMPLE_BYTES = 64 << 20
VOCABULARY = 20_000
LEAST_DOCUMENTS = 4
Z = 5.0
RIDGE = 1e-2
START_BIAS = -8.0
CACHE = 400_000
FOLDS = 5
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*|[.!?]+")


def held_out(doc_id: Column) -> Column:
    """True of the rows that no model sees the labels of; null doc_ids count as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of the sentences: up to full stops, question or exclamation marks and line ends."""
    return [m.span() for m in _SENTENCE.finditer(text)]


def features(word: str) -> list[str]:
    """The word and its beginnings of 4 to 7 letters, so that other endings of a learned word are known too."""
    return [word, *[word[:k] + "*" for k in range(4, min(8, len(word)))]]


def chosen(texts: list[str], toxic) -> tuple[dict[str, int], list[float]]:
    """Features (numbered) that stand in documents of one label far more often than chance has it (|z| of at least Z), and
    the weight each starts from: its documents' log-odds over START_BIAS, shared out among the features of a word."""
    seen: Counter = Counter()
    hits: Counter = Counter()
    share = sum(toxic) / len(texts)
    found = [set(_WORD.findall(text.lower())) for text in texts]
    for words, label in zip(found, toxic, strict=True):
        own = {f for w in words for f in features(w)}
        seen.update(own)
        if label:
            hits.update(own)
    z = {f: (hits[f] - n * share) / math.sqrt(n * share * (1 - share)) for f, n in seen.items() if n >= LEAST_DOCUMENTS}
    best = sorted((f for f, v in z.items() if abs(v) >= Z), key=lambda f: (-abs(z[f]), f))[:VOCABULARY]
    index = {f: i for i, f in enumerate(best)}
    together: Counter = Counter()
    words_of: Counter = Counter()
    for words in found:
        for own in ([f for f in features(w) if f in index] for w in words):
            for f in own:
                together[f] += len(own)
                words_of[f] += 1
    start = []
    for f in best:
        p = (hits[f] + share) / (seen[f] + 1)
        start.append((math.log(p / (1 - p)) - START_BIAS) * words_of[f] / together[f])
    return index, start


def fit(texts: list[str], toxic: list[int], share: float, rounds: int = 150) -> dict:
    """Weights of features and the bias. share: of toxic documents where the model will be used."""
    import numpy as np

    toxic_ = np.asarray(toxic, float)
    if not len(toxic_) or toxic_.min() == toxic_.max():
        return {"features": {}, "bias": max(-30.0, min(30.0, math.log(max(share, 1e-13) / max(1 - share, 1e-13))))}
    index, start = chosen(texts, toxic)
    memo: dict[str, list[int]] = {}
    rows, cols, doc_of, n = [], [], [], 0
    for d, text in enumerate(texts):
        for a, b in sentences(text) or [(0, 0)]:
            for w in _WORD.findall(text[a:b].lower()):
                own = memo.get(w)
                if own is None:
                    own = memo[w] = [index[f] for f in features(w) if f in index]
                rows.extend([n] * len(own))
                cols.extend(own)
            doc_of.append(d)
            n += 1
    r, c, doc = np.array(rows, np.int64), np.array(cols, np.int64), np.array(doc_of)
    weight = np.where(toxic_ == 1, share / toxic_.mean(), (1 - share) / (1 - toxic_.mean()))
    weight /= weight.sum()
    first = np.array(start, float)
    w, bias = first.copy(), START_BIAS
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = np.clip(np.bincount(r, w[c], n) + bias, -30, 30)
        p = 1 / (1 + np.exp(-z))
        none = np.exp(np.bincount(doc, np.log1p(-p), len(texts)))  # P(no sentence is toxic)
        pull = np.where(toxic_ == 1, none / np.maximum(1 - none, 1e-9), -1.0) * weight
        gz = pull[doc] * p  # of the log-likelihood by each sentence's z
        gw, gb = np.bincount(c, gz[r], len(w)) - RIDGE * (w - first), gz.sum()
        m, mb = 0.9 * m + 0.1 * gw, 0.9 * mb + 0.1 * gb
        v, vb = 0.99 * v + 0.01 * gw * gw, 0.99 * vb + 0.01 * gb * gb
        rate, c1, c2 = 0.1 if t < rounds // 2 else 0.025, 1 - 0.9**t, 1 - 0.99**t
        w += rate * (m / c1) / (np.sqrt(v / c2) + 1e-7)
        bias += rate * (mb / c1) / (math.sqrt(vb / c2) + 1e-7)
    return {"features": dict(zip(index, w.tolist(), strict=True)), "bias": float(bias)}


class Weights(dict):
    """word -> the sum of its features' weights; a bounded cache."""

    def __init__(self, by_feature: dict[str, float]):
        super().__init__()
        self.by_feature = by_feature

    def __missing__(self, word: str) -> float:
        value = sum([self.by_feature.get(f, 0.0) for f in features(word)])
        if len(self) < CACHE and len(word) < 64:
            self[word] = value
        return value


def fitted(docs: DataFrame, labels: DataFrame) -> dict:
    """The model, from a bounded sample of labelled rows that are not held out: SAMPLE different texts a label, SAMPLE_BYTES
    in all (whole texts; those of the smallest hashes)."""
    spark = docs.sparkSession
    known_to_workers(spark)
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {int(r["toxic"]): r["count"] for r in known.groupBy("toxic").count().collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    picked = [known.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE) for k in (0, 1)]
    sample = picked[0].union(picked[1])
    text = text_of(docs)
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("hash")).join(F.broadcast(sample), "doc_id").groupBy("hash").agg(F.max("toxic").alias("toxic"), F.first("text").alias("text"))
    rows, place = written(spark, rows, "labelled")  # a text a row: copies are one piece of evidence
    sizes = [r for k in (0, 1) for r in rows.filter(F.col("toxic") == k).select("hash", F.octet_length("text").alias("size")).orderBy("hash").limit(SAMPLE).collect()]
    held, total = [], 0
    for r in sorted(sizes, key=lambda r: r["hash"]):
        total += r["size"]
        if held and total > SAMPLE_BYTES:
            break
        held.append((r["hash"],))
    found = rows.join(F.broadcast(spark.createDataFrame(held, "hash long")), "hash").select("text", "toxic").orderBy("hash").collect()
    dropped(spark, place)
    return fit([r["text"] for r in found], [int(r["toxic"]) for r in found], share)


class Scorer:
    def __init__(self, model: dict):
        self.bias = model["bias"]
        self.weights = Weights(model["features"])

    def __call__(self, text: str) -> tuple[float, int, int, int, float]:
        """Score, number of sentences, and the worst sentence's span and score."""
        spans = sentences(text) or [(0, 0)]
        get, bias = self.weights.__getitem__, self.bias
        lower = text.lower()
        if len(lower) != len(text):  # a few letters change length; then sentence by sentence
            sums = [sum(map(get, _WORD.findall(text[a:b].lower()))) for a, b in spans]
        else:
            sums = [sum(map(get, _WORD.findall(lower, a, b))) for a, b in spans]
        clear, worst = 0.0, max(range(len(sums)), key=sums.__getitem__)
        for s in sums:
            z = min(30.0, max(-30.0, s + bias))
            clear -= z + math.log1p(math.exp(-z)) if z > 0 else math.log1p(math.exp(z))
        return 1 - math.exp(clear), len(spans), *spans[worst], 1 / (1 + math.exp(-min(30.0, max(-30.0, sums[worst] + bias))))


@one_a_worker
def _scorer(broadcast) -> Scorer:
    return Scorer(broadcast.value)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, n_sentences, worst_begin, worst_end (code points), worst_score of every row."""
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels))
    released(docs.sparkSession, model)
    rows = docs.select("doc_id", text_of(docs).alias("text"), held_out(docs["doc_id"]).alias("held_out"))

    def scored(batches):
        score = _scorer(model)
        for batch in batches:
            got = list(zip(*map(score, batch.column("text").to_pylist()), strict=True)) or [()] * 5
            p = got[0]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p, pa.float64()), pa.array([int(x >= 0.5) for x in p], pa.int32()), *(pa.array(x, pa.int32()) for x in got[1:4]), pa.array(got[4], pa.float64())], names=["doc_id", "held_out", "score", "predicted", "n_sentences", "worst_begin", "worst_end", "worst_score"])

    return rows.mapInArrow(scored, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int, n_sentences int, worst_begin int, worst_end int, worst_score double")
