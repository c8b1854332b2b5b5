"""Quality by importance resampling: documents are weighed by two generative models and sampled by Gumbel top-k.

Both models are bags of hashed n-grams: one- and two-token features in BUCKETS buckets. The raw model counts all
documents; the target model is smoothed towards it by PRIOR counts a bucket, so that a bucket of little evidence says
little. The target model counts a bounded sample of labelled documents of quality 1 (at most TARGET, those
of the smallest hash of doc_id). A document's log weight is the sum over its features of log p_target - log p_raw, of a
text of more than LENGTH features scaled to LENGTH of them, so that length alone neither condemns nor saves a text. Its
key is the log weight plus Gumbel noise (fixed by seed, doc_id and text), and the k largest keys are a sample without
replacement in proportion to the weights.

k may be given. Otherwise it is the expected number of documents that a rejection test would keep: the sum of
min(1, weight * e**SLACK). So a text goes if it is e**SLACK times likelier as raw text than as target text, give or take
the noise.

The k-th largest key is found by counting 16 bits of it at a time over all rows (65,536 counts a round).

Defined cases: null and empty texts have log weight 0; rows equal in doc_id and text have one key and stand or fall
together, so that k may be exceeded by such rows; without target rows all weights are 1 and everything is kept; null
labels and null doc_ids of labels are ignored; an empty table gives no rows; other columns of documents are carried by
resampled() and ignored by selection().
"""

from __future__ import annotations

import math
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_parts, known_to_workers, one_a_worker, own_columns, released, schema_of, text_of, written

BUCKETS = 1 << 16
TARGET = 20_000
LENGTH = 400
SLACK = 6.0
PRIOR = 50.0
SEED = 17
CACHE = 300_000
_TOKEN = re.compile(r"\w+|[^\w\s]+")


class _Hashes(dict):
    """token -> its 32-bit hash; a bounded cache."""

    def __missing__(self, token: str) -> int:
        h = zlib.crc32(token.encode("utf-8", "surrogatepass"))
        if len(self) < CACHE and len(token) < 64:
            self[token] = h
        return h


@one_a_worker
def _hashes() -> _Hashes:
    return _Hashes()


def features(text: str):
    """Buckets of the text's tokens and of its pairs of neighbouring tokens."""
    import numpy as np

    found = _TOKEN.findall(text)
    one = np.fromiter(map(_hashes().__getitem__, found), np.uint64, len(found))
    two = one[:-1] * np.uint64(0x9E3779B1) + one[1:] * np.uint64(0x85EBCA77) ^ np.uint64(0x5BD1E995)
    mixed = np.concatenate((one * np.uint64(0x9E3779B97F4A7C15), two * np.uint64(0xBF58476D1CE4E5B9)))
    return (mixed >> np.uint64(48)).astype(np.int64)


def _added(a: bytes, b: bytes) -> bytes:
    import numpy as np

    if not a or not b:
        return a or b
    return (np.frombuffer(a, np.int64) + np.frombuffer(b, np.int64)).tobytes()


def models(docs: DataFrame, labels: DataFrame):
    """log p_target - log p_raw of every bucket, as an array; None without target documents.

    One pass over docs; a partition returns one fixed-size row of counts, and the rows are added up in a tree.
    """
    import numpy as np

    known_to_workers(docs.sparkSession)
    picked = labels.filter("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(TARGET)
    picked = picked.withColumn("target", F.lit(True))
    rows = docs.select("doc_id", text_of(docs).alias("text")).join(F.broadcast(picked), "doc_id", "left").select("text", F.col("target").isNotNull().alias("target"))

    def counted(batches):
        counts = np.zeros((2, BUCKETS), np.int64)
        for batch in in_parts(batches):
            for text, target in zip(batch.column("text").to_pylist(), batch.column("target").to_pylist(), strict=True):
                f = np.bincount(features(text), minlength=BUCKETS)
                counts[0] += f
                if target:
                    counts[1] += f
        yield pa.RecordBatch.from_arrays([pa.array([counts.tobytes()], pa.binary())], names=["counts"])

    total = rows.mapInArrow(counted, "counts binary").rdd.map(lambda r: bytes(r[0])).treeAggregate(b"", _added, _added)
    raw, target = np.frombuffer(total, np.int64).reshape(2, BUCKETS) if total else np.zeros((2, BUCKETS), np.int64)
    if not target.any():
        return None
    expected = target.sum() * (raw / raw.sum())
    return np.log((target + PRIOR) / (expected + PRIOR))


def weighed(docs: DataFrame, ratio) -> DataFrame:
    """row (a struct of docs' columns), log_weight, n_features, score (log weight plus noise) and rank (a long in the order of score)."""
    ratios = docs.sparkSession.sparkContext.broadcast(ratio)
    released(docs.sparkSession, ratios)
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(SEED), docs["doc_id"], text_of(docs)), 11) + 0.5) / float(1 << 53)
    rows = docs.select(F.struct(*own_columns(docs)).alias("row"), text_of(docs).alias("text"), (-F.log(-F.log(uniform))).alias("noise"))

    def weigh(batches):
        import numpy as np

        for batch in in_parts(batches):
            w, n = [], []
            for text in batch.column("text").to_pylist():
                f = features(text)
                n.append(len(f))
                w.append(float(ratios.value[f].sum()) * LENGTH / max(len(f), LENGTH) if ratios.value is not None and len(f) else 0.0)
            w = np.array(w, np.float64)
            score = w + batch.column("noise").to_numpy(zero_copy_only=False)
            bits = score.view(np.int64)
            rank = np.where(bits < 0, np.int64(-(2**63)) - bits - 1, bits)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(w), pa.array(n, pa.int64()), pa.array(score), pa.array(rank)], names=["row", "log_weight", "n_features", "score", "rank"])

    return rows.mapInArrow(weigh, schema_of(row=rows.schema["row"].dataType, log_weight="double", n_features="long", score="double", rank="long"))


def kth_largest(ranks: DataFrame, k: int) -> int:
    """The k-th largest value of ranks(rank long), k at least 1 and at most the number of rows."""
    prefix = None
    for shift in (48, 32, 16, 0):
        rows = ranks if prefix is None else ranks.filter(F.shiftright("rank", shift + 16) == prefix)
        digits = {r["digit"]: r["count"] for r in rows.groupBy(F.shiftright("rank", shift).alias("digit")).count().collect()}
        for digit in sorted(digits, reverse=True):
            if k <= digits[digit]:
                prefix = digit
                break
            k -= digits[digit]
    return prefix


def _weights(docs: DataFrame, labels: DataFrame, k: int | None):
    """All rows' weights (a small written table), the ratios and the least rank to keep."""
    ratio = models(docs, labels)
    table, _ = written(docs.sparkSession, weighed(docs.select("doc_id", "text"), ratio).select("row.doc_id", "log_weight", "n_features", "score", "rank"), "weights")
    kept = table.agg(F.sum(F.exp(F.least(F.col("log_weight") + SLACK, F.lit(0.0)))).alias("k"), F.count("*").alias("n")).first()
    k = min(kept["n"], math.ceil((kept["k"] or 0.0) - 1e-6) if k is None else k)
    return table, ratio, kth_largest(table, k) if k else None


def selection(docs: DataFrame, labels: DataFrame, k: int | None = None) -> DataFrame:
    """doc_id, log_weight, n_features, score of the sampled rows of docs(doc_id, text)."""
    table, _, least = _weights(docs, labels, k)
    return table.filter(F.lit(False) if least is None else F.col("rank") >= least).select("doc_id", "log_weight", "n_features", "score")


def resampled(docs: DataFrame, labels: DataFrame, k: int | None = None) -> DataFrame:
    """The sampled rows of docs, all columns as they are."""
    _, ratio, least = _weights(docs, labels, k)
    return weighed(docs, ratio).filter(F.lit(False) if least is None else F.col("rank") >= least).select("row.*")
