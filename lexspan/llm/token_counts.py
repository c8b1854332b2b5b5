"""Token counts by a map-side two-tier lookup.

Tier one is a compact hash table of the corpus' frequent pieces and their numbers of tokens, broadcast to all workers;
tier two is each worker's own bounded cache, filled by encoding what tier one misses. No piece is ever shuffled: the
frequent pieces are found by fixed-size summaries (Misra-Gries counters, one a partition, over every document) that are
merged in a tree. The tables only decide who answers, never the answer.

Defined cases: a null or empty text has 0 bytes and 0 tokens; every input row gives one row, repeated rows and null ids
included; special tokens' strings in a text count as the library counts them (one token); an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter as Tally
from pickle import dumps, loads

import pyarrow as pa
from pyspark.sql import DataFrame

from . import bytebpe
from .common import known_to_workers, one_a_worker, released, text_of

KEPT = 1 << 16
LIMIT = 1024


def _trimmed(tally: Tally, most: int) -> Tally:
    """Misra-Gries: the `most` largest counters, less the largest count that is given up."""
    if len(tally) <= most:
        return tally
    top = tally.most_common(most + 1)
    off = top[-1][1]
    return Tally({k: v - off for k, v in top[:-1] if v > off})


def _summaries(batches, most: int = KEPT):
    tally: Tally = Tally()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text:
                tally.update(text.split(" "))
                if len(tally) > 8 * most:
                    tally = _trimmed(tally, most)
    small = {k: v for k, v in _trimmed(tally, most // 2).items() if v > 1 and len(k) <= bytebpe.LONGEST_KEPT}
    yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(dumps(small), 1)], pa.binary())], names=["summary"])


def _merged(a: bytes, b: bytes) -> bytes:
    tally = Tally(loads(zlib.decompress(a)))
    tally.update(loads(zlib.decompress(b)))
    return zlib.compress(dumps(dict(_trimmed(tally, KEPT))), 1)


def frequent_lengths(docs: DataFrame, tokenizer: str) -> dict[str, int]:
    """piece -> number of tokens of " " + piece, for at most KEPT pieces that are frequent in all of docs."""
    texts = docs.select(text_of(docs).alias("text")).mapInArrow(_summaries, "summary binary")
    empty = zlib.compress(dumps({}), 1)
    found = loads(zlib.decompress(texts.rdd.map(lambda r: bytes(r[0])).treeAggregate(empty, _merged, _merged)))
    tok = bytebpe.load(tokenizer)
    pieces = [p for p in found if bytebpe.safe(p)]
    ids = tok.encode_batch([" " + p for p in pieces], add_special_tokens=False)
    return {p: len(e.ids) for p, e in zip(pieces, ids, strict=True)}


@one_a_worker
def _counter(path: str, frequent) -> bytebpe.Counter:
    """One a worker and broadcast: a worker's cache outlives its tasks."""
    return bytebpe.Counter(path, frequent.value)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of docs(doc_id, text)."""
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, tokenizer))
    released(docs.sparkSession, frequent)

    def counted(batches):
        count = _counter(tokenizer, frequent)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            n = pa.array(map(count, texts), pa.int64())
            size = pa.array([len(t.encode()) for t in texts], pa.int64())
            over = pa.array([x > limit for x in n.to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, n, over], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select("doc_id", text_of(docs).alias("text"))
    return rows.mapInArrow(counted, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
