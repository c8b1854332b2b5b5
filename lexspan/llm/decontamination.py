"""Benchmark decontamination by SimHash of item-sized windows.

Texts are lower-cased words; an item of n words is compared with every window of n words of a document. A window's
weighted shingles (WORDS words each, weighted by how often they stand there) are summed into a SimHash of 64 bits. The
items' fingerprints are indexed by BLOCKS blocks of bits: a fingerprint within RADIUS differs from the item's in at most
RADIUS // BLOCKS bits of some block (pigeonhole), so looking up all near values of every block of a window's fingerprint
proposes every item within the radius, and no others are looked at. What the blocks propose is verified: weighted Jaccard
similarity of the shingles of at least SIMILARITY.

Windows that can't reach SIMILARITY with any item are skipped before hashing: those in which too few places hold a shingle
of any item of their size. This loses nothing that verification would keep.

Defined cases: null and empty texts match nothing; items of fewer than WORDS words have one shingle of all their words,
items without words none and are ignored; null item_ids are items like others; documents shorter than an item are
compared as a whole; every input row is its own, repeated ones give repeated rows; an empty table gives no rows; other
columns are ignored by leaks() and carried by clean().
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from functools import lru_cache
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import known_to_workers, one_a_worker, own_columns, released, schema_of, text_of

WORDS = 5
SIMILARITY = 0.8
RADIUS = 20
BLOCKS = 8
ITEMS_BYTES = 16 << 20
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def shingles(found: list[str]) -> Counter:
    """Shingles and their weights."""
    if len(found) < WORDS:
        return Counter([tuple(found)] if found else [])
    return Counter(zip(*(found[i:] for i in range(WORDS)), strict=False))


def weighted_jaccard(a: Counter, b: Counter) -> float:
    both = sum(min(n, b[s]) for s, n in a.items() if s in b)
    total = a.total() + b.total() - both
    return both / total if total else 0.0


@lru_cache(maxsize=1 << 14)
def _hash(shingle: tuple) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(" ".join(shingle).encode("utf-8", "surrogatepass"))


def simhash(weights: Counter) -> int:
    """64 bits: of each, whether the weight of the shingles that have it is over half."""
    import numpy as np

    h = np.array([_hash(s) for s in weights], "<u8")
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    held = np.array(list(weights.values()), np.int64) @ bits.astype(np.int64)
    return int(np.packbits(2 * held > weights.total(), bitorder="little").view("<u8")[0])


class Index:
    """Items by their size and the blocks of their fingerprints; and which shingles items of a size hold."""

    def __init__(self, items: list[tuple]):
        self.items = []
        self.sizes: dict[tuple, set[int]] = defaultdict(set)
        self.blocks: list[dict[tuple, list[int]]] = [defaultdict(list) for _ in range(BLOCKS)]
        self.width = 64 // BLOCKS
        self.masks = [sum(1 << i for i in c) for k in range(RADIUS // BLOCKS + 1) for c in combinations(range(self.width), k)]
        for item_id, text in items:
            found = words(text or "")
            weights = shingles(found)
            if not weights:
                continue
            n, code = len(self.items), simhash(weights)
            self.items.append((item_id, weights, code))
            for s in weights:
                self.sizes[s].add(len(found))
            for table, value in zip(self.blocks, self._values(code), strict=True):
                table[len(found), value].append(n)
        self.short = any(len(s) < WORDS for s in self.sizes)
        #: the words of all items: a cheap first look at a text
        self.vocabulary = {w for s in self.sizes for w in s}

    def _values(self, code: int) -> list[int]:
        return [code >> b * self.width & (1 << self.width) - 1 for b in range(BLOCKS)]

    def near(self, code: int, size: int) -> list[int]:
        """Items of a size whose fingerprints lie within RADIUS of code."""
        found = set()
        for table, value in zip(self.blocks, self._values(code), strict=True):
            for m in self.masks:
                found.update(table.get((size, value ^ m), ()))
        return [n for n in found if (self.items[n][2] ^ code).bit_count() <= RADIUS]

    def places(self, found: list[str]) -> dict[int, list[int]]:
        """size -> places in found (ascending) where a shingle of an item of that size begins."""
        out: dict[int, list[int]] = defaultdict(list)
        run, known, sizes = 0, self.vocabulary, self.sizes
        for i, w in enumerate(found):
            if w not in known:
                run = 0
                continue
            run += 1
            if run >= WORDS:
                for size in sizes.get(tuple(found[i - WORDS + 1 : i + 1]), ()):
                    out[size].append(i - WORDS + 1)
            if self.short:
                for k in range(1, min(run, WORDS - 1) + 1):
                    for size in sizes.get(tuple(found[i - k + 1 : i + 1]), ()):
                        out[size].append(i - k + 1)
        return out

    def starts(self, places: list[int], size: int, n: int) -> list[int]:
        """Starts of the windows of a text of n words that hold enough of places for SIMILARITY."""
        own, window = max(1, size - WORDS + 1), max(1, min(size, n) - WORDS + 1)
        least = SIMILARITY / (1 + SIMILARITY) * (own + window) - 1e-9
        last, out = max(0, n - size), []
        for i, p in enumerate(places):  # windows that begin after the place before and at most at this one
            for s in range(max(places[i - 1] + 1 if i else 0, p - window + 1), min(p, last) + 1):
                if bisect_left(places, s + window, i) - i >= least:
                    out.append(s)
        return out

    def matches(self, text: str) -> list[tuple]:
        """(item_id, first word, number of words, distance, similarity) of each item's best window of the text."""
        found = words(text)
        best: dict[int, tuple] = {}
        for size, places in self.places(found).items():
            for s in self.starts(places, size, len(found)):
                window = shingles(found[s : s + size])
                code = simhash(window)
                for n in self.near(code, size):
                    item_id, weights, own = self.items[n]
                    j = weighted_jaccard(window, weights)
                    if j >= SIMILARITY and (n not in best or j > best[n][4]):
                        best[n] = (item_id, s, len(found[s : s + size]), (code ^ own).bit_count(), j)
        return [best[n] for n in sorted(best)]


@one_a_worker
def _index(broadcast) -> Index:
    return Index(broadcast.value)


def _blocks(items: DataFrame):
    """The items (item_id, text) in blocks of at most ITEMS_BYTES of text, read by the driver one after another."""
    held, size = [], 0
    for r in items.select("item_id", text_of(items).alias("text")).orderBy("item_id", "text").toLocalIterator():
        held.append((r["item_id"], r["text"]))
        size += len(r["text"]) + 16
        if size > ITEMS_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, distance, similarity): the best window of each item that a document holds."""
    spark, out, shares = docs.sparkSession, None, []
    known_to_workers(spark)
    rows = docs.select("doc_id", text_of(docs).alias("text"))
    schema = schema_of(doc_id=docs.schema["doc_id"].dataType, item_id=items.schema["item_id"].dataType, first_word="int", n_words="int", distance="int", similarity="double")
    kinds = to_arrow_schema(schema)
    for block in _blocks(items):
        shares.append(shared := spark.sparkContext.broadcast(block))

        def scan(batches, shared=shared):
            index = _index(shared)
            for batch in batches:
                found = [(at, *m) for at, text in enumerate(batch.column("text").to_pylist()) for m in index.matches(text)]
                at, *rest = zip(*found, strict=True) if found else [()] * 6
                columns = [batch.column("doc_id").take(pa.array(at, pa.int64())), *(pa.array(x, f.type) for x, f in zip(rest, list(kinds)[1:], strict=True))]
                yield pa.RecordBatch.from_arrays(columns, names=kinds.names)

        part = rows.mapInArrow(scan, schema)
        out = part if out is None else out.unionByName(part)
    released(spark, *shares)
    return spark.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the rows that hold an item of the benchmark; all columns as they are, nothing is shuffled."""
    spark, shares = docs.sparkSession, []
    known_to_workers(spark)
    rows = docs.select(F.struct(*own_columns(docs)).alias("row"), text_of(docs).alias("text"))
    schema = rows.schema
    for block in _blocks(items):
        shares.append(shared := spark.sparkContext.broadcast(block))

        def keep(batches, shared=shared):
            index = _index(shared)
            for batch in batches:
                yield batch.filter(pa.array([not index.matches(t) for t in batch.column("text").to_pylist()], pa.bool_()))

        rows = rows.mapInArrow(keep, schema)
    released(spark, *shares)
    return rows.select("row.*")
