"""SimHash near-duplicates by vantage-point trees.

A fingerprint's bit is 1 if it is set in over half of the document's shingle hashes (XXH64, seed 42, of three words
joined by spaces; fewer words: the whole sequence). Distinct fingerprints are sharded by the top of a vantage-point
tree: at every node they part by their Hamming distance to a vantage point. A fingerprint lives in one shard and is
sent as a query to those other shards that its ball of the radius overlaps by the triangle inequality, so every pair
within the radius meets in a shard. There a local vantage-point tree finds the pairs in the same way. Where a node no
longer prunes (a dense group), pairs are not enumerated: two fingerprints lie within 2 bits if and only if they share
one of the 65 values that are at most one bit off, so equal values link them in linear time. Shards return spanning
forests only.

The tree's top is built on a bounded sample of distinct fingerprints (64 a shard): it decides balance alone, never what
is found.

Defined cases: null or white-space texts have fingerprint zero and link like any other; equal fingerprints are one
node; null doc_ids get a fingerprint and a component like any row but never name a component (one of null ids only has
component_id null); every input row gives one row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import own_columns, partitions, row_key, text_of, written
from .graph import components, local_components

RADIUS = 2
SHARD_MOST = 200_000
SAMPLE_EACH = 64
LEAF = 48


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of a text."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: -shingle] + 1)).tolist()
    ends = ends[shingle - 1 :].tolist()
    n = len(ends)
    count = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 15):
        h = [xxh64_intdigest(joined[i:j], seed) for i, j in zip(starts[k : k + (1 << 15)], ends[k : k + (1 << 15)], strict=True)]
        bits = np.unpackbits(np.array(h, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""

    def mapped(batches):
        import numpy as np

        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    rows = docs.select("doc_id", text_of(docs).alias("text"))
    return rows.mapInArrow(mapped, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def top_tree(sample, shards: int, rng=None):
    """Nodes (vantage point, radius, inner child, outer child); a child below 0 is shard -1 - child."""
    import numpy as np

    rng = rng or np.random.default_rng(7)
    nodes: list = []
    leaves = 0

    def grow(part, want: int) -> int:
        nonlocal leaves
        if want <= 1 or len(part) < 8:
            leaves += 1
            return -leaves
        vp = part[rng.integers(len(part))]
        d = np.bitwise_count(part ^ vp)
        inner = want // 2
        mu = int(np.sort(d)[max(0, len(d) * inner // want - 1)])
        near = d <= mu
        if near.all():
            mu -= 1
            near = d <= mu
        if not near.any():
            leaves += 1
            return -leaves
        at = len(nodes)
        nodes.append(None)
        a, b = grow(part[near], inner), grow(part[~near], want - inner)
        nodes[at] = (int(vp), mu, a, b)
        return at

    root = grow(np.unique(np.asarray(sample, np.uint64)), shards)
    return root, nodes, leaves


def routed(fps, tree, radius: int):
    """(index, shard, home) of every fingerprint: its own shard, and those of higher number that its ball overlaps."""
    import numpy as np

    root, nodes, _ = tree
    out: list = []

    def walk(at: int, idx, inside):
        if not len(idx):
            return
        if at < 0:
            out.append((idx, np.full(len(idx), -1 - at, np.int32), inside))
            return
        vp, mu, a, b = nodes[at]
        d = np.bitwise_count(fps[idx] ^ np.uint64(vp)).astype(np.int16)
        near, far = d <= mu + radius, d > mu - radius
        walk(a, idx[near], inside[near] & (d[near] <= mu))
        walk(b, idx[far], inside[far] & (d[far] > mu))

    walk(root, np.arange(len(fps)), np.ones(len(fps), bool))
    if not out:
        return (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, bool))
    idx, shard, home = (np.concatenate(x) for x in zip(*out, strict=True))
    own = np.empty(len(fps), np.int32)
    own[idx[home]] = shard[home]
    keep = home | (shard > own[idx])
    return idx[keep], shard[keep], home[keep]


def _near_by_values(fps):
    """Links among fingerprints within two bits, through shared values at most one bit off: linear, no pairs."""
    import numpy as np

    masks = np.concatenate((np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)))
    n = len(fps)
    value = (fps[:, None] ^ masks[None, :]).ravel()
    order = np.argsort(value, kind="stable")
    value, node = value[order], (order // 65).astype(np.int64)
    same = value[1:] == value[:-1]
    a, b = node[:-1][same], node[1:][same]
    label = local_components(n, a, b)
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def shard_links(members, queries, radius: int = RADIUS):
    """A spanning forest (two arrays of fingerprints) of the links of members among themselves and with queries."""
    import numpy as np

    rng = np.random.default_rng(11)
    every = np.concatenate((members, queries))
    found_a, found_b, held = [], [], 0
    label = None

    def keep(a, b):
        nonlocal held, label
        found_a.append(a)
        found_b.append(b)
        held += len(a)
        if held > 2_000_000:
            fold()

    def fold():
        nonlocal held, label
        a, b = np.concatenate(found_a or [np.zeros(0, np.int64)]), np.concatenate(found_b or [np.zeros(0, np.int64)])
        label = local_components(len(every), a, b)
        moved = np.flatnonzero(label != np.arange(len(every)))
        found_a[:], found_b[:], held = [moved], [label[moved]], len(moved)

    def walk(inner, ask):
        if not len(inner) or not len(ask):
            return
        if len(inner) <= LEAF or len(ask) <= 4:
            for k in range(0, len(ask), 1 << 14):
                part = ask[k : k + (1 << 14)]
                d = np.bitwise_count(every[part][:, None] ^ every[inner][None, :])
                i, j = np.nonzero(d <= radius)
                i, j = part[i], inner[j]
                keep(i[i != j], j[i != j])
            return
        vp = every[inner[rng.integers(len(inner))]]
        d = np.bitwise_count(every[inner] ^ vp).astype(np.int16)
        mu = int(np.median(d))
        if (d <= mu).all():
            mu -= 1
        q = np.bitwise_count(every[ask] ^ vp).astype(np.int16)
        near, far = q <= mu + radius, q > mu - radius
        if radius == 2 and (near & far).sum() > 0.85 * len(ask) and len(ask) <= 150_000 or not (d <= mu).any():
            both = np.unique(np.concatenate((inner, ask)))
            a, b = _near_by_values(every[both]) if radius == 2 else _all_pairs(every[both], radius)
            keep(both[a], both[b])
            return
        walk(inner[d <= mu], ask[near])
        walk(inner[d > mu], ask[far])

    walk(np.arange(len(members)), np.arange(len(every)))
    fold()
    a, b = found_a[0], found_b[0]
    return every[a], every[b]


def _all_pairs(fps, radius: int):
    """Links for a radius other than 2, row by row."""
    import numpy as np

    a, b = [], []
    for i in range(len(fps)):
        j = np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= radius) + i + 1
        a.append(np.full(len(j), i))
        b.append(j)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links of distinct(fp) that connect what fingerprints within the radius connect."""
    spark = distinct.sparkSession
    n = distinct.count()
    shards = max(partitions(spark), math.ceil(n / SHARD_MOST))
    import numpy as np

    sample = [r[0] for r in distinct.select("fp").orderBy(F.xxhash64("fp", F.lit(1))).limit(SAMPLE_EACH * min(shards, 1 << 14)).collect()]
    tree = top_tree(np.array(sample, np.int64).view(np.uint64), shards)

    def dealt(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            idx, shard, home = routed(fps, tree, radius)
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(fps[idx].view(np.int64)), pa.array(home)], names=["shard", "fp", "home"])

    def linked(rows: pa.Table) -> pa.Table:
        fps = rows.column("fp").to_numpy().view(np.uint64)
        home = rows.column("home").to_numpy(zero_copy_only=False)
        a, b = shard_links(fps[home], fps[~home], radius)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    return distinct.select("fp").mapInArrow(dealt, "shard int, fp long, home boolean").groupBy("shard").applyInArrow(linked, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable) of every row of docs(doc_id, text)."""
    spark = docs.sparkSession
    rows, _ = written(spark, fingerprints(docs, shingle), "simhash")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(distinct, radius))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def first_of_each(docs: DataFrame) -> DataFrame:
    """The row of the smallest doc_id of each group of near duplicates, all columns as they are.

    Groups are those of near_duplicates(). A null doc_id comes after all others; rows of one doc_id are ordered by the
    hash of their text, and of equal rows one stays.
    """
    spark = docs.sparkSession
    tie = row_key(docs["doc_id"], text_of(docs))
    rows, _ = written(spark, _keyed_fingerprints(docs, tie), "simhash")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tie")
    least = rows.groupBy("fp").agg(F.min(order).alias("least"))
    roots = components(links(least.select("fp")))
    rooted = least.join(roots, least["fp"] == roots["node"], "left").select(F.coalesce("root", "fp").alias("root"), "least")
    first = rooted.groupBy("root").agg(F.min("least").alias("first")).select(F.col("first.doc_id").alias("first_id"), F.col("first.tie").alias("first_tie"))
    packed = docs.select(docs["doc_id"].alias("own_id"), tie.alias("own_tie"), F.struct(*own_columns(docs)).alias("row"))
    kept = packed.join(first, F.col("own_id").eqNullSafe(F.col("first_id")) & (F.col("own_tie") == F.col("first_tie")), "left_semi")
    return kept.dropDuplicates(["own_id", "own_tie"]).select("row.*")


def _keyed_fingerprints(docs: DataFrame, tie) -> DataFrame:
    """doc_id, tie, fp of every row."""

    def mapped(batches):
        import numpy as np

        for batch in batches:
            fps = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), pa.array(fps, pa.int64())], names=["doc_id", "tie", "fp"])

    rows = docs.select("doc_id", tie.alias("tie"), text_of(docs).alias("text"))
    return rows.mapInArrow(mapped, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, tie long, fp long")
