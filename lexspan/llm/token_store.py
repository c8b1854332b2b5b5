"""Token ids as a wavelet matrix per shard: one compressed file that answers access, rank, select and occurrence queries.

The matrix is shaped by a Huffman code over the shard's ids: level l holds bit l of the codes longer than l, in the order
that stable partitions by the bits before it give. Codes are dealt so that the ids whose code ends at a level stand last
after its partition; the level below simply lacks them. So the planes take about the ids' entropy, a query walks as many
levels as its id's code is long, and nothing has to be unpacked for one.

File of a shard (little-endian):
    0   8 bytes  magic b"LXWM\\x02\\0\\0\\0"
    8   u64 n tokens; u32 levels; u32 documents; u32 distinct ids; u32 bytes of the codebook
    32  levels x u64: tokens of each level; levels x u64: zeros of each level
    ..  (documents + 1) x u64: where each document's ids start in the shard
    ..  the codebook, zlib, filled up to 8 bytes: ids (u32, ascending), their counts (u32) and code lengths (u8)
    ..  for each level: its bits as u64 words (bit i at bit i % 64 of word i // 64, whole blocks of BLOCK bits), then its
        rank directory, u32: ones before each block and in all (filled up to 8 bytes)

A corpus is written in ascending doc_id order: documents are range-partitioned by doc_id, sorted, encoded and packed in
shards of about SHARD_TOKENS ids (a document is never split). Spark's writer stores the files as rows
(part, seq, n_tokens, ids of the documents, payload) because executors share no other store than the one Spark writes to;
a payload is the file, byte for byte. A retried task writes the same file again.

Defined cases: a null or empty text holds only the end id; null doc_ids come first; rows of one doc_id follow each other
ordered by their texts' hash, then by text; an empty table gives no files and no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytebpe
from .common import one_a_worker, partitions, text_of, written

MAGIC = b"LXWM\x02\0\0\0"
SHARD_TOKENS = 1 << 22
BATCH_BYTES = 10 << 20
END_ID = 2
BLOCK = 512
BROADCAST_SHARDS = 1 << 20


def code_lengths(counts) -> list[int]:
    """Lengths of a Huffman code for counts (ascending), merged from two queues; 1 for a single one."""
    n = len(counts)
    if n < 2:
        return [1] * n
    weight, parent = [int(c) for c in counts], [0] * (2 * n - 1)
    leaf, inner = 0, n
    for new in range(n, 2 * n - 1):
        total = 0
        for _ in range(2):
            if leaf < n and (inner >= new or weight[leaf] <= weight[inner]):
                low, leaf = leaf, leaf + 1
            else:
                low, inner = inner, inner + 1
            total += weight[low]
            parent[low] = new
        weight.append(total)
    depth = [0] * (2 * n - 1)
    for k in range(2 * n - 3, -1, -1):
        depth[k] = depth[parent[k]] + 1
    return depth[:n]


def codes(lengths):
    """The code of each id (their lengths by ascending id), and for each level the places of the ids whose codes end there,
    in the order they stand in after the level's partition."""
    import numpy as np

    out, ends = np.zeros(len(lengths), np.uint64), []
    nodes = np.zeros(1, np.uint64)
    for level in range(1, int(max(lengths, default=0)) + 1):
        below = np.concatenate((nodes << np.uint64(1), nodes << np.uint64(1) | np.uint64(1)))
        done = np.flatnonzero(lengths == level)
        out[done] = below[len(below) - len(done) :]
        nodes = below[: len(below) - len(done)]
        ends.append(done)
    return out, ends


def _filled(raw: bytes, to: int = 8) -> bytes:
    return raw + b"\0" * (-len(raw) % to)


def pack(ids, starts) -> bytes:
    """The file of ids (unsigned integers), whose documents start at starts (with the end)."""
    import numpy as np

    ids = np.ascontiguousarray(ids)
    every = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    known = np.flatnonzero(every)
    counts = every[known]
    order = np.argsort(counts, kind="stable")
    lengths = np.zeros(len(known), np.int64)
    lengths[order] = code_lengths(counts[order])
    code, ends = codes(lengths)
    levels = len(ends)
    kind = np.uint32 if levels <= 32 else np.uint64
    width = 32 if levels <= 32 else 64
    table = np.zeros(len(every), kind)
    table[known] = (code << (width - lengths).astype(np.uint64)).astype(kind)  # the first bit is the highest
    x = table[ids]
    sizes, zeros, body = [], [], []
    for level, done in enumerate(ends):
        bit = (x & kind(1 << (width - 1 - level))) != 0
        words = np.frombuffer(_filled(np.packbits(bit, bitorder="little").tobytes(), BLOCK // 8), "<u8")
        ones = np.bitwise_count(words).reshape(-1, BLOCK // 64).sum(axis=1)
        body += [words.tobytes(), _filled(np.concatenate(([0], np.cumsum(ones))).astype("<u4").tobytes())]
        low, high = np.compress(~bit, x), np.compress(bit, x)
        sizes.append(len(x))
        zeros.append(len(low))
        x = np.concatenate((low, high))[: len(x) - int(counts[done].sum())]
    book = zlib.compress(known.astype("<u4").tobytes() + counts.astype("<u4").tobytes() + lengths.astype(np.uint8).tobytes(), 1)
    head = MAGIC + np.array([len(ids)], "<u8").tobytes() + np.array([levels, len(starts) - 1, len(known), len(book)], "<u4").tobytes()
    return b"".join([head, np.array(sizes, "<u8").tobytes(), np.array(zeros, "<u8").tobytes(), np.array(starts, "<u8").tobytes(), _filled(book), *body])


class WaveletMatrix:
    """A shard's file, opened: its planes and rank directories are used as they lie."""

    def __init__(self, blob):
        import numpy as np

        if bytes(blob[:8]) != MAGIC:
            raise ValueError("not a token shard")
        self.n = int(np.frombuffer(blob, "<u8", 1, 8)[0])
        self.levels, self.documents, distinct, book = (int(x) for x in np.frombuffer(blob, "<u4", 4, 16))
        at = 32
        self.sizes = np.frombuffer(blob, "<u8", self.levels, at).astype(np.int64)
        self.zeros = np.frombuffer(blob, "<u8", self.levels, at + 8 * self.levels).astype(np.int64)
        at += 16 * self.levels
        self.starts = np.frombuffer(blob, "<u8", self.documents + 1, at).astype(np.int64)
        at += 8 * (self.documents + 1)
        raw = zlib.decompress(bytes(blob[at : at + book]))
        at += book + -book % 8
        self.known = np.frombuffer(raw, "<u4", distinct)
        self.counts = np.frombuffer(raw, "<u4", distinct, 4 * distinct).astype(np.int64)
        self.lengths = np.frombuffer(raw, np.uint8, distinct, 8 * distinct).astype(np.int64)
        self.codes, self.ends = codes(self.lengths)
        self.bits, self.ones = [], []
        for size in self.sizes.tolist():
            blocks = -(-size // BLOCK)
            self.bits.append(np.frombuffer(blob, "<u8", blocks * BLOCK // 64, at))
            at += blocks * BLOCK // 8
            self.ones.append(np.frombuffer(blob, "<u4", blocks + 1, at))
            at += 4 * (blocks + 1) + 4 * (blocks + 1) % 8

    def _rank1(self, level: int, places):
        """Ones of a level before each of places (an array)."""
        import numpy as np

        block, rest = places // BLOCK, places % BLOCK
        bits = np.append(self.bits[level], np.zeros(BLOCK // 64, np.uint64))
        words = bits[(block * (BLOCK // 64))[:, None] + np.arange(BLOCK // 64)]
        whole = np.clip(rest[:, None] - 64 * np.arange(BLOCK // 64), 0, 64)  # how many bits of each word lie before the place
        mask = np.where(whole == 64, ~np.uint64(0), (np.uint64(1) << (whole % 64).astype(np.uint64)) - np.uint64(1))
        return self.ones[level][block].astype(np.int64) + np.bitwise_count(words & mask).sum(axis=1, dtype=np.int64)

    def _bit(self, level: int, i: int) -> int:
        return int(self.bits[level][i // 64]) >> (i % 64) & 1

    def _code(self, value: int) -> tuple[int, int]:
        """The code and its length, of an id that the shard holds; (0, 0) of others."""
        import numpy as np

        k = int(np.searchsorted(self.known, value)) if value >= 0 else len(self.known)
        return (int(self.codes[k]), int(self.lengths[k])) if k < len(self.known) and self.known[k] == value else (0, 0)

    def access(self, i: int) -> int:
        """The id at position i."""
        import numpy as np

        if not 0 <= i < self.n:
            raise IndexError(i)
        for level in range(self.levels):
            ones = int(self._rank1(level, np.array([i]))[0])
            i = int(self.zeros[level]) + ones if self._bit(level, i) else i - ones
            left = int(self.sizes[level + 1]) if level + 1 < self.levels else 0
            if i >= left:
                done = self.ends[level]
                return int(self.known[done[np.searchsorted(np.cumsum(self.counts[done]), i - left, side="right")]])
        raise AssertionError("every code ends")

    def _range(self, value: int, places):
        """Where value's occurrences begin after its last level, and how many stand before each of places."""
        import numpy as np

        code, length = self._code(value)
        if not length:
            return 0, np.zeros(len(places), np.int64)
        at = np.append(0, places)
        for level in range(length):
            ones = self._rank1(level, at)
            at = int(self.zeros[level]) + ones if code >> (length - 1 - level) & 1 else at - ones
        return int(at[0]), at[1:] - at[0]

    def ranks(self, value: int, places):
        """How often value stands before each of places (an array), in one walk over its code."""
        import numpy as np

        return self._range(value, np.clip(np.asarray(places, np.int64), 0, self.n))[1]

    def rank(self, value: int, i: int) -> int:
        """How often value stands before position i."""
        return int(self.ranks(value, [i])[0])

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def _select_bit(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) bit of a level that is `bit`."""
        import numpy as np

        ones = self.ones[level].astype(np.int64)
        before = ones if bit else BLOCK * np.arange(len(ones)) - ones
        block = int(np.searchsorted(before, k, side="right")) - 1
        left = k - int(before[block])
        for w in range(block * (BLOCK // 64), (block + 1) * (BLOCK // 64)):
            word = int(self.bits[level][w])
            if not bit:
                word = ~word & (1 << 64) - 1
            if left < word.bit_count():
                for _ in range(left):
                    word &= word - 1
                return 64 * w + (word & -word).bit_length() - 1
            left -= word.bit_count()
        raise IndexError(k)

    def select(self, value: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of value; IndexError if there is none."""
        import numpy as np

        first, total = self._range(value, np.array([self.n]))
        if not 0 <= k < total[0]:
            raise IndexError(k)
        code, length = self._code(value)
        i = first + k
        for level in range(length - 1, -1, -1):
            bit = code >> (length - 1 - level) & 1
            i = self._select_bit(level, bit, i - int(self.zeros[level]) if bit else i)
        return i

    def occurrences(self, value: int) -> list[int]:
        return [self.select(value, k) for k in range(self.count(value))]

    def decode(self):
        """All ids in order, by undoing the levels from the last to the first."""
        import numpy as np

        kind = np.uint16 if not len(self.known) or self.known[-1] < 1 << 16 else np.uint32
        known, x = self.known.astype(kind), np.zeros(0, kind)
        for level in range(self.levels - 1, -1, -1):
            bit = np.unpackbits(self.bits[level].view(np.uint8), count=int(self.sizes[level]), bitorder="little").view(bool)
            done = self.ends[level]
            x = np.concatenate((x, np.repeat(known[done], self.counts[done])))
            y, zeros = np.empty_like(x), int(self.zeros[level])
            y[np.flatnonzero(~bit)] = x[:zeros]
            y[np.flatnonzero(bit)] = x[zeros:]
            x = y
        return x


@one_a_worker
def _encoder(path: str) -> bytebpe.Encoder:
    return bytebpe.Encoder(path)


def write_shards(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> tuple[DataFrame, str]:
    """Writes docs(doc_id, text) as shards; returns the table of shards, read again, and its place."""
    spark = docs.sparkSession
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_of(docs).alias("text")).withColumn("tie", F.xxhash64("text"))
    # the range's sample goes to the driver: two longs a row, no text
    ordered = rows.repartitionByRange(partitions(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")

    def packed(batches):
        import numpy as np
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        encode = _encoder(tokenizer)
        ids, sizes, held = [], [], []

        def shard():
            nonlocal seq
            size = np.concatenate(sizes)
            starts = np.concatenate(([0], np.cumsum(size)))
            blob = pack(np.concatenate(held), starts)
            doc_ids = pa.concat_arrays(ids)
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([int(starts[-1])], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(doc_ids)], pa.int32()), doc_ids), pa.array([blob], pa.binary())], names=["part", "seq", "n_tokens", "doc_ids", "payload"])
            ids.clear(), sizes.clear(), held.clear()
            seq += 1
            return out

        for batch in batches:
            for piece in bytebpe.in_bytes(batch, BATCH_BYTES):
                flat, size = encode.batch(piece.column("text"), end_id)
                ids.append(piece.column("doc_id")), sizes.append(size), held.append(flat)
                if sum(map(len, held)) >= SHARD_TOKENS:
                    yield shard()
        if ids:
            yield shard()

    files = ordered.mapInArrow(packed, f"part int, seq int, n_tokens long, doc_ids array<{doc_type}>, payload binary")
    return written(spark, files, "token-shards", "uncompressed")


def read_shards(shards: DataFrame, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, n_end of every document, from the files. shards: as write_shards returns them.

    n_end counts the end id in the document, inside the text as well, by the files' rank support.

    A shard's base is the number of ids in all shards before it: sums by part (partial aggregation), then running sums
    over the parts and within each part. The windows see one short row a shard, no payload.
    """
    doc_type = shards.schema["doc_ids"].dataType.elementType.simpleString()
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_base"))
    base = shards.select("part", "seq", "n_tokens").join(F.broadcast(before), "part")
    base = base.select("part", "seq", (F.col("part_base") + F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")).alias("base"))

    def opened(batches):
        import numpy as np

        for batch in batches:
            for at in range(batch.num_rows):
                m = WaveletMatrix(batch.column("payload")[at].as_buffer())
                base, ids = batch.column("base")[at].as_py(), batch.column("doc_ids")[at].values
                all_ids = memoryview(m.decode().astype("<u4")).cast("B")
                crc = [zlib.crc32(all_ids[4 * a : 4 * b]) for a, b in zip(m.starts[:-1].tolist(), m.starts[1:].tolist(), strict=True)]
                ends = np.diff(m.ranks(end_id, m.starts))
                yield pa.RecordBatch.from_arrays([ids, pa.array(m.starts[:-1] + base), pa.array(np.diff(m.starts)), pa.array(crc, pa.int64()), pa.array(ends)], names=["doc_id", "start", "n_tokens", "ids_crc32", "n_end"])

    if base.count() <= BROADCAST_SHARDS:  # 24 bytes each; beyond that the join shuffles
        base = F.broadcast(base)
    return shards.join(base, ["part", "seq"]).select("doc_ids", "payload", "base").mapInArrow(opened, f"doc_id {doc_type}, start long, n_tokens long, ids_crc32 long, n_end long")


def token_store(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Writes the shards of docs and gives what reading them back says of every document."""
    shards, _ = write_shards(docs, tokenizer, end_id)
    return read_shards(shards, end_id)
