"""Removal of every byte that a repeated 200-byte string covers, by prefix-free parsing.

Parsing. A rolling hash over every TRIGGER bytes makes triggers: the start p of a 200-byte string is given the trigger
with the smallest hash (leftmost of equals) among the SPAN places from p on. That depends on the string alone, so equal
strings anywhere in the corpus are parsed alike. Starts with one trigger form a phrase; a phrase has the trigger's
dictionary word (the 201 - SPAN bytes at the trigger, which every string of the phrase contains) and its extent (all
bytes its strings cover). No two phrases of a document share a trigger, so the parse is prefix-free.

Order. Two strings of one phrase word agree if they agree in what stands before the trigger and in what follows from it. So
the order of the corpus' 200-byte strings is put together from two arrays, each built over less than the corpus:
  1. dictionary: words of one occurrence end all their strings' chances;
  2. parse: extents that occur twice settle all their strings at once (whole copies end here);
  3. what is left (the rims of copies): the extents of a word's distinct classes meet, one copy of each class. Their parts
     before the trigger, read backwards, are put in a suffix array, and so are their parts from the trigger on, both with
     the lengths of common prefixes. Strings that begin o bytes before the trigger are in corpus order when they stand by
     (class of agreement on o bytes in the first array, rank in the second); neighbours there that share 200 - o bytes
     from the trigger on (a range minimum over the second array's common prefixes) are repeats.
Words with more than HOT classes are ranked by a distributed aggregation over the single strings instead, so no group has
to fit a task. There, and in steps 1 and 2, a class is told by 128 bits of hash; step 3 compares bytes.

Shuffled are the phrases (about one in SPAN / 2 bytes), the rims, and the texts twice (for the rims' bytes, for the cuts).

Defined cases: null and empty texts, and those of under 200 bytes, lose nothing; a repeated row is a copy like any other;
rows are told apart by 79 bits of hash of doc_id (null as well) and text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_parts, own_columns, partitions, row_key, schema_of, text_of, written

DEPTH = 200
SPAN = 136
TRIGGER = 16
HOT = 5_000
_TAG_BITS = 15
LONGEST_BATCH = 8_000
PART = 500  # texts with their phrases that are Python objects at once


def _mixed(byte):
    """A 64-bit value for each byte value."""
    import numpy as np

    x = (byte.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return x * np.uint64(0xBF58476D1CE4E5B9)


def rolling(data):
    """The polynomial hash of the TRIGGER bytes at each place, by doubling."""
    import numpy as np

    global _TABLE
    if _TABLE is None:
        _TABLE = _mixed(np.arange(256))
    h, power, width = _TABLE[data], 0xD1342543DE82EF95, 1
    with np.errstate(over="ignore"):
        while width < TRIGGER:
            h = h[:-width] * np.uint64(power) + h[width:]
            power = power * power & (1 << 64) - 1
            width *= 2
        h = h * np.uint64(0x9E3779B97F4A7C15)
    return h


_TABLE = None


def phrases(data, depth: int = DEPTH, span: int = SPAN):
    """(first start, number of starts less 1, trigger) of every phrase of a document's bytes (a numpy array)."""
    import numpy as np

    n = len(data) - depth + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    h = rolling(data)[: n + span - 1]
    v = h >> np.uint64(32) << np.uint64(32) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while 2 * width <= span:
        v = np.minimum(v[:-width], v[width:])
        width *= 2
    if width < span:
        v = np.minimum(v[: width - span], v[span - width :])
    trigger = (v[:n] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.concatenate(([0], np.flatnonzero(trigger[1:] != trigger[:-1]) + 1))
    return first, np.diff(np.append(first, n)) - 1, trigger[first]


def _parsed(batches):
    """(word, extent, did, at) of every phrase; at packs the row's tag, the phrase's first start, the way from there to the
    trigger and the number of further starts."""
    import numpy as np
    from xxhash import xxh64_intdigest

    word_len = DEPTH - SPAN + 1
    for batch in in_parts(batches, PART):
        words, extents, dids, ats = [], [], [], []

        def out():
            columns = [pa.array(np.array(words, np.uint64).view(np.int64)), pa.array(np.array(extents, np.uint64).view(np.int64)), pa.array(np.concatenate(dids or [np.zeros(0, np.int64)])), pa.array(np.concatenate(ats or [np.zeros(0, np.int64)]))]
            for x in (words, extents, dids, ats):
                x.clear()
            return pa.RecordBatch.from_arrays(columns, names=["word", "extent", "did", "at"])

        for did, tag, text in zip(batch.column("did").to_pylist(), batch.column("tag").to_pylist(), batch.column("text").to_pylist(), strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            first, more, trigger = phrases(np.frombuffer(raw, np.uint8))
            if len(first):
                words += [xxh64_intdigest(raw[a : a + word_len]) for a in trigger.tolist()]
                extents += [xxh64_intdigest(raw[a:b]) for a, b in zip(first.tolist(), (first + more + DEPTH).tolist(), strict=True)]
                dids.append(np.full(len(first), did, np.int64))
                ats.append(tag << 48 | first << 16 | trigger - first << 8 | more)
                if len(words) > 200_000:
                    yield out()
        yield out()


def _place(at):
    """(first start, number of further starts); of a number or an array."""
    return at >> 16 & 0xFFFFFFFF, at & 0xFF


def _rims(batches):
    """(word, did, at, single, bytes): the extents of a document's phrases that are not settled."""
    for batch in in_parts(batches, PART):
        out: dict = {"word": [], "did": [], "at": [], "hot": [], "bytes": []}
        for did, text, asked in zip(batch.column("did").to_pylist(), batch.column("text").to_pylist(), batch.column("asked").to_pylist(), strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            for ask in asked:
                first, more = _place(ask["at"])
                for k, v in (("word", ask["word"]), ("did", did), ("at", ask["at"]), ("hot", ask["hot"]), ("bytes", raw[first : first + more + DEPTH])):
                    out[k].append(v)
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("word", pa.int64()), ("did", pa.int64()), ("at", pa.int64()), ("hot", pa.bool_()), ("bytes", pa.binary())]))


_SPAN_ROWS = "did long, tag int, begin long, end long"


def _common(rows):
    """How many bytes each row (of a byte matrix) shares with the next one, from the left."""
    differs = rows[1:] != rows[:-1]
    return differs.argmax(axis=1) + (~differs.any(axis=1)) * rows.shape[1]


class _Least:
    """Minima over ranges of an array, by a table of the minima over all ranges of 2**k places."""

    def __init__(self, values):
        import numpy as np

        self.steps = [values]
        while 2 << len(self.steps) - 1 <= len(values):
            half, k = self.steps[-1], 1 << len(self.steps) - 1
            self.steps.append(np.minimum(half[:-k], half[k:]))
        self.log = np.zeros(len(values) + 2, np.int64)
        for k in range(1, len(self.steps) + 1):
            self.log[1 << k :] = k

    def __call__(self, a, b):
        """The minima over the places a to b (without b), arrays with a < b."""
        import numpy as np

        k, out = self.log[b - a], np.empty(len(a), self.steps[0].dtype)
        for step in np.unique(k).tolist():
            at = np.flatnonzero(k == step)
            table = self.steps[step]
            out[at] = np.minimum(table[a[at]], table[b[at] - (1 << step)])
        return out


def rim_order(word, before, more, raw):
    """Which strings of the rims repeat. word: the rims' words in groups; before: bytes before the trigger; more: further
    starts; raw: the rims' bytes. Returns (first, last) repeated start of each rim, counted from the rim's first, or -1.

    The two arrays are sorted matrices of bytes, raised by one so that 0 ends a text (UTF-8 has no byte 0xFF).
    """
    import numpy as np

    n = len(raw)
    size = np.array([len(r) for r in raw], np.int64)
    flat = np.frombuffer(b"".join(raw), np.uint8)
    trigger = np.cumsum(size) - size + before
    group = np.cumsum(np.append(0, word[1:] != word[:-1])).astype(">u4")
    back, ahead = np.arange(SPAN), np.arange(DEPTH)
    left = np.zeros((n, 4 + SPAN), np.uint8)
    left[:, :4] = group.view(np.uint8).reshape(n, 4)
    left[:, 4:] = np.where(back < before[:, None], flat[np.maximum(trigger[:, None] - 1 - back, 0)] + np.uint8(1), 0)
    right = np.where(ahead < (size - before)[:, None], flat[np.minimum(trigger[:, None] + ahead, len(flat) - 1)] + np.uint8(1), 0).astype(np.uint8)
    order = np.argsort(left.view(f"S{4 + SPAN}").ravel(), kind="stable")
    agree = _common(left[order]).astype(np.int64) - 4  # below 0 between two words
    by_right = np.argsort(right.view(f"S{DEPTH}").ravel(), kind="stable")
    rank = np.empty(n, np.int64)
    rank[by_right] = np.arange(n)
    least = _Least(_common(right[by_right]).astype(np.int16))
    before_, more_, rank_ = before[order], more[order], rank[order]
    first, last = np.full(n, 1 << 20), np.full(n, -1)
    for o in range(SPAN):
        active = np.flatnonzero((before_ >= o) & (before_ - more_ <= o))
        if len(active) < 2:
            continue
        known = np.append(0, np.cumsum(agree < o))[active]
        key = known * n + rank_[active]
        by = np.argsort(key)
        known, place = known[by], rank_[active][by]
        pair = np.flatnonzero(known[1:] == known[:-1])
        pair = pair[least(place[pair], place[pair + 1]) >= DEPTH - o]
        if len(pair):
            rims = order[active[by[np.union1d(pair, pair + 1)]]]
            start = before[rims] - o
            first[rims] = np.minimum(first[rims], start)
            last[rims] = np.maximum(last[rims], start)
    return np.where(last < 0, -1, first), last


def _ranked(batches):
    """Of rims sorted by word: the span that strings cover which another rim of the word holds too. A rim's starts lie
    within SPAN bytes, so its repeated strings overlap and make one span."""
    import numpy as np

    def settle(rims):
        if not rims:
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int32()), pa.array([], pa.int64()), pa.array([], pa.int64())], names=["did", "tag", "begin", "end"])
        word, did, at, raw = zip(*rims, strict=True)
        word, did, at = (np.array(x, np.int64) for x in (word, did, at))
        first, last = rim_order(word, at >> 8 & 0xFF, at & 0xFF, raw)
        hit, start = last >= 0, _place(at)[0]
        columns = [did, (at >> 48).astype(np.int32), start + first, start + last + DEPTH]
        return pa.RecordBatch.from_arrays([pa.array(c[hit]) for c in columns], names=["did", "tag", "begin", "end"])

    held: list = []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("word", "did", "at", "bytes")), strict=True):
            if len(held) >= LONGEST_BATCH and row[0] != held[-1][0]:
                yield settle(held)
                held = []
            held.append(row)
    yield settle(held)


def _single(batches):
    """(word, suffix, did, tag, start) of every single string of the rims of hot words."""
    from xxhash import xxh64_intdigest

    for batch in in_parts(batches, PART):
        out: dict = {"word": [], "suffix": [], "did": [], "tag": [], "start": []}
        for word, did, at, raw in zip(*(batch.column(c).to_pylist() for c in ("word", "did", "at", "bytes")), strict=True):
            first, more = _place(at)
            for i in range(more + 1):
                h = xxh64_intdigest(raw[i : i + DEPTH])
                for k, v in (("word", word), ("suffix", h - (h >> 63 << 64)), ("did", did), ("tag", at >> 48), ("start", first + i)):
                    out[k].append(v)
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("word", pa.int64()), ("suffix", pa.int64()), ("did", pa.int64()), ("tag", pa.int32()), ("start", pa.int64())]))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(did, tag, begin, end): byte spans, overlapping ones too, of keyed docs(did, tag, text, ..) that are repeated."""
    spark = docs.sparkSession
    parse, _ = written(spark, docs.select("did", "tag", "text").mapInArrow(_parsed, "word long, extent long, did long, at long"), "parse")
    classes = parse.groupBy("word", "extent").agg(F.count("*").alias("times"), F.min(F.struct("did", "at")).alias("one"))
    words = classes.groupBy("word").agg(F.sum("times").alias("n"), F.count("*").alias("kinds"), F.count_if(F.col("times") == 1).alias("open")).filter("n > 1")
    classes, _ = written(spark, classes.join(words, "word").select("word", "extent", "times", "one", "kinds", "open"), "phrases")

    settled = parse.join(classes.filter("times > 1").select("word", "extent"), ["word", "extent"], "left_semi")
    start = F.shiftrightunsigned("at", 16).bitwiseAND(F.lit(0xFFFFFFFF))
    tag = F.shiftrightunsigned("at", 48).cast("int")
    whole = settled.select("did", tag.alias("tag"), start.alias("begin"), (start + F.col("at").bitwiseAND(F.lit(0xFF)) + DEPTH).alias("end"))

    ask = classes.filter("kinds > 1 and open > 0").select("word", "one.did", "one.at", (F.col("kinds") > HOT).alias("hot"))
    ask = ask.groupBy("did", tag.alias("tag")).agg(F.collect_list(F.struct("word", "at", "hot")).alias("asked"))
    rims = docs.join(ask, ["did", "tag"]).mapInArrow(_rims, "word long, did long, at long, hot boolean, bytes binary")
    rims, _ = written(spark, rims, "rims")
    near = rims.filter("not hot").repartition(partitions(spark), "word").sortWithinPartitions("word").select("word", "did", "at", "bytes").mapInArrow(_ranked, _SPAN_ROWS)
    single = rims.filter("hot").select("word", "did", "at", "bytes").mapInArrow(_single, "word long, suffix long, did long, tag int, start long")
    twice = single.groupBy("word", "suffix").count().filter("count > 1").select("word", "suffix")
    far = single.join(twice, ["word", "suffix"], "left_semi").select("did", "tag", F.col("start").alias("begin"), (F.col("start") + DEPTH).alias("end"))
    return whole.union(near).union(far)


def _keyed(docs: DataFrame) -> DataFrame:
    """(did, tag, text, row): did and tag tell rows apart; row holds all of docs' columns but text."""
    text, doc_id = text_of(docs), docs["doc_id"]
    tag = F.shiftrightunsigned(F.xxhash64(text, doc_id, F.lit(1)), 64 - _TAG_BITS).cast("int")
    return docs.select(row_key(doc_id, text).alias("did"), tag.alias("tag"), text.alias("text"), F.struct(*[c for c, name in zip(own_columns(docs), docs.columns, strict=True) if name != "text"]).alias("row"))


def merged(spans) -> list[tuple[int, int]]:
    """Maximal runs that the spans cover; touching spans are one run."""
    out: list = []
    for a, b in sorted((s["begin"], s["end"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _with_spans(docs: DataFrame) -> DataFrame:
    keyed = _keyed(docs)
    spans = repeated_spans(keyed).groupBy("did", "tag").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    return keyed.join(spans, ["did", "tag"], "left")


def dedup_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs(doc_id, text)."""

    def cut(batches):
        for batch in in_parts(batches, PART):
            size, removed, runs, sha = [], [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                gone, kept, at = merged(spans), hashlib.sha256(), 0
                for a, b in gone:
                    kept.update(raw[at:a])
                    at = b
                kept.update(raw[at:])
                size.append(len(raw)), removed.append(sum(b - a for a, b in gone)), runs.append(len(gone)), sha.append(kept.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _with_spans(docs.select("doc_id", "text")).select("row.doc_id", "text", "spans").mapInArrow(cut, schema_of(doc_id=docs.schema["doc_id"].dataType, n_bytes="long", n_removed="long", n_spans="long", kept_sha256="string"))


def dedup_texts(docs: DataFrame) -> DataFrame:
    """docs with the repeated bytes cut out of their texts.

    A code point goes if any of its bytes does. Texts of which nothing is left stay as empty ones. n_chars is counted
    anew where that column exists.
    """
    joined = _with_spans(docs)

    def cut(batches):
        for batch in in_parts(batches, PART):
            texts = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                raw, parts, at = text.encode("utf-8", "surrogatepass"), [], 0
                for a, b in merged(spans):
                    parts.append(raw[at:a])
                    at = b
                texts.append(b"".join([*parts, raw[at:]]).decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=["row", "text"])

    out = joined.select("row", "text", "spans").mapInArrow(cut, schema_of(row=joined.schema["row"].dataType, text="string"))
    counted = F.char_length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    return out.select(*[F.col("text") if c == "text" else counted.alias(c) if c == "n_chars" else F.col("row").getField(c).alias(c) for c in docs.columns])
