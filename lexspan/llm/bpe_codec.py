"""BPE encoding and decoding through a table of distinct words.

1. Every document is split into words (runs between ASCII white space; one comma or full stop after an ASCII letter is
   a word of its own, and ASCII words are lower-cased, as the tokenizer does itself). No word's encoding depends on its
   neighbours: the tokenizer drops white space and never joins across it. A tokenizer of other rules is refused.
2. The distinct words with their counts are one Spark aggregation (counted map-side first); each is encoded once.
3. The ids are joined back by position. The table's size is measured: up to HOT_BYTES it is broadcast as sorted arrays
   (96 bits of hash, ends, ids) and joined map-side, a batch's distinct words at a time. A larger table is cut at a word
   count: the words above it are broadcast, all rarer ones are joined by word over (document, position) rows, and meet the
   text again by document. The rarer words are by construction no hot keys.
4. Decoding joins ids with the tokenizer's id-to-piece table (as large as the vocabulary, so broadcast) and puts the
   pieces together by position; the tokenizer has no decoder, so its text is the pieces with spaces between. decoded()
   is that join in DataFrames, for ids in any table. encode_digests() makes it map-side in the worker that holds the ids:
   the key is dense, so the broadcast side is an array and its rows are taken by id.

Defined cases: null and empty texts have no ids and decode to the empty text; special tokens' strings in a text are
their one id, as the library does by default; every input row gives one row, with repeated rows and null doc_ids; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytebpe import in_bytes, load
from .common import known_to_workers, one_a_worker, released, row_key, schema_of, text_of, written

HOT_BYTES = 96 << 20
ENTRY_BYTES = 16
BATCH_BYTES = 4 << 20
SEGMENTS = 16
#: The tokenizer's rules that Split relies on.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def verified(path: str) -> str:
    """path, if the tokenizer there has the rules that make a text the sequence of its words; ValueError if not."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    steps = pre.get("pretokenizers") or [{}]
    split = steps[0].get("type") == "Split" and steps[0].get("pattern") == {"Regex": PATTERN} and steps[0].get("behavior") == "Removed" and steps[0].get("invert")
    later = all(x.get("type") == "ByteLevel" and not x.get("add_prefix_space") and not x.get("use_regex", True) for x in steps[1:])
    marks = any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec["added_tokens"])
    if (spec.get("normalizer") or {}).get("normalizers") != NORMALIZERS or not (split and later) or spec.get("decoder") or spec["model"].get("dropout") or marks:
        raise ValueError(f"{path}: its words are not independent in the way this operator needs")
    return path


class Split:
    """The words of texts (an Arrow array of strings): the distinct ones, which of them stands at each place, and where
    each text's places begin (and end)."""

    def __init__(self, texts):
        import numpy as np
        import pyarrow.compute as pc

        parts = pc.ascii_split_whitespace(texts)
        offsets = parts.offsets.to_numpy().astype(np.int64)
        coded = parts.flatten().dictionary_encode()
        runs = coded.dictionary.cast(pa.binary())
        tail = pc.and_(pc.is_in(pc.binary_slice(runs, -1), pa.array([b",", b"."])), pc.is_in(pc.binary_slice(runs, -2, -1), _LETTERS))
        head = pc.if_else(tail, pc.binary_slice(runs, 0, -1), runs).cast(pa.string())
        lower = pc.and_(pc.string_is_ascii(head), pc.invert(pc.match_substring(head, "<|")))
        heads = pc.if_else(lower, pc.ascii_lower(head), head).dictionary_encode()
        self.words = pa.concat_arrays([heads.dictionary, pa.array([",", "."])])
        tail, some = np.asarray(tail, bool), pc.binary_length(runs).to_numpy() > 0
        ends = np.cumsum(some.astype(np.int32) + tail, dtype=np.int32)
        flat = np.empty(ends[-1] if len(ends) else 0, np.int32)
        flat[ends[tail] - 1] = len(heads.dictionary) + np.asarray(pc.equal(pc.binary_slice(runs, -1), b"."), bool)[tail]
        flat[(ends - 1 - tail)[some]] = heads.indices.to_numpy()[some]
        lists = pa.ListArray.from_arrays(pa.array(np.append(np.int32(0), ends)), pa.array(flat)).take(coded.indices)
        self.at = lists.flatten().to_numpy()
        self.begin = np.append(0, np.cumsum(np.diff(lists.offsets.to_numpy())))[offsets - offsets[0]]


_LETTERS = pa.array([bytes([c]) for c in range(128) if chr(c).isalpha()])


def _hashes(found: list[bytes]):
    import numpy as np
    from xxhash import xxh64_intdigest

    return np.array([xxh64_intdigest(w) for w in found], np.uint64).view(np.int64)


def _checks(found: list[bytes]):
    import numpy as np
    from zlib import crc32

    return np.array([crc32(w) for w in found], np.uint32)


def distinct_words(docs: DataFrame) -> DataFrame:
    """word, n: each distinct word of docs(text) and how often it stands there."""

    def counted(batches):
        import numpy as np

        for batch in batches:
            for part in in_bytes(batch, BATCH_BYTES):
                split = Split(part.column("text"))
                n = np.bincount(split.at, minlength=len(split.words))
                yield pa.RecordBatch.from_arrays([split.words, pa.array(n)], names=["word", "n"]).filter(pa.array(n > 0))

    known_to_workers(docs.sparkSession)
    return docs.select(text_of(docs).alias("text")).mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


@one_a_worker
def _tokenizer(path: str):
    return load(path)


def encoded_words(distinct: DataFrame, tokenizer: str) -> DataFrame:
    """word, n, ids (array<int>), hash, second (96 bits that tell words apart) of each distinct word, encoded once."""

    def coded(batches):
        import numpy as np

        tok = _tokenizer(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                found, raw = part.column("word").to_pylist(), part.column("word").cast(pa.binary()).to_pylist()
                ids = [e.ids for e in tok.encode_batch_fast(found, add_special_tokens=False)]
                yield pa.RecordBatch.from_arrays([part.column("word"), part.column("n"), pa.array(ids, pa.list_(pa.int32())), pa.array(_hashes(raw)), pa.array(_checks(raw).astype(np.int64))], names=["word", "n", "ids", "hash", "second"])

    return distinct.mapInArrow(coded, "word string, n long, ids array<int>, hash long, second long")


def id_to_piece(spark: SparkSession, tokenizer: str) -> DataFrame:
    """id, piece: the tokenizer's vocabulary with its added tokens."""
    tok = load(tokenizer)
    return spark.createDataFrame([(i, tok.id_to_token(i) or "") for i in range(tok.get_vocab_size())], "id int, piece string")


def decoded(table: DataFrame, key: list[str], tokenizer: str) -> DataFrame:
    """table(key.., ids) with decoded: the ids' pieces, joined by id and put together by position; none of no ids."""
    at = table.select(*key, F.posexplode("ids").alias("at", "id"))
    pieces = at.join(F.broadcast(id_to_piece(table.sparkSession, tokenizer)), "id")
    whole = pieces.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("pieces"))
    return whole.select(*key, F.transform("pieces", lambda p: p["piece"]).alias("pieces"))


def segments(hot: DataFrame) -> list[tuple]:
    """hot(hash, second, ids) as sorted segments (hashes, second hashes, numbers of ids, ids), made by the executors: the
    driver only passes bytes on."""

    def packed(batches):
        import numpy as np

        parts = list(batches)
        if not sum(b.num_rows for b in parts):
            return
        whole = pa.Table.from_batches(parts).combine_chunks()
        ids = whole.column("ids").chunk(0)
        flat, ends = ids.flatten().to_numpy(), ids.offsets.to_numpy()
        kind = "<u2" if not len(flat) or flat.max() < 1 << 16 else "<u4"
        columns = [whole.column("hash").to_numpy().astype("<i8"), whole.column("second").to_numpy().astype("<u4"), np.diff(ends).astype("<u4"), flat.astype(kind)]
        yield pa.RecordBatch.from_arrays([pa.array([int(columns[0][0])]), *(pa.array([c.tobytes()], pa.binary()) for c in columns), pa.array([int(kind[2])], pa.int32())], names=["least", "hash", "second", "size", "ids", "width"])

    ordered = hot.repartitionByRange(SEGMENTS, "hash").sortWithinPartitions("hash")
    found = ordered.mapInArrow(packed, "least long, hash binary, second binary, size binary, ids binary, width int").toArrow()
    return sorted(zip(*(found.column(c).to_pylist() for c in ("least", "hash", "second", "size", "ids", "width")), strict=True))


def _with_spaces(values: list[str]):
    return pa.array([v.encode() + b" " for v in values], pa.binary())


class Codec:
    """Joins words with the broadcast table by their hashes, and ids with the id-to-piece table. The table's bytes are used
    as they lie."""

    def __init__(self, parts: list[tuple], tokenizer: str):
        import numpy as np

        tok = _tokenizer(tokenizer)
        self.least = np.array([p[0] for p in parts], np.int64)
        self.parts = [(np.frombuffer(p[1], "<i8"), np.frombuffer(p[2], "<u4"), np.cumsum(np.frombuffer(p[3], "<u4"), dtype=np.uint32), np.frombuffer(p[4], f"<u{p[5]}")) for p in parts]
        self.pieces = _with_spaces([tok.id_to_token(i) or "" for i in range(tok.get_vocab_size())])
        self.numbers = _with_spaces([str(i) for i in range(len(self.pieces))])

    def ids_of(self, found):
        """The list of ids of each word (an Arrow array), and whether the table lacks it (its list is empty then)."""
        import numpy as np

        found = found.cast(pa.binary()).to_pylist()
        h, c = _hashes(found), _checks(found)
        order = np.argsort(h)  # searched in order, so that neighbours meet the same part of the table
        h, c = h[order], c[order]
        bounds = np.append(np.searchsorted(h, self.least), len(h))
        lacking, size, flat = np.ones(len(h), bool), np.zeros(len(h), np.int64), []
        for a, b, (hashes, checks, ends, ids) in zip(bounds[:-1].tolist(), bounds[1:].tolist(), self.parts, strict=True):
            q = h[a:b]
            at = np.minimum(np.searchsorted(hashes, q), len(hashes) - 1)
            hit = hashes[at] == q
            for k in np.flatnonzero(hit & (checks[at] != c[a:b])).tolist():  # words of one hash stand together
                i = int(at[k])
                while i < len(hashes) and hashes[i] == q[k] and checks[i] != c[a + k]:
                    i += 1
                hit[k] = i < len(hashes) and hashes[i] == q[k]
                at[k] = min(i, len(hashes) - 1)
            begin = np.where(at > 0, ends[at - 1], 0).astype(np.int64)
            number = np.where(hit, ends[at] - begin, 0)
            total = np.cumsum(number)
            flat.append(ids[np.repeat(begin - (total - number), number) + np.arange(total[-1] if len(total) else 0)].astype(np.int32))
            lacking[a:b], size[a:b] = ~hit, number
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int32), *flat])))
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return lists.take(pa.array(back)), lacking[back]


@one_a_worker
def _codec(broadcast, tokenizer: str) -> Codec:
    return Codec(broadcast.value, tokenizer)


def hot_least(table: DataFrame) -> int:
    """The least count of a word such that all words of at least that count (rounded to powers of 2) fit HOT_BYTES."""
    size = F.lit(ENTRY_BYTES) + 2 * F.size("ids")
    steps = table.groupBy(F.floor(F.log2("n")).alias("step")).agg(F.sum(size).alias("bytes")).orderBy(F.desc("step")).collect()
    held, least = 0, 1 << 62
    for r in steps:
        held += r["bytes"]
        if held > HOT_BYTES:
            return least
        least = 1 << r["step"]
    return 0


def encode_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of docs(doc_id, text)."""
    return _encoded(docs, tokenizer, False)


def encode_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """As encode_digests, with the ids (array<int>) and the decoded text as well."""
    return _encoded(docs, tokenizer, True)


def _encoded(docs: DataFrame, tokenizer: str, whole: bool) -> DataFrame:
    spark = docs.sparkSession
    table, _ = written(spark, encoded_words(distinct_words(docs), verified(tokenizer)), "words")
    least = hot_least(table)
    hot = spark.sparkContext.broadcast(segments(table.filter(F.col("n") >= least).select("hash", "second", "ids")))
    released(spark, hot)
    rows = docs.select("doc_id", text_of(docs).alias("text"))
    if least:
        rows = _with_rare(rows, table.filter(F.col("n") < least), hot, tokenizer)

    def coded(batches):
        import numpy as np

        codec = _codec(hot, tokenizer)
        for batch in batches:
            for part in in_bytes(batch, BATCH_BYTES):
                split = Split(part.column("text"))
                word, begin, (ids, _) = split.at, split.begin, codec.ids_of(split.words)
                if least:
                    ids, word = _filled(ids, word, begin, part.column("rare").to_pylist())
                ids = ids.take(pa.array(word))
                at = np.append(0, np.cumsum(np.diff(ids.offsets.to_numpy())))[begin]
                ids = ids.flatten()
                number, text = codec.numbers.take(ids), codec.pieces.take(ids)
                digests = [_each(joined, at) for joined in (number, text)]
                columns = [part.column("doc_id"), pa.array(np.diff(at)), *(pa.array([hashlib.sha256(x).hexdigest() for x in d], pa.string()) for d in digests)]
                if whole:
                    columns += [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), ids), pa.array([bytes(x).decode() for x in digests[1]], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(columns)])

    extra = {"ids": "array<int>", "decoded": "string"} if whole else {}
    return rows.mapInArrow(coded, schema_of(doc_id=docs.schema["doc_id"].dataType, n_tokens="long", ids_sha256="string", decoded_sha256="string", **extra))


def _each(joined, at) -> list:
    """The bytes of each text's values, which stand one after another, without the last space."""
    import numpy as np

    ends = np.frombuffer(joined.buffers()[1], np.int32, len(joined) + 1)[at].tolist()
    data = memoryview(joined.buffers()[2] or b"")
    return [data[a : max(a, b - 1)] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _filled(ids, word, begin, rare: list):
    """ids (of the distinct words) and word (at each place) with the rare words' ids added, which stand as (at, ids)."""
    word = word.copy()
    extra = []
    for first, holes in zip(begin[:-1].tolist(), rare, strict=True):
        for hole in holes or ():
            word[first + hole["at"]] = len(ids) + len(extra)
            extra.append(hole["ids"])
    return pa.concat_arrays([ids, pa.array(extra, pa.list_(pa.int32()))]).cast(ids.type), word


def _with_rare(rows: DataFrame, rare: DataFrame, hot, tokenizer: str) -> DataFrame:
    """rows with the ids of the words that the broadcast table lacks, joined by word and brought back by position."""
    keyed = rows.withColumn("key", row_key(rows["doc_id"], rows["text"]))

    def holes(batches):
        import numpy as np

        codec = _codec(hot, tokenizer)
        for batch in batches:
            for part in in_bytes(batch, BATCH_BYTES):
                split = Split(part.column("text"))
                at = np.flatnonzero(codec.ids_of(split.words)[1][split.at])
                row = np.searchsorted(split.begin, at, side="right") - 1
                yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(row)), pa.array((at - split.begin[row]).astype(np.int32)), split.words.take(pa.array(split.at[at]))], names=["key", "at", "word"])

    lacking = keyed.select("key", "text").mapInArrow(holes, "key long, at int, word string")
    filled = lacking.join(rare.select("word", "ids"), "word").groupBy("key").agg(F.collect_set(F.struct("at", "ids")).alias("rare"))
    return keyed.join(filled, "key", "left").drop("key")
