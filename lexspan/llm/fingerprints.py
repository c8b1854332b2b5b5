"""Document fingerprints from closed syncmers, in DataFrame functions only.

Units are pieces of at most PIECE code points, cut from the start of each word (runs between white space), at every
length of text. The k-mers are five units long; a k-mer is chosen (a closed syncmer) if the smallest of its four inner
2-unit hashes is the first or the last one. The choice depends on the k-mer alone, so equal passages give equal anchors
wherever they stand. A text's fingerprint is the sorted set of the SKETCH smallest syncmer hashes (40 bits each, as 10 hex
digits); likeness is the bottom-k estimate of the sets' Jaccard similarity, whose standard error is
sqrt(J (1 - J) / SKETCH): 0.0625 at most, and none where both texts have at most SKETCH syncmers together. anchors() gives
all syncmers with their positions.

Defined cases: null texts count as empty; an empty text has the empty fingerprint; a text without syncmers (under some 20
code points) has its units' hashes, one without units the hash of the whole text; likeness is 1.0 of two empty
fingerprints and 0.0 of one; the last document's next one is the first (a single document's is itself); null doc_ids come
first, rows of one doc_id are ordered by their texts' hash; every input row gives one row; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .common import partitions, text_of

SKETCH = 64
PIECE = 3
K = 5
MOST_RANGES = 1 << 16
SAMPLED_A_RANGE = 8


def _bound(value: Column, use) -> Column:
    """use(value), value being computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _chosen(units: Column) -> Column:
    """The hash of each unit's k-mer where that is a closed syncmer, else null."""

    def of_hashes(h: Column) -> Column:
        inner = F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + 1)))
        return _bound(inner, lambda t: F.transform(t, lambda x, i: F.when(_closed(x, t, i) & (i <= F.size(t) - K), F.xxhash64(x, F.get(t, i + 2), F.get(h, i + 4)))))

    return _bound(F.transform(units, lambda u: F.xxhash64(u)), of_hashes)


def _closed(x: Column, t: Column, i: Column) -> Column:
    b, c, d = F.get(t, i + 1), F.get(t, i + 2), F.get(t, i + 3)
    return ((x <= b) & (x <= c) & (x <= d)) | ((d <= x) & (d <= b) & (d <= c))


def _units(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"[^ \\t\\n\\r]{{1,{PIECE}}}"), F.lit(0))


def _cut(hashes: Column) -> Column:
    """The SKETCH smallest of the hashes' upper 40 bits."""
    return F.slice(F.array_sort(F.array_distinct(F.transform(hashes, lambda x: F.shiftrightunsigned(x, 24)))), 1, SKETCH)


def sketch(text: Column) -> Column:
    """array<long>: a text's fingerprint."""

    def of_units(units: Column) -> Column:
        found = _cut(F.filter(_chosen(units), lambda x: x.isNotNull()))
        return _bound(found, lambda s: F.when(F.size(s) > 0, s).otherwise(_cut(F.transform(units, lambda u: F.xxhash64(u)))))

    whole = F.when(text == "", F.array().cast("array<bigint>")).otherwise(F.array(F.shiftrightunsigned(F.xxhash64(text), 24)))
    return _bound(_bound(_units(text), of_units), lambda s: F.when(F.size(s) > 0, s).otherwise(whole))


def written_out(s: Column) -> Column:
    return F.lower(F.array_join(F.transform(s, lambda x: F.lpad(F.hex(x), 10, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two sketches."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, SKETCH)
    shared = F.array_intersect(F.array_intersect(union, a), b)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.size(shared) / F.greatest(F.size(union), F.lit(1)))


def anchors(docs: DataFrame) -> DataFrame:
    """(doc_id, position, hash) of every syncmer of docs(doc_id, text), position counting units: context-free anchors for
    matching passages."""
    found = docs.select("doc_id", F.posexplode(_chosen(_units(text_of(docs)))).alias("position", "hash"))
    return found.filter("hash is not null")


def _range(rows: DataFrame) -> Column:
    """The range of a row in the order of (doc_id, tie), by cuts from a sample; ranges only deal the work.

    The sample takes keys by their hash, each once, so it is bounded at any size and with any repeated key; the rows of one
    doc_id (null as well) are dealt by tie. The cuts are looked up in two steps: among every 256th, then in that block.
    """
    n = min(MOST_RANGES, 4 * partitions(rows.sparkSession))
    share = min(1.0, SAMPLED_A_RANGE * n / max(1, rows.count()))
    key = F.xxhash64(F.lit(1), "doc_id", "tie")
    keys = rows.select("doc_id", "tie").filter(F.abs(key / float(1 << 63)) <= share).distinct().collect()
    keys = sorted((r["doc_id"] is not None, r["doc_id"], r["tie"]) if r["doc_id"] is not None else (False, 0, r["tie"]) for r in keys)
    cuts = keys[:: max(1, len(keys) // n)][1:]
    if not cuts:
        return F.lit(0)
    kind = StructType([StructField("doc_id", rows.schema["doc_id"].dataType), StructField("tie", LongType())])
    cuts = [{"doc_id": x if known else None, "tie": t} for known, x, t in cuts]
    blocks = [cuts[i : i + 256] for i in range(0, len(cuts), 256)]
    table = F.from_json(F.lit(json.dumps(blocks, default=str)), ArrayType(ArrayType(kind)))
    own = F.struct("doc_id", "tie")
    block = F.size(F.filter(table, lambda b: F.get(b, F.lit(0)) <= own)) - 1
    within = F.size(F.filter(F.get(table, block), lambda c: c <= own))
    return F.when(block < 0, 0).otherwise(block * 256 + within)


def _with_next(rows: DataFrame) -> DataFrame:
    """rows(doc_id, text) with sketch, next_text and next_sketch, by ascending doc_id, the first after the last.

    Rows are dealt into ranges of (doc_id, tie), and each range looks ahead by a window of its own. Its last row sees a
    copy of the first row of the next range that has any; that is one borrowed row a range.
    """
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = rows.withColumn("range", _range(rows))
    first = rows.groupBy("range").agg(F.min(F.struct("doc_id", "tie")).alias("first"))
    order = Window.orderBy("range")  # over one short row a range, MOST_RANGES at most
    ahead = first.select(F.lag("range").over(order).alias("to"), F.max("range").over(Window.partitionBy()).alias("last"), "first")
    ahead = ahead.select(F.coalesce("to", "last").alias("to"), F.col("first.doc_id").alias("first_id"), F.col("first.tie").alias("first_tie"))
    borrowed = rows.join(F.broadcast(ahead), F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("tie") == F.col("first_tie")))
    borrowed = borrowed.withColumn("range", F.col("to")).drop("to", "first_id", "first_tie").withColumn("own", F.lit(False))
    both = rows.withColumn("own", F.lit(True)).unionByName(borrowed).withColumn("sketch", sketch(F.col("text")))
    look = Window.partitionBy("range").orderBy(F.desc("own"), F.asc_nulls_first("doc_id"), "tie")
    return both.withColumns({"next_text": F.lead("text").over(look), "next_sketch": F.lead("sketch").over(look)}).filter("own").drop("own", "tie", "range")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row of docs.

    The edited text has the last quarter of its code points (rounded down) replaced by as many of the next document's
    first ones, or all of them.
    """
    text = text_of(docs)
    rows = docs.select("doc_id", text.alias("text"))
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    rows = _with_next(rows).select("doc_id", n.cast("long").alias("n_chars"), "sketch", "next_sketch", F.concat(F.substring("text", F.lit(1), n - quarter), F.substring("next_text", F.lit(1), quarter)).alias("edited"))
    rows = rows.withColumn("edited_sketch", sketch(F.col("edited")))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        written_out(F.col("sketch")).alias("fingerprint"),
        written_out(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
