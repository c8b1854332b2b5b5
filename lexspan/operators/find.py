"""Literal search with offsets, the places hits fall in, and offsets in other units.

Texts are cut at the needle where they are read; only the lengths of the cuts travel, so that a running sum gives each
hit's place. Offsets are code points from 0.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CORE, JOIN, LETTER, fold


def hits(texts: DataFrame, needle: str, fold_case: bool = False, whole_word: bool = False, most: int | None = None) -> DataFrame:
    """(id, start, end) of every non-overlapping place of `needle` in texts(id, text), leftmost first; none of an empty needle.

    fold_case compares single-character lower case. whole_word wants no letter, mark or digit on either side, nor a
    joiner between letters; a refused place does not hide a later one (needles that overlap themselves apart). most: only
    the first hits in the order of ids and places, each partition keeping no more than those.
    """
    if not needle:
        return texts.select("id", F.lit(0).alias("start"), F.lit(0).alias("end")).filter("false")
    n = len(needle)
    hay = fold(F.col("text")) if fold_case else F.col("text")
    wanted = "".join("i" if c == "İ" else c.lower()[0] for c in needle) if fold_case else needle
    parts = texts.select("id", F.split(hay, re.escape(wanted), -1).alias("parts")).filter("size(parts) > 1")
    p = F.col("parts")
    cut = F.transform(p, lambda x, i: F.struct(i.alias("i"), F.char_length(x).alias("len"), F.right(x, F.lit(2)).alias("before"), F.left(F.coalesce(F.get(p, i + 1), F.lit("")), F.lit(2)).alias("after")))
    rows = parts.select("id", (F.size("parts") - 1).alias("n"), F.inline(cut))
    order = Window.partitionBy("id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("start", F.sum("len").over(order) + F.col("i") * n).filter("i < n")
    if whole_word:
        edge = lambda c: re.match(r"[^\W\d_]", c) is not None
        left = F.col("before").rlike(f"{CORE}\\z") | (F.col("before").rlike(f"{LETTER}{JOIN}\\z") & F.lit(edge(needle[0])))
        right = F.col("after").rlike(f"^{CORE}") | (F.col("after").rlike(f"^{JOIN}{LETTER}") & F.lit(edge(needle[-1])))
        found = found.filter(~left & ~right)
    found = found.select("id", F.col("start").cast("int").alias("start"), (F.col("start") + n).cast("int").alias("end"))
    return found if most is None else found.orderBy("id", "start").limit(most)


def located(offsets: DataFrame, tiles: DataFrame) -> DataFrame:
    """offsets(id, start, ..) with the tile they fall in: the last of tiles(id, tile, tile_start) that starts at or before.

    An as-of join without a range join: both sides are one sorted run an id, and each offset takes the last tile seen.
    """
    rest = [c for c in offsets.columns if c not in ("id", "start")]
    a = offsets.select("id", "start", F.lit(1).alias("kind"), F.lit(None).cast(tiles.schema["tile"].dataType).alias("tile"), *rest)
    b = tiles.select("id", F.col("tile_start").alias("start"), F.lit(0).alias("kind"), "tile", *[F.lit(None).cast(offsets.schema[c].dataType).alias(c) for c in rest])
    order = Window.partitionBy("id").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn("tile", F.last("tile", True).over(order)).filter("kind = 1").drop("kind")


def lines(texts: DataFrame) -> DataFrame:
    """(id, tile, tile_start): the lines of texts(id, text), numbered from 1."""
    each = texts.select("id", F.posexplode(F.transform(F.split("text", "\n"), lambda x: F.char_length(x))).alias("i", "len"))
    order = Window.partitionBy("id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return each.select("id", (F.col("i") + 1).alias("tile"), (F.sum("len").over(order) - F.col("len") + F.col("i")).cast("int").alias("tile_start"))


def utf8_offset(text: Column, point: Column) -> Column:
    """The byte offset of a code point offset."""
    return F.octet_length(F.substring(text, F.lit(1), point))


def utf16_offset(text: Column, point: Column) -> Column:
    """The UTF-16 offset of a code point offset."""
    return point + F.char_length(F.regexp_replace(F.substring(text, F.lit(1), point), "[^\\x{10000}-\\x{10FFFF}]", ""))


def pieces(spans: DataFrame, kept: DataFrame) -> DataFrame:
    """(id, start, end, pieces) of spans(id, start, end) in a projection: the source ranges each covers.

    kept(id, source_from, source_to, kept_from) is a mask: maximal kept ranges and where they fall in the projection. One
    range is a contiguous span, several a split one.
    """
    to = F.col("kept_from") + F.col("source_to") - F.col("source_from")
    met = spans.join(kept, "id").filter((F.col("kept_from") < F.col("end")) & (to > F.col("start")))
    a = F.col("source_from") + F.greatest(F.col("start") - F.col("kept_from"), F.lit(0))
    b = F.col("source_from") + F.least(F.col("end") - F.col("kept_from"), F.col("source_to") - F.col("source_from"))
    return met.groupBy("id", "start", "end").agg(F.sort_array(F.collect_list(F.struct(a.cast("int").alias("from"), b.cast("int").alias("to")))).alias("pieces"))
