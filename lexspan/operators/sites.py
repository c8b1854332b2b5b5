"""Where the judged claims stand: one row an occurrence, and one a run with its headline and all its reasons.

The claims are few, so they are broadcast (their number is bounded by glyphs x sides x classes x corpora); the texts are
read once more and nothing but sites is shuffled. A claim's sites are as many as its numerator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import char_class
from .census import is_mark

#: finest first: a run's headline is the first channel that has a claim on it
CHANNELS = ("rarity", "exact_neighbor", "placement")


def placement_sites(chapter: DataFrame, claims: DataFrame) -> DataFrame:
    """(corpus, book, chapter, at, glyph, side, class): the characters that placement claims(corpus, glyph, side, class) name."""
    c, n = F.col("chars"), F.size("chars") - 1
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice(c, F.lit(1), n))
    each = F.arrays_zip(F.sequence(F.lit(0), n).alias("at"), before.alias("before"), c.alias("glyph"), F.slice(c, F.lit(2), n).alias("after"))
    rows = chapter.filter("text <> ''").select("corpus", "book", "chapter", F.split("text", "").alias("chars"))
    rows = rows.select("corpus", "book", "chapter", F.inline(each)).toDF("corpus", "book", "chapter", "at", "before", "glyph", "after").filter(is_mark(F.col("glyph")))
    sides = F.array(*[F.struct(F.lit(s).alias("side"), char_class(F.col(s)).alias("class")) for s in ("before", "after")])
    each = rows.select("corpus", "book", "chapter", "at", "glyph", F.inline(sides))
    return each.join(F.broadcast(claims.select("corpus", "glyph", "side", "class")), ["corpus", "glyph", "side", "class"]).select("corpus", "book", "chapter", "at", "glyph", "side", "class")


def rarity_sites(chapter: DataFrame, claims: DataFrame) -> DataFrame:
    """(corpus, book, chapter, at, glyph) of every character that rarity claims(corpus, glyph) name."""
    rows = chapter.select("corpus", "book", "chapter", F.posexplode(F.split("text", "")).alias("at", "glyph"))
    return rows.join(F.broadcast(claims.select("corpus", "glyph")), ["corpus", "glyph"]).select("corpus", "book", "chapter", "at", "glyph")


def reasons(*channels: tuple[str, DataFrame]) -> DataFrame:
    """(corpus, book, chapter, at, headline, reasons): the sites of several channels put together by place."""
    every = None
    for name, sites in channels:
        one = sites.select("corpus", "book", "chapter", "at", F.lit(name).alias("reason")).distinct()
        every = one if every is None else every.union(one)
    rank = F.array_position(F.array(*[F.lit(c) for c in CHANNELS]), F.col("reason"))
    both = every.groupBy("corpus", "book", "chapter", "at").agg(F.sort_array(F.collect_set("reason")).alias("reasons"), F.min(F.struct(rank.alias("r"), "reason"))["reason"].alias("headline"))
    return both.select("corpus", "book", "chapter", "at", "headline", F.array_join("reasons", ",").alias("reasons"))
