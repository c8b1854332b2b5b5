"""Passes of one's own: what a pass observes in a chapter and how it judges the corpus' totals, run like the built-in ones."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ladders import GLYPH, firing


@dataclass(frozen=True)
class Pass:
    """observe(chapter) gives (corpus, book, slot, key, n): counts of keys that compete in a slot. The rows are added up by
    corpus; a key departs where its share of its slot is below the ladder's ceiling. keep says which departures are told."""

    name: str
    observe: Callable[[DataFrame], DataFrame]
    ladder: tuple = GLYPH
    keep: Callable[[DataFrame], DataFrame] = lambda claims: claims


def run(chapter: DataFrame, *passes: Pass) -> DataFrame:
    """(pass, corpus, slot, key, books, numerator, denominator, ceiling_bp, share_bp): the departures of all passes."""
    out = None
    for p in passes:
        by = p.observe(chapter).groupBy("corpus", "slot", "key").agg(F.sum("n").alias("numerator"), F.countDistinct("book").alias("books"))
        total = F.sum("numerator").over(Window.partitionBy("corpus", "slot"))
        claims = p.keep(firing(by.withColumn("denominator", total), p.ladder))
        one = claims.select(F.lit(p.name).alias("pass"), "corpus", "slot", "key", "books", "numerator", "denominator", "ceiling_bp", "share_bp")
        out = one if out is None else out.unionByName(one)
    return out
