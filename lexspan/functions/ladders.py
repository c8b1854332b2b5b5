"""The ladders of ceilings: the more evidence, the smaller the share that still counts as a departure."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GLYPH = (5, (10, 2500), (100, 1000), (1000, 300), (10_000, 100), (None, 30))
WORD = (20, (10, 250), (100, 100), (1000, 30), (10_000, 10), (None, 3))


def ceiling(denominator: Column, ladder) -> Column:
    """The ceiling in basis points for a denominator; null below the ladder's floor."""
    floor, *bands = ladder
    out = F.when(denominator < floor, None)
    for top, bp in bands:
        out = out.otherwise(F.lit(bp)) if top is None else out.when(denominator <= top, bp)
    return out


def ceiling_sql(denominator: str, ladder) -> str:
    floor, *bands = ladder
    steps = " ".join(f"ELSE {bp}" if top is None else f"WHEN {denominator} <= {top} THEN {bp}" for top, bp in bands)
    return f"CASE WHEN {denominator} < {floor} THEN NULL {steps} END"


def firing(df, ladder):
    """Rows of df(numerator, denominator) that depart, with share_bp and ceiling_bp."""
    share = F.least(F.lit(10_000), F.expr("(numerator * 10000) div denominator")).cast("long")
    out = df.withColumn("ceiling_bp", ceiling(F.col("denominator"), ladder)).withColumn("share_bp", share)
    return out.filter("ceiling_bp IS NOT NULL AND share_bp < ceiling_bp")
