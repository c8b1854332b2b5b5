"""Connected components of links that are too many for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def local_components(n: int, a, b):
    """Labels (the smallest index reachable) of n nodes under links a[i]-b[i], in numpy arrays."""
    import numpy as np

    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        np.minimum.at(label, before[a], low)
        np.minimum.at(label, before[b], low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
        if (label == before).all():
            break
    return label


def _sign(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that links(a long, b long) name, root the smallest node reachable.

    Alternating large-star and small-star rounds: links only ever move toward smaller nodes, a round needs two
    equi-joins whose map sides pre-aggregate, and each round's links are a table in the shared folder, so neither
    lineage nor the driver holds them. A hub's links are split by the skew join; no round gathers a group in one row.
    """
    spark = links.sparkSession
    edge = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    edge, path = written(spark, edge, "links")
    seen = _sign(edge)
    while seen[0]:
        both = edge.union(edge.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        star = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = star.groupBy("a").agg(F.min("b").alias("m"))
        small = star.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edge, new = written(spark, small.union(low.select("a", F.col("m").alias("b"))).distinct(), "links")
        now = _sign(edge)
        dropped(spark, path)
        path = new
        if now == seen:
            break
        seen = now
    return edge.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edge.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
