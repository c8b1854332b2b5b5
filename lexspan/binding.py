"""The neutral input tables (corpus, book, chapter, verse) from the driver's tables, and their validation."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def known_to_workers(spark: SparkSession) -> None:
    """Lets Python workers import this package where it is not installed: its folder goes on their path."""
    env, own = spark.sparkContext.environment, str(Path(__file__).resolve().parents[1])
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if own not in paths:
        env["PYTHONPATH"] = os.pathsep.join([own, *filter(None, paths)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    known_to_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(corpus, book, chapter, text): lang, source and document."""
    return table(spark, sf_dir, "documents").select(F.col("lang").alias("corpus"), F.col("source").alias("book"), F.col("doc_id").alias("chapter"), "text")


def verses(chapter: DataFrame) -> DataFrame:
    """(corpus, book, chapter, verse, text): lines numbered from 1."""
    return chapter.select("corpus", "book", "chapter", F.posexplode(F.split("text", "\n")).alias("at", "text")).select("corpus", "book", "chapter", (F.col("at") + 1).alias("verse"), "text")


CHAPTERS_SQL = "SELECT lang AS corpus, source AS book, doc_id AS chapter, text FROM documents"
VERSES_SQL = f"SELECT corpus, book, chapter, unnest(range(1, len(string_split(text, chr(10))) + 1))::int AS verse, unnest(string_split(text, chr(10))) AS text FROM ({CHAPTERS_SQL})"


def violations(verse: DataFrame) -> DataFrame:
    """(kind, n) of rows that break the input's invariants: null keys, verses below 1, repeated or unordered keys."""
    key = ["corpus", "book", "chapter", "verse"]
    lone = verse.select(F.explode(F.array(
        F.when(F.col("corpus").isNull() | F.col("book").isNull() | F.col("chapter").isNull(), "null key"),
        F.when(F.col("verse") < 1, "verse below 1"),
        F.when(F.col("text").isNull(), "null text"),
    )).alias("kind")).filter("kind IS NOT NULL")
    twice = verse.groupBy(*key).count().filter("count > 1").select(F.lit("repeated key").alias("kind"))
    return lone.union(twice).groupBy("kind").agg(F.count("*").alias("n"))


def ordinal(df: DataFrame, keys: list[str], order: list[str], name: str = "ordinal") -> DataFrame:
    """Numbers the occurrences of equal keys from 1, so that duplicates pair in order."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
