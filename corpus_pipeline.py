"""documents -> quality, near duplicates, repeated passages, benchmark leaks, token ids: a corpus fit for training."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lexspan.llm.bpe_codec import encode_digests
from lexspan.llm.common import table, written
from lexspan.llm.decontamination import clean
from lexspan.llm.quality import resampled
from lexspan.llm.queries import WORD_BPE
from lexspan.llm.simhash import first_of_each
from lexspan.llm.suffix_dedup import dedup_texts


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows that importance resampling draws; the labels name the target text."""
    return resampled(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, the groups being those of the operator's contract."""
    return first_of_each(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every repeated 200-byte string out of the texts."""
    return dedup_texts(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold an item of the benchmark."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded texts, as digests."""
    return encode_digests(docs, public_tokenizers.path(WORD_BPE))


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_dedup),
    ("suffix-array dedup", passage_dedup),
    ("benchmark decontamination", decontaminate),
    ("BPE encoding and decoding", encode),
]

#: Neither hashing, nor byte-wise suffixes, nor BPE are within SQL's reach.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each to what the one before it has written."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs, _ = written(spark, docs, f"stage-{number}")
    return docs
