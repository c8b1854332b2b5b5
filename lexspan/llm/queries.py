"""The registered queries of this subpackage: production parameters over whole tables, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .bpe_codec import encode_digests
from .common import table
from .decontamination import leaks
from .fingerprints import fingerprint_edits
from .license_scan import license_scan
from .license_scan import oracle as license_oracle
from .quality import selection
from .simhash import near_duplicates
from .suffix_dedup import dedup_digests
from .token_counts import token_counts
from .token_store import token_store
from .toxicity import toxicity

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def op1_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_digests(table(spark, sf_dir, "documents"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_resampling": op1_quality_resampling,
    "op2_token_counts": op2_token_counts,
    "op3_toxicity": op3_toxicity,
    "op4_license_scan": op4_license_scan,
    "op5_bpe_codec": op5_bpe_codec,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_token_store": op8_token_store,
    "op9_document_fingerprints": op9_document_fingerprints,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
}

ORACLES: dict[str, str] = {
    "op4_license_scan": license_oracle(),
}
