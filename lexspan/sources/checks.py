"""Files against what a manifest says of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ingredients(listed: DataFrame, files: DataFrame) -> DataFrame:
    """(name, problem) of listed(name, size, md5) against files(name, content): missing, unlisted, size or checksum.

    Null sizes and checksums are not compared.
    """
    have = files.select("name", F.octet_length("content").cast("long").alias("have_size"), F.md5("content").alias("have_md5"), F.lit(True).alias("there"))
    both = listed.withColumn("said", F.lit(True)).join(have, "name", "full")
    problem = (
        F.when(F.col("there").isNull(), "missing")
        .when(F.col("said").isNull(), "unlisted")
        .when(F.col("size") != F.col("have_size"), "size")
        .when(F.lower("md5") != F.col("have_md5"), "checksum")
    )
    return both.withColumn("problem", problem).filter("problem IS NOT NULL").select("name", "problem")
