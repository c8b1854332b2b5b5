"""Counts that follow a stream of books: only changed books are counted again, and the judged rows are those of a cold run.

The state is a table of per-book counts, dealt over BUCKETS by the hash of a book, in versions: a version holds the buckets
that its batch touched, whole, and is complete once its writer's marker stands. The state is each bucket's newest version,
so a batch reads and writes what its books share a bucket with, not the corpus. Unchanged books (by digest) are skipped, and
no text is kept. A batch that is delivered twice writes its version again, so a retry changes nothing; what newer complete
versions have replaced is removed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ladders import GLYPH, firing
from ..functions.text import char_class
from ..operators import census

BUCKETS = 256
STATE = "corpus string, book string, digest string, glyph string, side string, class string, n long"


def book_counts(books: DataFrame) -> DataFrame:
    """(corpus, book, digest, glyph, side, class, n) of books(corpus, book, text): marks by the class of their neighbours.

    A book without any mark has one row of nulls, so that its digest is known.
    """
    digest = books.select("corpus", "book", F.sha2("text", 256).alias("digest"))
    t = census.marks(books)
    sides = F.array(*[F.struct(F.lit(s).alias("side"), char_class(F.col(s)).alias("class")) for s in ("before", "after")])
    counts = t.select("corpus", "book", "glyph", "n", F.inline(sides)).groupBy("corpus", "book", "glyph", "side", "class").agg(F.sum("n").alias("n"))
    return digest.join(counts, ["corpus", "book"], "left").select("corpus", "book", "digest", "glyph", "side", "class", "n")


def judged(counts: DataFrame) -> DataFrame:
    """The placement claims of a state of per-book counts; the same rows as judging the texts themselves."""
    c = counts.filter("glyph IS NOT NULL").groupBy("corpus", "glyph", "side", "class").agg(F.sum("n").alias("numerator"), F.countDistinct("book").alias("books"))
    total = F.sum("numerator").over(Window.partitionBy("corpus", "glyph", "side"))
    return firing(c.withColumn("denominator", total).filter("class <> 'Edge'"), GLYPH).select("corpus", "glyph", "side", "class", "books", "numerator", "denominator", "ceiling_bp", "share_bp")


def bucket(buckets: int = BUCKETS):
    return F.pmod(F.xxhash64("corpus", "book"), F.lit(buckets)).cast("int")


class BookState:
    """The counts under a folder of any store Spark writes to."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    def _matching(self, pattern: str) -> list:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{pattern}")
        return [x.getPath() for x in path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path) or []]

    def _versions(self) -> list[int]:
        """The complete versions; buckets of theirs may have been replaced and swept."""
        return sorted(int(p.getParent().getName()) for p in self._matching("*/_SUCCESS"))

    def _held(self, before: int | None) -> dict[int, list[int]]:
        """The complete versions (below `before`) of each bucket, ascending."""
        done = set(self._versions())
        out: dict[int, list[int]] = {}
        for p in self._matching("*/bucket=*"):
            version, number = int(p.getParent().getName()), int(p.getName().partition("=")[2])
            if version in done and (before is None or version < before):
                out.setdefault(number, []).append(version)
        return {k: sorted(v) for k, v in out.items()}

    def current(self, before: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The state as of the newest complete version (below `before`), of some buckets or all; empty at first."""
        paths = [f"{self.folder}/{v[-1]}/bucket={k}" for k, v in sorted(self._held(before).items()) if only is None or k in only]
        reader = self.spark.read.schema(STATE)
        return reader.parquet(*paths).filter("book IS NOT NULL") if paths else self.spark.createDataFrame([], STATE)

    def upsert(self, books: DataFrame, version: int) -> None:
        """Writes version: the touched buckets with the counts of changed books(corpus, book, text) replaced; a null text removes its book.

        Of several texts of one book in a batch the last by (at, text) counts, where there is a column `at`.
        """
        at = F.col("at") if "at" in books.columns else F.lit(0)
        latest = books.groupBy("corpus", "book").agg(F.max_by("text", F.struct(at, F.coalesce("text", F.lit("")))).alias("text"))
        touched = sorted(r[0] for r in books.select(bucket(self.buckets)).distinct().collect())
        old = self.current(version, touched)
        known = old.select("corpus", "book", F.col("digest").alias("known")).distinct()
        moved = latest.join(known, ["corpus", "book"], "left").filter(~F.sha2("text", 256).eqNullSafe(F.col("known"))).select("corpus", "book", "text")
        kept = old.join(moved, ["corpus", "book"], "left_anti")
        rows = kept.unionByName(book_counts(moved.filter("text IS NOT NULL"))).withColumn("bucket", bucket(self.buckets))
        stands = self.spark.createDataFrame([(k,) for k in touched], "bucket int")  # a bucket stands even if its books are gone
        rows = rows.unionByName(stands, allowMissingColumns=True).repartition("bucket")
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/{version}")
        self._sweep(version)

    def _sweep(self, version: int) -> None:
        """Removes what a retry of `version` would not read: buckets that another complete version below it has replaced."""
        conf = self.spark._jsc.hadoopConfiguration()
        for number, versions in self._held(version).items():
            for old in versions[:-1]:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{old}/bucket={number}")
                path.getFileSystem(conf).delete(path, True)


def follow(stream: DataFrame, state: BookState, checkpoint: str, publish: Callable[[DataFrame, int], None] | None = None):
    """A started query that keeps state up to date with a stream of books; publish gets the judged rows of each version."""

    def batch(books: DataFrame, number: int) -> None:
        state.upsert(books, number)
        if publish:
            publish(judged(state.current()), number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def moved_totals(totals: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """(corpus, key, n, holders): totals with some books' counts taken out and others put in, as one signed sum; empty keys go.

    totals(corpus, key, n, holders); removed and added (corpus, book, key, n).
    """
    signed = lambda df, s: df.groupBy("corpus", "key").agg((F.sum("n") * s).alias("n"), (F.count("*") * s).alias("holders"))
    every = totals.select("corpus", "key", "n", "holders").unionByName(signed(removed, -1)).unionByName(signed(added, 1))
    return every.groupBy("corpus", "key").agg(F.sum("n").alias("n"), F.sum("holders").alias("holders")).filter("holders > 0")
