"""What was computed once for a key is read, not computed again: chapter observations, pair results, sites.

A store is a folder of generations. A generation holds the rows that were computed in it (`rows`) and the keys that it used
(`used`). Keys are hashes of all that a result depends on, so a stored row is never stale; what is not used for a number of
generations is dropped by a sweep, the oldest first, also where the store is larger than a budget.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def key_of(schema_version: int, *parts: Column) -> Column:
    """A key of 256 bits over the parts (null differs from empty) and the version of what is computed from them."""
    each = [F.coalesce(F.concat(F.lit("="), F.sha2(p.cast("string"), 256)), F.lit("-")) for p in parts]
    return F.sha2(F.concat_ws("|", F.lit(str(schema_version)), *each), 256)


class KeyedStore:
    """Rows(key, ..) under a folder of any store Spark writes to."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _paths(self, what: str) -> dict[int, str]:
        """generation -> folder of its complete rows or used keys."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/*/{what}/_SUCCESS")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path) or []
        own = [str(x.getPath().getParent()) for x in found]
        return {int(p.rstrip("/").split("/")[-2]): p for p in own}

    def rows(self, generation: int | None = None) -> DataFrame | None:
        """All stored rows (of generations below the given one), None of an empty store."""
        paths = [p for g, p in sorted(self._paths("rows").items()) if generation is None or g < generation]
        return self.spark.read.parquet(*paths) if paths else None

    def resolve(self, inputs: DataFrame, compute: Callable[[DataFrame], DataFrame], generation: int) -> DataFrame:
        """compute(inputs) for inputs(key, ..), where only inputs of unknown keys are computed.

        compute gives rows(key, ..), none or several a key. A generation that is run again is written again.
        """
        keys, held = inputs.select("key").distinct(), self.rows(generation)
        seen = self._seen(generation)
        fresh = inputs.dropDuplicates(["key"])
        fresh = fresh if seen is None else fresh.join(seen, "key", "left_anti")
        compute(fresh).write.mode("overwrite").parquet(f"{self.folder}/{generation}/rows")
        keys.write.mode("overwrite").parquet(f"{self.folder}/{generation}/used")
        new = self.spark.read.parquet(f"{self.folder}/{generation}/rows")
        every = new if held is None else held.unionByName(new)
        return every.join(self.spark.read.parquet(f"{self.folder}/{generation}/used"), "key", "left_semi")

    def _seen(self, generation: int) -> DataFrame | None:
        """Keys known before, those without rows too."""
        paths = [p for g, p in sorted(self._paths("used").items()) if g < generation]
        return self.spark.read.parquet(*paths).select("key").distinct() if paths else None

    def sweep(self, generation: int, keep: int = 8, budget: int | None = None) -> None:
        """Rewrites the store as one generation of the rows whose keys were used in the last `keep` generations; with a
        budget of rows, those used latest come first."""
        used = {g: p for g, p in self._paths("used").items() if g > generation - keep}
        last = None
        for g, p in used.items():
            one = self.spark.read.parquet(p).withColumn("last", F.lit(g))
            last = one if last is None else last.unionByName(one)
        rows = self.rows()
        if last is None or rows is None:
            return
        last = last.groupBy("key").agg(F.max("last").alias("last"))
        if budget is not None:
            size = rows.groupBy("key").count().join(last, "key").groupBy("last").agg(F.sum("count").alias("n")).orderBy(F.desc("last")).collect()  # a row a generation
            held, least = 0, generation + 1
            for r in size:
                held += r["n"]
                if held > budget:
                    break
                least = r["last"]
            last = last.filter(F.col("last") >= least)
        target = generation + 1
        rows.join(last.select("key"), "key", "left_semi").write.mode("overwrite").parquet(f"{self.folder}/{target}/rows")
        last.select("key").write.mode("overwrite").parquet(f"{self.folder}/{target}/used")
        conf = self.spark._jsc.hadoopConfiguration()
        for old in {**self._paths("rows"), **self._paths("used")}:
            if old < target:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{old}")
                path.getFileSystem(conf).delete(path, True)
