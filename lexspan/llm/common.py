"""What the operators of this subpackage share: reading, shared storage, row keys."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache, wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType, _parse_datatype_string

from .. import binding

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def known_to_workers(spark: SparkSession) -> None:
    """Lets workers import this package, and has them give freed memory back to the system rather than keep it."""
    env = spark.sparkContext.environment
    env.setdefault("ARROW_DEFAULT_MEMORY_POOL", "system")
    env.setdefault("MALLOC_ARENA_MAX", "2")
    binding.known_to_workers(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    known_to_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="lexspan-")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir. Where that is unset, local runs get one of their own and
    clusters an error, as no folder of the driver's machine would do."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = _own_folder()
    return named.rstrip("/")


_FILES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # a query's shuffle files are removed as it ends


def written(spark: SparkSession, df: DataFrame, name: str, codec: str = "zstd") -> tuple[DataFrame, str]:
    """Writes df to the shared folder and reads it again: lineage ends, and a lost executor costs nothing already written.

    The shuffles that made the table are not needed then, and their files go as the write ends. Left to itself, Spark
    removes them once the driver's collector finds them unused, which it doesn't while anyone still holds df; the collector
    is asked for what else is unused, such as broadcasts.
    """
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    known_to_workers(spark)
    before = spark.conf.get(_FILES_GO, None)
    spark.conf.set(_FILES_GO, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_FILES_GO)
        else:
            spark.conf.set(_FILES_GO, before)
    del df
    spark._jvm.System.gc()
    return spark.read.schema(schema).parquet(path), path


def dropped(spark: SparkSession, *paths: str) -> None:
    """Deletes intermediate tables once nothing will read them."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


_broadcasts: list = []


def released(spark: SparkSession, *fresh) -> None:
    """Notes an operator's broadcasts; those of the operators before it leave the executors, and what the driver's Python
    no longer needs goes back to the system.

    Only the executors' copies go: what still reads one, gets it from the driver again.
    """
    for old in _broadcasts:
        old.unpersist()
    _broadcasts[:] = fresh
    _trimmed()


def text_of(df: DataFrame) -> Column:
    """The text, null counting as empty."""
    return F.coalesce(df["text"].cast("string"), F.lit(""))


def own_columns(df: DataFrame) -> list[Column]:
    """df's columns, whatever their names hold."""
    return [df["`" + name.replace("`", "``") + "`"] for name in df.columns]


def schema_of(**fields) -> StructType:
    """A schema of the named fields; types by Spark's data types or their SQL names."""
    return StructType([StructField(name, kind if isinstance(kind, DataType) else _parse_datatype_string(kind)) for name, kind in fields.items()])


def row_key(doc_id: Column, text: Column) -> Column:
    """Tells rows apart that share a doc_id (or have none) but differ in text; equal rows get equal results anyway."""
    return F.xxhash64(doc_id, text)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_held: list = [None, None]


def _trimmed() -> None:
    """Gives memory that nothing holds back to the system."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def one_a_worker(make):
    """make(*args), kept until any function so marked is asked for something else.

    A Python worker serves one operator after another; the tables and caches of the one before must not stay beside the
    next one's. What is kept outlives a task, so tasks of one operator share it.
    """

    @wraps(make)
    def get(*args):
        key = (make.__module__, make.__name__, args)
        if _held[0] != key:
            _held[:] = None, None
            _trimmed()
            _held[:] = key, make(*args)
        return _held[1]

    return get


def in_parts(batches, rows: int = 1000):
    """The same rows in smaller batches, so that few texts are Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
