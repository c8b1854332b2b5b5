"""Readers of the text forms a corpus comes in. All go through Spark's own file sources, so any store Spark reads will do."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..binding import known_to_workers


def marked_books(spark: SparkSession, folder: str, corpus: str) -> DataFrame:
    """(corpus, book, path, src) of every .usfm and .sfm file right in a folder; the book is the code of its \\id line."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.{usfm,sfm,USFM,SFM}").select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("src"))
    code = F.upper(F.regexp_extract("src", r"\\id\s+([A-Za-z0-9]{3})", 1))
    return files.select(F.lit(corpus).alias("corpus"), F.nullif(code, F.lit("")).alias("book"), "path", "src")


def verse_lines(spark: SparkSession, path: str) -> DataFrame:
    """(book, chapter, first, last, text) of lines 'BOOK C:V<TAB>text'; lines of '<range>' extend the verse above them.

    Lines that do not read so have null keys: the caller decides about them.
    """
    raw = spark.read.text(path).select(F.col("value"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line")).filter("trim(value) <> ''")
    key = r"^([A-Z0-9]{3}) ([0-9]+):([0-9]+)\t"
    part = lambda k: F.nullif(F.regexp_extract("value", key, k), F.lit(""))
    v = raw.select("file", "line", part(1).alias("book"), part(2).cast("int").alias("chapter"), part(3).cast("int").alias("verse"), F.regexp_replace("value", r"^[^\t]*\t", "").alias("text"))
    order = Window.partitionBy("file", "book", "chapter").orderBy("line")  # lines of one chapter
    v = v.withColumn("unit", F.sum(F.when(F.col("text") == "<range>", 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return v.groupBy("file", "book", "chapter", "unit").agg(F.min("verse").alias("first"), F.max("verse").alias("last"), F.first("text").alias("text"), F.min("line").alias("line")).select("book", "chapter", "first", "last", F.when(F.col("text") != "<range>", F.col("text")).alias("text"))


def chunk_tree(spark: SparkSession, folder: str) -> DataFrame:
    """(chapter, chunk, text) of a project kept as one small file a chunk: NN/MM.txt; titles are chunk 0."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt").select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    part = lambda k: F.regexp_extract("path", r"/([0-9]+|front)/([0-9]+|title)\.txt\z", k)
    number = lambda c: F.when(c.isin("front", "title"), 0).otherwise(c.try_cast("int"))
    return files.filter(part(1) != "").select(number(part(1)).alias("chapter"), number(part(2)).alias("chunk"), "text")


def stitched(chunks: DataFrame, book: str) -> DataFrame:
    """(book, src): chunks(chapter, chunk, text) as one marked-up book, in order; empty chunks are left out."""
    c = chunks.filter("trim(text) <> ''")
    head = F.when(F.row_number().over(Window.partitionBy("chapter").orderBy("chunk")) == 1, F.when(F.col("chapter") > 0, F.concat(F.lit("\\c "), "chapter", F.lit("\n")))).otherwise("")
    piece = F.when(F.col("chapter") == 0, F.concat(F.lit("\\h "), F.trim("text"), F.lit("\n"))).otherwise(F.concat(F.coalesce(head, F.lit("")), F.when(F.col("chunk") == 0, F.concat(F.lit("\\s1 "), F.trim("text"), F.lit("\n"))).otherwise(F.concat(F.lit("\\p\n"), F.trim("text"), F.lit("\n")))))
    body = c.withColumn("piece", piece).agg(F.sort_array(F.collect_list(F.struct("chapter", "chunk", "piece"))).alias("all"))  # one book's chunks
    return body.select(F.lit(book).alias("book"), F.concat(F.lit(f"\\id {book}\n"), F.array_join(F.col("all.piece"), "")).alias("src"))


def manifests(spark: SparkSession, folder: str) -> DataFrame:
    """(path, doc, problem): JSON manifests under a folder as variants; a file that is not JSON has a problem instead."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json").select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("json"))
    doc = F.try_parse_json("json")
    return files.select("path", doc.alias("doc"), F.when(doc.isNull(), "not-json").alias("problem"))


def yaml_manifests(spark: SparkSession, folder: str) -> DataFrame:
    """(path, doc, problem): YAML manifests under a folder as variants, like manifests(); one that can't be read says why."""
    known_to_workers(spark)
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.y*ml").select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("yaml"))

    def read(batches):
        import json

        from .yaml import parse

        for batch in batches:
            docs, problems = [], []
            for text in batch.column("yaml").to_pylist():
                try:
                    docs.append(json.dumps(parse(text), ensure_ascii=False))
                    problems.append(None)
                except ValueError as e:
                    docs.append(None)
                    problems.append(f"not-yaml: {e}")
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(docs, pa.string()), pa.array(problems, pa.string())], names=["path", "json", "problem"])

    return files.mapInArrow(read, "path string, json string, problem string").select("path", F.try_parse_json("json").alias("doc"), "problem")


def manifest_fields(docs: DataFrame, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """(path, field.., problems): fields = {name: (JSON path, type)}; a missing or ill-typed field is null and named in problems."""
    got = {n: F.try_variant_get("doc", p, t) for n, (p, t) in fields.items()}
    problems = F.array_compact(F.array(*[F.when(c.isNull(), F.when(F.try_variant_get("doc", fields[n][0], "string").isNull(), f"missing {n}").otherwise(f"not {fields[n][1]}: {n}")) for n, c in got.items()]))
    return docs.select("path", *[c.alias(n) for n, c in got.items()], problems.alias("problems"))


def schemes(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Counts and mapping rows of .vrs files, the scheme named by the file: 'GEN 1:31 2:25' and 'GEN 31:55 = GEN 32:1'.

    A mapping of two ranges of one length is Parallel; many to one is a Merge, one to many a Split.
    """
    lines = spark.read.text(folder, pathGlobFilter="*.vrs").select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*)\.vrs\z", 1).alias("scheme"), F.trim("value").alias("line"))
    plain = lines.filter(~F.col("line").startswith("#") & ~F.col("line").startswith("-"))
    each = plain.filter(F.col("line").rlike(r"^[A-Z0-9]{3} [0-9]+:[0-9]+( |\z)") & ~F.col("line").contains("=")).select("scheme", F.substring("line", 1, 3).alias("book"), F.explode(F.split(F.expr("substring(line, 5)"), " +")).alias("x"))
    counts = each.select("scheme", "book", F.split("x", ":")[0].cast("int").alias("chapter"), F.split("x", ":")[1].cast("int").alias("last"))
    pat = r"^([A-Z0-9]{3}) ([0-9]+):([0-9]+)(?:-([0-9]+))?\s*=\s*([A-Z0-9]{3}) ([0-9]+):([0-9]+)([a-z])?(?:-([0-9]+))?\s*\z"
    g = lambda k: F.nullif(F.regexp_extract("line", pat, k), F.lit(""))
    m = plain.filter(F.col("line").rlike(pat)).select("scheme", g(1).alias("from_book"), g(2).cast("int").alias("from_chapter"), g(3).cast("int").alias("from_verse"), g(5).alias("to_book"), g(6).cast("int").alias("to_chapter"), g(7).cast("int").alias("to_verse"), g(8).alias("to_part"), (F.coalesce(g(4), g(3)).cast("int") - g(3).cast("int") + 1).alias("n"), (F.coalesce(g(9), g(7)).cast("int") - g(7).cast("int") + 1).alias("k"))
    shape = F.when(F.col("n") == F.col("k"), "Parallel").when(F.col("k") == 1, "Merge").when(F.col("n") == 1, "Split")
    return counts, m.withColumn("shape", shape).withColumn("len", F.greatest("n", "k")).filter("shape IS NOT NULL").drop("n", "k")


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_O = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"


def _paragraphs(blob: bytes) -> list[tuple[str, str]]:
    """(style, text) of the paragraphs of a .docx or .odt file's body."""
    with zipfile.ZipFile(io.BytesIO(blob)) as z:
        names = z.namelist()
        root = ElementTree.fromstring(z.read("word/document.xml" if "word/document.xml" in names else "content.xml"))
    out = []
    for p in root.iter():
        if p.tag == f"{_W}p":
            style = p.find(f"{_W}pPr/{_W}pStyle")
            text = "".join(t.text or "" if t.tag == f"{_W}t" else "\t" if t.tag == f"{_W}tab" else "\n" for t in p.iter() if t.tag in (f"{_W}t", f"{_W}tab", f"{_W}br"))
            out.append((style.get(f"{_W}val", "") if style is not None else "", text))
        elif p.tag in (f"{_O}p", f"{_O}h"):
            out.append((p.get(f"{_O}style-name", ""), "".join(p.itertext())))
    return out


def document_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """(path, at, style, text) of the paragraphs of word-processor files; an unreadable file is one row of at -1 that says why."""
    known_to_workers(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{docx,odt}").load(folder).select("path", "content")

    def read(batches):
        for batch in batches:
            rows = []
            for path, blob in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    rows += [(path, i, s, t) for i, (s, t) in enumerate(_paragraphs(blob))]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                    rows.append((path, -1, type(e).__name__, str(e)))
            a, b, c, d = zip(*rows, strict=True) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.int32()), pa.array(c, pa.string()), pa.array(d, pa.string())], names=["path", "at", "style", "text"])

    return files.mapInArrow(read, "path string, at int, style string, text string")


def guessed_markup(paragraphs: DataFrame) -> DataFrame:
    """(path, src): word-processor paragraphs as markup: heading styles become headings, a number alone a chapter, numbers that lead text verses."""
    t = F.trim("text")
    piece = (
        F.when(t == "", "")
        .when(F.lower("style").rlike("^(heading|title|titre|überschrift)"), F.concat(F.lit("\\s1 "), t, F.lit("\n")))
        .when(t.rlike(r"^[0-9]{1,3}\z"), F.concat(F.lit("\\c "), t, F.lit("\n")))
        .otherwise(F.concat(F.lit("\\p\n"), F.regexp_replace(t, r"(?:^|(?<=[.!?”»] ))([0-9]{1,3}) (?=\p{L}|[“«\"])", "\\\\v $1 "), F.lit("\n")))
    )
    rows = paragraphs.filter("at >= 0").withColumn("piece", piece)
    return rows.groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"]), "").alias("src"))
