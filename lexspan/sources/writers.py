"""What a corpus is written as: verse lines, documents in other markups, findings and counts as tables."""

from __future__ import annotations

import io
import json
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..binding import known_to_workers
from ..operators.markers import MARKERS
from ..operators.markup import contents, verse_rows


def verse_line_rows(books: DataFrame) -> DataFrame:
    """(book, chapter, verse, line): 'BOOK C:V<TAB>text', '<range>' on the verses a bridge covers."""
    return verse_rows(books).select("book", "chapter", "verse", F.concat(F.format_string("%s %d:%d\t", "book", "chapter", "verse"), "text").alias("line"))


def write_verse_lines(books: DataFrame, path: str) -> None:
    """One text file a book, lines in order."""
    rows = verse_line_rows(books).repartition("book").sortWithinPartitions("book", "chapter", "verse")
    rows.select("book", "line").write.partitionBy("book").text(path)


def write_findings(found: DataFrame, path: str, *order: str) -> None:
    """Findings as Parquet, a folder a corpus, sorted so that row groups can be skipped."""
    found.repartitionByRange("corpus", *order).sortWithinPartitions("corpus", *order).write.partitionBy("corpus").parquet(path)


def _escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _pieces(books: DataFrame) -> DataFrame:
    """(book, pos, what, marker, text): chapters, paragraph starts, verses, character spans' starts and ends, and texts."""
    c = contents(books).filter("kind <> 'Newline'")
    kind = F.create_map(*[F.lit(x) for kv in MARKERS.items() for x in kv])
    opened = kind[F.col("opens")]
    number = F.regexp_extract("text", r"^(\S+)", 1)
    rest = F.regexp_replace("text", r"^\S+[ ]?", "")
    own = F.when(F.col("kind") == "Text", F.when(opened.isin("chapter", "verse"), opened).otherwise("text")).when(F.col("kind") == "ClosingMarker", "close").when(F.col("kind") == "Marker", F.when(kind[F.col("marker")].isin("chapter", "verse", "notechar"), None).when(kind[F.col("marker")].isin("char", "note"), "open").otherwise("para"))
    rows = c.withColumn("what", own).filter("what IS NOT NULL")
    return rows.select("book", "pos", "what", F.coalesce("marker", "opens").alias("marker"), F.when(F.col("what").isin("chapter", "verse"), number).alias("number"), F.when(F.col("what").isin("chapter", "verse"), rest).when(F.col("what") == "text", F.col("text")).otherwise("").alias("text"))


def _joined(pieces: DataFrame, piece: Column, head: str, tail: str, name: str) -> DataFrame:
    body = pieces.select("book", "pos", piece.alias("x")).groupBy("book").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]), "").alias("body"))
    return body.select("book", F.concat(F.lit(head), "body", F.lit(tail)).alias(name))


def html(books: DataFrame) -> DataFrame:
    """(book, html): paragraphs as elements of their marker's class, chapter and verse numbers as superscripts."""
    c = F.col
    start = lambda tag: F.concat(F.lit(f"<{tag} class=\""), c("marker"), F.lit('">'))
    piece = F.when(c("what") == "para", start("p")).when(c("what") == "open", start("span")).when(c("what") == "close", "</span>").when(c("what") == "chapter", F.concat(F.lit("<h2>"), "number", F.lit("</h2>"), _escaped(c("text")))).when(c("what") == "verse", F.concat(F.lit("<sup>"), "number", F.lit("</sup>"), _escaped(c("text")))).otherwise(_escaped(c("text")))
    return _joined(_pieces(books), piece, '<article lang="und">', "</article>", "html")


def usx(books: DataFrame) -> DataFrame:
    """(book, usx): chapters and verses as milestones, paragraphs and spans as elements; ends follow from the nesting."""
    p = _pieces(books)
    c = F.col
    from pyspark.sql import Window

    w = Window.partitionBy("book").orderBy("pos")
    p = p.withColumn("nth", F.sum((c("what") == "para").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = Window.partitionBy("book", "nth").orderBy("pos")
    # a closing marker without an open span gives nothing: it is one that takes the running sum to a new low
    p = p.withColumn("level", F.sum(F.when(c("what") == "open", 1).when(c("what") == "close", -1).otherwise(0)).over(spans.rowsBetween(Window.unboundedPreceding, 0)))
    p = p.withColumn("low", F.least(F.lit(0), F.min("level").over(spans.rowsBetween(Window.unboundedPreceding, 0))))
    p = p.withColumn("stray", (c("what") == "close") & (c("low") < F.coalesce(F.lag("low").over(spans), F.lit(0))))
    p = p.withColumn("open_spans", c("level") - c("low")).withColumn("last", F.lead("what").over(spans).isNull())
    shut = F.when(c("last"), F.concat(F.repeat(F.lit("</char>"), c("open_spans").cast("int")), F.when(c("nth") > 0, "</para>").otherwise(""))).otherwise("")
    mark = lambda tag: F.concat(F.lit(f'<{tag} number="'), _escaped(c("number")), F.lit(f'" style="{tag[0]}"/>'), _escaped(c("text")))
    piece = F.when(c("what") == "para", F.concat(F.lit('<para style="'), "marker", F.lit('">'))).when(c("what") == "open", F.concat(F.lit('<char style="'), "marker", F.lit('">'))).when(c("stray"), "").when(c("what") == "close", "</char>").when(c("what") == "chapter", mark("chapter")).when(c("what") == "verse", mark("verse")).otherwise(_escaped(c("text")))
    return _joined(p, F.concat(piece, shut), '<usx version="3.0">', "</usx>", "usx")


def usj(books: DataFrame) -> DataFrame:
    """(book, usj): JSON of the same content, a flat list of chapters, paragraphs, verses, spans and texts in order (lossy)."""
    p = _pieces(books)
    one = F.struct("pos", F.col("what").alias("type"), "marker", "number", F.nullif("text", F.lit("")).alias("text"))
    every = p.groupBy("book").agg(F.sort_array(F.collect_list(one)).alias("all"))
    item = F.transform("all", lambda s: F.struct(s["type"].alias("type"), s["marker"].alias("marker"), s["number"].alias("number"), s["text"].alias("text")))
    return every.select("book", F.to_json(F.struct(F.lit("USJ").alias("type"), F.lit("3.1").alias("version"), item.alias("content"))).alias("usj"))


def manifest(files: DataFrame) -> DataFrame:
    """(unit, json) of files(unit, name, content): a manifest a unit that lists its files by name with size and checksum, as
    checks.ingredients() compares them."""
    one = F.struct("name", F.octet_length("content").cast("long").alias("size"), F.md5("content").alias("md5"))
    return files.groupBy("unit").agg(F.to_json(F.struct(F.sort_array(F.collect_list(one)).alias("ingredients"))).alias("json"))


def manifest_with(docs: DataFrame, fields: dict[str, str]) -> DataFrame:
    """(path, json): manifests (path, doc variant) with top-level fields set to texts; other fields stay as they are."""
    table = F.coalesce(F.try_variant_get("doc", F.lit("$"), "map<string, variant>"), F.create_map().cast("map<string, variant>"))
    put = F.map_from_entries(F.array(*[F.struct(F.lit(k).alias("key"), F.parse_json(F.lit(json.dumps(v))).alias("value")) for k, v in fields.items()]))
    return docs.select("path", F.to_json(F.map_concat(F.map_filter(table, lambda k, v: ~k.isin(*fields)), put)).alias("json"))


def html_report(lines: DataFrame, snippets: DataFrame) -> DataFrame:
    """(corpus, html): one page a corpus, of listed patterns(corpus, place, line) and snippets(corpus, headline, .., snippet)."""
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    rows = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(c)), lambda x: F.concat(F.lit("<li>"), x["line"], F.lit("</li>"))), "")
    a = lines.groupBy("corpus").agg(rows(F.struct("place", safe(F.col("line")).alias("line"))).alias("patterns"))
    shown = F.concat("headline", F.lit(" "), "book", F.lit(" "), "chapter", F.lit(": "), safe(F.regexp_replace("snippet", r"\s+", " ")))
    b = snippets.groupBy("corpus").agg(rows(F.struct("headline", "book", "chapter", "at", shown.alias("line"))).alias("sites"))
    both = a.join(b, "corpus", "left")
    page = F.concat(F.lit("<html><head><title>"), safe(F.col("corpus")), F.lit("</title></head><body><ol>"), "patterns", F.lit("</ol><ul>"), F.coalesce("sites", F.lit("")), F.lit("</ul></body></html>"))
    return both.select("corpus", page.alias("html"))


_DOCX = {
    "[Content_Types].xml": '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
    "_rels/.rels": '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
}


def docx(books: DataFrame) -> DataFrame:
    """(book, content): word-processor files of the books: paragraphs in a style named by their marker, chapters as paragraphs
    of their number alone, verse numbers raised. The XML is put together in the engine, the container in Arrow batches."""
    c = F.col
    known_to_workers(books.sparkSession)
    safe = F.regexp_replace(_escaped(c("text")), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    run = lambda t: F.concat(F.lit('<w:r><w:t xml:space="preserve">'), t, F.lit("</w:t></w:r>"))
    raised = F.concat(F.lit('<w:r><w:rPr><w:vertAlign w:val="superscript"/></w:rPr><w:t xml:space="preserve">'), _escaped(c("number")), F.lit("</w:t></w:r>"))
    start = lambda style: F.concat(F.lit('</w:p><w:p><w:pPr><w:pStyle w:val="'), style, F.lit('"/></w:pPr>'))
    piece = F.when(c("what") == "para", start(c("marker"))).when(c("what") == "chapter", F.concat(start(F.lit("c")), run(_escaped(c("number"))))).when(c("what") == "verse", F.concat(raised, run(safe))).when(c("what") == "text", run(safe)).otherwise("")
    head = '<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p>'
    body = _joined(_pieces(books), piece, head, "</w:p></w:body></w:document>", "xml")

    def packed(batches):
        for batch in batches:
            files = []
            for xml in batch.column("xml").to_pylist():
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                    for name, text in (*_DOCX.items(), ("word/document.xml", xml)):
                        z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), text, zipfile.ZIP_DEFLATED)  # no clock: equal books give equal files
                files.append(out.getvalue())
            yield pa.RecordBatch.from_arrays([batch.column("book"), pa.array(files, pa.binary())], names=["book", "content"])

    return body.mapInArrow(packed, "book string, content binary")
