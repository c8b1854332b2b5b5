"""Marked-up books: tokens, designators, contents, masks, verse rows, lint. A book is (book, src).

Tokens come from one regular expression, so their texts joined are the source again, and offsets are running sums over
one book's own tokens, on the partitioning that all later steps over books use too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .markers import MARKERS, of_kind

TOKEN = "\\\\\\+?[a-z]+[0-9]*\\*|\\\\\\+?[a-z]+[0-9]*(?:-[se])?[ ]?|\\r?\\n|[^\\\\\\r\\n]+|\\\\|\\r"


def tokens(books: DataFrame, cut: Callable[[Column], Column] | None = None) -> DataFrame:
    """(book, pos, start, len, kind, marker, text): a partition of the source; start and len in code points.

    cut makes of a token's text what its reader needs of it, before the tokens are put in order: texts are most of a book.
    """
    rows = books.select("book", F.posexplode(F.regexp_extract_all("src", F.lit(TOKEN), F.lit(0))).alias("pos", "text"))
    so_far = Window.partitionBy("book").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    text = F.col("text")
    marker = F.regexp_extract(text, r"^\\\+?([a-z]+[0-9]*)", 1)
    kind = F.when(text.rlike(r"^\r?\n$"), "Newline").when(text.rlike(r"^\\\+?[a-z]+[0-9]*\*$"), "ClosingMarker").when(text.rlike(r"^\\\+?[a-z]"), "Marker").when(text.rlike("^[ \t]+$"), "Pad").otherwise("Text")
    rows = rows.select("book", "pos", F.char_length(text).alias("len"), kind.alias("kind"), F.when(marker != "", marker).alias("marker"), (cut(text) if cut else text).alias("text"))
    return rows.select("book", "pos", (F.sum("len").over(so_far) - F.col("len")).cast("int").alias("start"), "len", "kind", "marker", "text")


def to_first_word(text: Column) -> Column:
    """A token's text as far as the end of its first word."""
    return F.regexp_extract(text, r"^\s*\S*", 0)


def designator_members(df: DataFrame, column: str = "designator") -> DataFrame:
    """df with part, first, last of each member of a designator such as 1-3,5; first and last null of a malformed one."""
    ok = F.col(column).rlike(r"^[1-9][0-9]*[a-z]?(-[1-9][0-9]*[a-z]?)?(,[1-9][0-9]*[a-z]?(-[1-9][0-9]*[a-z]?)?)*$")
    out = df.withColumn("part", F.explode(F.when(ok, F.split(column, ",")).otherwise(F.array(F.col(column)))))
    ends = F.split("part", "-")
    number = lambda c: F.regexp_extract(c, "^([0-9]+)", 1).cast("int")
    return out.withColumn("first", F.when(ok, number(ends[0]))).withColumn("last", F.when(ok, number(F.element_at(ends, -1))))


def contents(books: DataFrame, cut: Callable[[Column], Column] | None = None) -> DataFrame:
    """Tokens with the chapter, verse and heading they stand in: (book, pos, start, kind, marker, text, chapter, verse, heading, opens).

    The verse is the designator as written; a heading or title closes the running text until the next paragraph or verse.
    Windows run over one book. cut is that of tokens().
    """
    t = tokens(books, cut)
    w = Window.partitionBy("book").orderBy("pos")
    head = F.regexp_extract("text", r"^(\S+)", 1)
    t = t.withColumn("opens", F.lag("marker").over(w)).withColumn("after_marker", F.lag("kind").over(w) == "Marker")
    is_c, is_v = F.col("after_marker") & (F.col("opens") == "c"), F.col("after_marker") & (F.col("opens") == "v")
    t = t.withColumn("chapter_here", F.when(is_c, head)).withColumn("verse_here", F.when(is_c | (F.col("marker") == "c"), "").when(is_v, head))
    group = F.when(F.col("kind") == "Marker", F.when(F.col("marker").isin(*of_kind("heading", "title", "intro", "head", "book")), "heading").when(F.col("marker").isin(*of_kind("paragraph", "row", "verse", "chapter")), "text"))
    to_here = w.rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("chapter", F.last("chapter_here", True).over(to_here)).withColumn("verse", F.nullif(F.last("verse_here", True).over(to_here), F.lit(""))).withColumn("heading", F.coalesce(F.last(group, True).over(to_here) == "heading", F.lit(False)))
    return t.drop("chapter_here", "verse_here", "after_marker")


def masked(books: DataFrame) -> DataFrame:
    """(book, at, source_from, source_to, kept_from): maximal kept ranges of the verse texts, and where they fall in the projection.

    Kept are texts inside a verse, outside headings; the designator itself goes. The ranges map both ways.
    """
    c = contents(books).filter("kind = 'Text' AND verse IS NOT NULL AND NOT heading")
    drop = F.when(F.col("opens").isin("v", "c"), F.char_length(F.regexp_extract("text", r"^\S+[ ]?", 0))).otherwise(0)
    kept = c.select("book", (F.col("start") + drop).alias("a"), (F.col("start") + F.char_length("text")).alias("b")).filter("a < b")
    w = Window.partitionBy("book").orderBy("a")
    kept = kept.withColumn("new", F.coalesce((F.col("a") > F.lag("b").over(w)).cast("int"), F.lit(1))).withColumn("island", F.sum("new").over(w))
    r = kept.groupBy("book", "island").agg(F.min("a").alias("source_from"), F.max("b").alias("source_to"))
    before = F.sum(F.col("source_to") - F.col("source_from")).over(w2 := Window.partitionBy("book").orderBy("source_from")) - (F.col("source_to") - F.col("source_from"))
    return r.select("book", F.row_number().over(w2).alias("at"), "source_from", "source_to", before.alias("kept_from"))


def verse_rows(books: DataFrame) -> DataFrame:
    """(book, chapter, verse, text): a row a verse; a bridge has its text once and <range> on the verses it covers."""
    c = contents(books).filter("kind = 'Text' AND verse IS NOT NULL AND NOT heading")
    text = F.when(F.col("opens") == "v", F.regexp_replace("text", r"^\S+[ ]?", "")).otherwise(F.col("text"))
    v = c.groupBy("book", F.col("chapter").cast("int").alias("chapter"), F.col("verse").alias("designator")).agg(F.trim(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", text.alias("t")))), lambda x: x["t"]), "")).alias("text"))
    m = designator_members(v).filter("first IS NOT NULL AND first <= last").groupBy("book", "chapter", "designator").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.first("text").alias("text"))
    return m.select("book", "chapter", F.explode(F.sequence("first", "last")).alias("verse"), "first", "text").select("book", "chapter", "verse", F.when(F.col("verse") == F.col("first"), F.col("text")).otherwise("<range>").alias("text"))


#: Book codes (fixed values).
BOOKS = (
    "GEN EXO LEV NUM DEU JOS JDG RUT 1SA 2SA 1KI 2KI 1CH 2CH EZR NEH EST JOB PSA PRO ECC SNG ISA JER LAM EZK DAN HOS JOL AMO OBA JON MIC NAM HAB ZEP HAG ZEC MAL "
    "MAT MRK LUK JHN ACT ROM 1CO 2CO GAL EPH PHP COL 1TH 2TH 1TI 2TI TIT PHM HEB JAS 1PE 2PE 1JN 2JN 3JN JUD REV "
    "TOB JDT ESG WIS SIR BAR LJE S3Y SUS BEL 1MA 2MA 3MA 4MA 1ES 2ES MAN PS2 ODA PSS EZA 5EZ 6EZ DAG PS3 2BA LBA JUB ENO 1MQ 2MQ 3MQ REP 4BA LAO FRT BAK OTH INT CNC GLO TDX NDX XXA XXB XXC XXD XXE XXF XXG"
).split()
_VERSE = r"^[1-9][0-9]*(-[1-9][0-9]*)?$"


def lint(books: DataFrame) -> DataFrame:
    """(book, code, chapter, n): unknown markers, numbering, payload and form; the codes of the flat machines.

    One pass: every token carries what its windows over the book say and gives the codes it breaks, so a book is lexed
    and sorted once however many codes there are.
    """
    of_book = Window.partitionBy("book")
    w = of_book.orderBy("pos")
    c = contents(books, to_first_word)
    is_text = F.col("kind") == "Text"
    d = F.regexp_extract("text", r"^(\S+)", 1)
    after = lambda m: (F.col("opens") == m) & is_text
    c = c.withColumn("d", d).withColumn("next_kind", F.lead("kind").over(w)).withColumn("next_marker", F.lead("marker").over(w))
    c = c.withColumn("verse_ok", F.coalesce(after("v") & F.col("d").rlike(_VERSE), F.lit(False)))
    ends = F.split("d", "-")
    c = c.withColumn("first", F.when(F.col("verse_ok"), ends[0].try_cast("int"))).withColumn("last", F.when(F.col("verse_ok"), F.element_at(ends, -1).try_cast("int")))
    c = c.withColumn("n", F.when(after("c"), F.nullif(F.regexp_extract("text", r"^([0-9]+)", 1), F.lit("")).try_cast("int")))
    before = Window.unboundedPreceding, -1
    in_chapter = Window.partitionBy("book", "chapter").orderBy("pos")
    c = c.withColumn("high", F.max("last").over(in_chapter.rowsBetween(*before))).withColumn("c_high", F.max("n").over(w.rowsBetween(*before)))
    c = c.withColumn("times", F.row_number().over(Window.partitionBy("book", "chapter", "first").orderBy("pos"))).withColumn("c_times", F.row_number().over(Window.partitionBy("book", "n").orderBy("pos")))
    c = c.withColumn("ids", F.count_if((F.col("kind") == "Marker") & (F.col("marker") == "id")).over(of_book)).withColumn("chapters", F.count_if((F.col("kind") == "Marker") & (F.col("marker") == "c")).over(of_book))
    mark = F.col("kind") == "Marker"
    bare = (F.col("next_kind").isNull()) | (F.col("next_kind") != "Text")
    paragraph = mark & F.col("marker").isin(*of_kind("paragraph"))
    block = of_kind("paragraph", "heading", "chapter")
    follow = F.when(F.col("next_kind") == "Newline", F.lead("marker", 2).over(w)).otherwise(F.col("next_marker"))
    c = c.withColumn("follow", follow)
    first_row = F.row_number().over(w) == 1
    c = c.withColumn("opening", first_row)
    code = F.upper(F.substring("d", 1, 3))
    rules = {
        "unknown-marker": mark & ~F.col("marker").isin(*MARKERS),
        "designator-malformed": after("v") & ~F.col("verse_ok"),
        "verse-before-first-chapter": after("v") & F.col("chapter").isNull(),
        "verse-duplicate": F.col("verse_ok") & (F.col("times") > 1),
        "verse-out-of-order": F.col("verse_ok") & (F.col("times") == 1) & (F.col("first") <= F.col("high")),
        "verse-gap": F.col("verse_ok") & (F.col("first") > F.col("high") + 1),
        "missing-verse-one": F.col("verse_ok") & F.col("high").isNull() & (F.col("first") > 1) & F.col("chapter").isNotNull(),
        "chapter-duplicate": F.col("n").isNotNull() & (F.col("c_times") > 1),
        "chapter-out-of-order": F.col("n").isNotNull() & (F.col("c_times") == 1) & (F.col("n") < F.col("c_high")),
        "chapter-gap": F.col("n") > F.col("c_high") + 1,
        "verse-without-designator": mark & (F.col("marker") == "v") & bare,
        "chapter-without-designator": mark & (F.col("marker") == "c") & bare,
        "paragraph-before-first-chapter": paragraph & F.col("chapter").isNull(),
        "empty-paragraph": paragraph & (F.col("marker") != "b") & bare & F.coalesce(F.col("follow").isin(*block), F.lit(True)),
        "delimiter-surplus": is_text & F.col("opens").isNotNull() & F.col("text").rlike("^ +[^ ]"),
        "book-code-not-uppercase": after("id") & F.col("d").rlike("^[A-Za-z0-9]{3}$") & (F.col("d") != F.upper("d")),
        "book-code-unknown": after("id") & ~code.isin(*BOOKS),
    }
    whole = {"missing-id": F.col("ids") == 0, "duplicate-id": F.col("ids") > 1, "missing-chapter": F.col("chapters") == 0}
    hit = [F.when(rule, F.struct(F.lit(k).alias("code"), F.col("chapter").alias("chapter"))) for k, rule in rules.items()]
    hit += [F.when(F.col("opening") & rule, F.struct(F.lit(k).alias("code"), F.lit(None).cast("string").alias("chapter"))) for k, rule in whole.items()]
    each = c.select("book", F.inline(F.array_compact(F.array(*hit))))
    return each.groupBy("book", "code", "chapter").agg(F.count("*").alias("n"))
