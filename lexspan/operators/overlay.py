"""A target book's blocks made equal to a source's: addresses, pairs and the edits between them.

A block marker's address is (chapter, verse, placement, ordinal): leading blocks stand right before a verse, with no verse text
between; the others stand inside the verse they are in. Equal addresses name equal blocks on both sides, whatever the
languages. Leading blocks can be put in and taken out; where a verse's text would split is not known, so blocks inside a
verse are only respelled, taken out or reported.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .diff import spliced
from .markers import of_kind
from .markup import contents, to_first_word

ADDRESS = ["book", "chapter", "verse", "placement", "ordinal"]


def skeleton(books: DataFrame) -> DataFrame:
    """(book, chapter, verse, placement, ordinal, marker, begin, end): the paragraph markers of books(book, src) with their addresses."""
    w = Window.partitionBy("book").orderBy("pos")
    # what follows is read backwards: a frame that ends with the book is walked again for every row
    back = Window.partitionBy("book").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    c = contents(books, to_first_word)
    mark = F.col("kind") == "Marker"
    said = F.regexp_extract(F.lead("text").over(w), r"^(\S+)", 1)
    event = F.when(mark & (F.col("marker") == "v"), F.concat(F.lit("v"), said)).when(mark & (F.col("marker") == "c"), "c").when((F.col("kind") == "Text") & ~F.col("heading") & (F.trim("text") != ""), "t")
    c = c.withColumn("event", event).withColumn("follows", F.last("event", True).over(back))
    c = c.withColumn("next_kind", F.lead("kind").over(w)).withColumn("next_len", F.lead("len").over(w))
    blocks = c.filter(mark & F.col("marker").isin(*of_kind("paragraph")))
    leading = F.coalesce(F.startswith("follows", F.lit("v")), F.lit(False))
    verse = F.when(leading, F.expr("substring(follows, 2)")).otherwise(F.coalesce("verse", F.lit("")))
    length = F.col("len") + F.when(F.col("next_kind") == "Newline", F.col("next_len")).otherwise(0)
    at = blocks.select("book", "pos", F.coalesce("chapter", F.lit("")).alias("chapter"), verse.alias("verse"), F.when(leading, "leading").otherwise("inside").alias("placement"), "marker", F.col("start").alias("begin"), (F.col("start") + length).alias("end"))
    order = Window.partitionBy("book", "chapter", "verse", "placement").orderBy("pos")
    return at.withColumn("ordinal", F.row_number().over(order)).select(*ADDRESS, "marker", "begin", "end")


def block_pairs(target: DataFrame, source: DataFrame) -> DataFrame:
    """(book, chapter, verse, placement, ordinal, change, marker, source_marker, begin, end): blocks of equal addresses: same,
    respelled, missing (from the target) or extra."""
    s = skeleton(source).select(*ADDRESS, F.col("marker").alias("source_marker"))
    both = skeleton(target).join(s, ADDRESS, "full")
    change = F.when(F.col("marker").isNull(), "missing").when(F.col("source_marker").isNull(), "extra").when(F.col("marker") == F.col("source_marker"), "same").otherwise("respelled")
    return both.select(*ADDRESS, change.alias("change"), "marker", "source_marker", "begin", "end")


def overlay_edits(target: DataFrame, source: DataFrame) -> DataFrame:
    """(book, begin, end, put): what makes the target's blocks the source's, as edits of one transaction."""
    pairs = block_pairs(target, source)
    taken = pairs.filter("change = 'extra'").select("book", "begin", "end", F.lit("").alias("put"))
    put = F.concat(F.lit("\\"), "source_marker")
    spelled = pairs.filter("change = 'respelled'").select("book", "begin", (F.col("begin") + 1 + F.char_length("marker")).cast("int").alias("end"), put.alias("put"))
    w = Window.partitionBy("book").orderBy("pos")
    c = contents(target, to_first_word).withColumn("said", F.regexp_extract(F.lead("text").over(w), r"^(\S+)", 1)).filter("kind = 'Marker' AND marker = 'v'")
    places = c.groupBy("book", F.coalesce("chapter", F.lit("")).alias("chapter"), F.col("said").alias("verse")).agg(F.min("start").alias("begin"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("ordinal", put.alias("put")))), lambda x: F.concat(x["put"], F.lit("\n")))
    missing = pairs.filter("change = 'missing' AND placement = 'leading'").groupBy("book", "chapter", "verse").agg(F.array_join(lines, "").alias("put"))
    added = missing.join(places, ["book", "chapter", "verse"]).select("book", "begin", F.col("begin").alias("end"), "put")
    return taken.unionByName(spelled).unionByName(added).select("book", F.col("begin").cast("int"), F.col("end").cast("int"), "put")


def overlaid(target: DataFrame, source: DataFrame) -> DataFrame:
    """(book, src, error): the target's books with the source's blocks."""
    return spliced(target, overlay_edits(target, source))
