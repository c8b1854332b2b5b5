"""Lint of where and how markers are written: adjacency, bands, levels, callers, delimiters, versions.

One pass over the tokens: every token learns what stands before it from windows over its book, then gives the codes it
breaks. Rules that speak once a book or once a run keep the first row of that book or run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .markers import DEPRECATED, FAMILIES, MARKERS, of_kind
from .markup import tokens

#: Header before titles before introduction before chapters: where a kind of marker belongs.
_BANDS = {"head": 1, "title": 2, "intro": 3, "chapter": 4}
#: Header lines that may stand anywhere.
_ANYWHERE = ("rem", "sts", "mte", "mte1", "mte2")


def _ends(text: Column) -> Column:
    """What the rules see of a token's text: its first word, whether another follows, and its end."""
    begin = F.regexp_extract(text, r"^\s*\S*\s*\S?", 0)
    return F.when(begin == text, text).otherwise(F.concat(begin, F.right(text, F.lit(2))))


def form_lint(books: DataFrame) -> DataFrame:
    """(book, code, n) of books(book, src)."""
    of_book = Window.partitionBy("book").orderBy("pos")
    so_far, earlier = of_book.rowsBetween(Window.unboundedPreceding, 0), of_book.rowsBetween(Window.unboundedPreceding, -1)
    kinds = F.create_map(*[F.lit(x) for pair in MARKERS.items() for x in pair])
    families = F.create_map(*[F.lit(x) for pair in FAMILIES.items() for x in pair])
    t = tokens(books, _ends).withColumn("what", F.when(F.col("marker").isNotNull(), F.coalesce(F.try_element_at(kinds, F.col("marker")), F.lit("unknown"))))
    mark, text, shut = F.col("kind") == "Marker", F.col("kind") == "Text", F.col("kind") == "ClosingMarker"
    is_ = lambda *names: F.col("marker").isin(*names)
    what = lambda *names: F.col("what").isin(*names)
    t = t.withColumns({
        "opens": F.when(F.lag("kind").over(of_book) == "Marker", F.lag("marker").over(of_book)),
        "left": F.lag("text").over(of_book),
        "next_kind": F.lead("kind").over(of_book),
        "next_text": F.lead("text").over(of_book),
    })
    # adjacency: a marker or any text but a number or a number's own text ends the reach of the chapter or verse before it
    words = F.size(F.filter(F.split(F.trim("text"), r"\s+"), lambda x: x != ""))
    own = F.col("opens").isin("ca", "cp", "va", "vp") | (F.col("opens").isin("c", "v") & (words <= 1))
    event = F.when(mark, F.col("marker")).when(text & (words > 0) & ~F.coalesce(own, F.lit(False)), F.lit(""))
    t = t.withColumn("event", event).withColumn("reach", F.last("event", True).over(earlier))
    out_of_reach = lambda *names: ~F.coalesce(F.col("reach").isin(*names), F.lit(False))
    # paragraphs: a verse without one is told once until the next chapter or unknown marker
    state = F.when(mark & what("paragraph", "row", "cell"), "in").when(mark & what("book", "head", "title", "intro", "chapter", "heading", "unknown"), "out")
    t = t.withColumn("state", state).withColumn("stands", F.last("state", True).over(so_far)).withColumn("run", F.count_if(mark & what("chapter", "unknown")).over(so_far))
    # bands and levels
    band = F.coalesce(*[F.when(mark & what(kind) & ~is_(*_ANYWHERE), F.lit(b)) for kind, b in _BANDS.items()])
    family = F.when(mark, F.try_element_at(families, F.col("marker")))
    t = t.withColumns({"band": band, "family": family, "version": F.when(mark & is_("usfm"), F.regexp_extract("next_text", r"^\s*(\d+)", 1))})
    t = t.withColumn("reached", F.max("band").over(earlier)).withColumn("numbered", F.when(F.col("family").isNotNull(), F.col("marker") != F.col("family")))
    t = t.withColumn("declared", F.first("version", True).over(Window.partitionBy("book")).try_cast("int"))
    by_family = Window.partitionBy("book", "family")
    t = t.withColumn("mixed", F.max(F.col("numbered")).over(by_family) != F.min(F.col("numbered")).over(by_family))
    caller = F.regexp_extract("text", r"^\s*(\S+)", 1)
    usfm = mark & is_("usfm")
    homeless = mark & is_("v") & (F.coalesce(F.col("stands"), F.lit("out")) == "out")
    mixed = F.coalesce(F.col("family").isNotNull() & F.col("mixed"), F.lit(False))
    for name, rule, keys in (("first_usfm", usfm, []), ("first_homeless", homeless, ["run"]), ("first_mixed", mixed, ["family"])):
        t = t.withColumn(name, rule & (F.row_number().over(Window.partitionBy("book", *keys, rule).orderBy("pos")) == 1))
    rules = {
        "ca-cp-placement": mark & is_("ca", "cp") & out_of_reach("c", "ca", "cp"),
        "va-vp-placement": mark & is_("va", "vp") & out_of_reach("v", "va", "vp"),
        "missing-paragraph": F.col("first_homeless"),
        "marker-out-of-band": mark & F.coalesce(F.col("band") < F.col("reached"), F.lit(False)),
        "nested-spelling-misuse": (mark | shut) & F.startswith("text", F.lit("\\+")) & ~what("char", "notechar", "break", "unknown"),
        "caller-shape": text & F.col("opens").isin(*of_kind("note")) & (F.octet_length(caller) > 3),
        "numbering-mix": F.col("first_mixed"),
        "marker-not-ws-preceded": mark & what("paragraph", "heading", "title", "intro", "head", "row") & ~is_("usfm") & F.coalesce(~F.col("left").rlike(r"[ \t\r\n]$"), F.lit(False)),
        "delimiter-shape": mark & ~what("unknown", "milestone", "break", "sidebar") & ~is_("b") & ~F.col("text").rlike(r"[ \t]$") & (F.col("next_kind") == "Text") & ~F.coalesce(F.col("next_text").rlike(r"^[ \t\\|]"), F.lit(True)),
        "deprecated-marker": mark & F.coalesce(F.col("family"), F.col("marker")).isin(*DEPRECATED) & (F.col("declared") >= 3),
        "duplicate-usfm": usfm & ~F.col("first_usfm"),
    }
    hit = [F.when(rule, F.lit(code)) for code, rule in rules.items()]
    return t.select("book", F.explode(F.array_compact(F.array(*hit))).alias("code")).groupBy("book", "code").agg(F.count("*").alias("n"))
