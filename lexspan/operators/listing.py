"""What a reader is shown: patterns in order, groups of slips, first places, usual neighbours, units, scans of books.

Ranks keep few rows a key (the optimizer limits each key map-side), so a frequent word or a large book is no hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CORE, HAS_LETTER, WORD_ONCE, fold, words_of_chunk
from . import sites
from .markup import contents, tokens

#: What tells two claims of a channel on one mark apart.
_DETAIL = {"rarity": [], "exact_neighbor": ["next"], "pooled_neighbor": ["pool"], "placement": ["side", "class"]}


def in_order(**channels: DataFrame) -> DataFrame:
    """(corpus, place, channel, glyph, detail, numerator, denominator): claims as listed, the rare characters first, then mark by
    mark, channel by channel in the order given."""
    every = None
    for at, (name, claims) in enumerate(channels.items()):
        one = claims.select("corpus", "glyph", F.lit(name).alias("channel"), F.lit(at).alias("at"), F.concat_ws(" ", *_DETAIL[name]).alias("detail"), "numerator", "denominator")
        every = one if every is None else every.unionByName(one)
    order = Window.partitionBy("corpus").orderBy(F.col("channel") != "rarity", "glyph", "at", "detail")  # claims are few
    return every.select("corpus", F.row_number().over(order).alias("place"), "channel", "glyph", "detail", "numerator", "denominator")


def typo_groups(slips: DataFrame) -> DataFrame:
    """(corpus, place, target, target_n, slips, members) of slips(corpus, word, n, target, target_n): the targets with the most
    slips first, a target's slips by count and spelling."""
    members = F.sort_array(F.collect_list(F.struct("n", "word")))
    by = slips.groupBy("corpus", "target", "target_n").agg(F.count("*").alias("slips"), F.array_join(F.transform(members, lambda m: F.concat_ws(" ", m["word"], m["n"])), ", ").alias("members"))
    return by.select("corpus", F.row_number().over(Window.partitionBy("corpus").orderBy(F.desc("slips"), "target")).alias("place"), "target", "target_n", "slips", "members")


def first_places(verse: DataFrame, most: int = 3) -> DataFrame:
    """(corpus, word, places): the first `most` verses in which each folded word stands."""
    chunk = verse.select("corpus", "book", "chapter", "verse", F.explode(F.array_distinct(F.split("text", " "))).alias("chunk"))
    word = chunk.select("corpus", "book", "chapter", "verse", F.explode(words_of_chunk(F.col("chunk"))).alias("raw")).withColumn("word", fold(F.col("raw")))
    # a verse that has a word twice is twice the same rank, so the few first places are kept before anything is dealt out
    word = word.select("corpus", "word", "book", "chapter", "verse")
    at = F.dense_rank().over(Window.partitionBy("corpus", "word").orderBy("book", "chapter", "verse"))
    first = word.withColumn("at", at).filter(F.col("at") <= most)
    place = F.concat("book", F.lit(" "), "chapter", F.lit(":"), "verse")
    got = first.groupBy("corpus", "word").agg(F.sort_array(F.collect_set(F.struct("at", place.alias("place")))).alias("places"))
    return got.select("corpus", "word", F.array_join(F.transform("places", lambda p: p["place"]), ", ").alias("places"))


def usual(pairs: DataFrame) -> DataFrame:
    """(corpus, glyph, side, class, n) of pairs(corpus, glyph, before, after, n): each side's most frequent class, of equals
    the first by name."""
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("class")) for s in ("before", "after")])
    by = pairs.select("corpus", "glyph", "n", F.inline(sides)).groupBy("corpus", "glyph", "side", "class").agg(F.sum("n").alias("n"))
    first = F.row_number().over(Window.partitionBy("corpus", "glyph", "side").orderBy(F.desc("n"), "class"))
    return by.withColumn("at", first).filter("at = 1").drop("at")


def headlines(*channels: tuple[str, DataFrame]) -> DataFrame:
    """(corpus, book, chapter, at, headline, reasons): places with the finest channel that names them."""
    return sites.reasons(*channels)


def tally(rows: DataFrame, *keys: str) -> DataFrame:
    """How many rows stand under each key, and their share of the first key's rows in basis points."""
    by = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(keys[0]))
    return by.withColumn("share_bp", F.floor(F.col("n") * 10_000 / total).cast("long"))


def display_units(texts: DataFrame) -> DataFrame:
    """(id, at, start, unit, is_word) of texts(id, text): words and what stands between them; their texts joined are the text."""
    each = texts.select("id", F.posexplode(F.regexp_extract_all("text", F.lit(f"{WORD_ONCE}|[^{CORE[1:-1]}]+"), F.lit(0))).alias("at", "unit"))
    so_far = Window.partitionBy("id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    start = F.sum(F.char_length("unit")).over(so_far) - F.char_length("unit")
    return each.select("id", "at", start.cast("int").alias("start"), "unit", F.col("unit").rlike(HAS_LETTER).alias("is_word"))


def word_at(points: DataFrame, texts: DataFrame) -> DataFrame:
    """points(id, point) with the word that the point lies in (word, start); none of a point between words."""
    units = display_units(texts)
    met = points.join(units, "id").filter((F.col("start") <= F.col("point")) & (F.col("point") < F.col("start") + F.char_length("unit")))
    return met.filter("is_word").select("id", "point", F.col("unit").alias("word"), "start")


def chapter_scan(books: DataFrame) -> DataFrame:
    """(book, starts, lf, crlf) of books(book, src): where the chunks begin (0, and each \\c at the start of a line) and how lines end."""
    cut = F.transform(F.split("src", r"\n(?=\\c )"), lambda x: F.char_length(x))
    starts = F.transform(F.sequence(F.lit(0), F.size("cut") - 1), lambda i: F.aggregate(F.slice(F.col("cut"), F.lit(1), i), F.lit(0), lambda a, b: a + b) + i)
    ends = lambda s: (F.char_length("src") - F.char_length(F.replace("src", F.lit(s), F.lit("")))) / len(s)
    return books.select("book", cut.alias("cut"), ends("\n").cast("int").alias("all"), ends("\r\n").cast("int").alias("crlf")).select("book", F.array_join(starts.cast("array<string>"), ",").alias("starts"), (F.col("all") - F.col("crlf")).alias("lf"), "crlf")


def rebased_verses(books: DataFrame) -> DataFrame:
    """(book, chapter, verse, begin): where the verses of a book begin, counted from their chapter's marker."""
    w = Window.partitionBy("book").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    c = contents(books).withColumn("from", F.last(F.when((F.col("marker") == "c") & (F.col("kind") == "Marker"), F.col("start")), True).over(w))
    return c.filter("kind = 'Text' AND opens = 'v' AND chapter IS NOT NULL").select("book", "pos", "chapter", "verse", (F.col("start") - F.col("from")).alias("begin"))


def repeated_blocks(books: DataFrame) -> DataFrame:
    """(book, text, times): pieces of text between markers that a book holds more than once, by which a diff can go wrong."""
    t = tokens(books).filter("kind = 'Text'").select("book", F.trim("text").alias("text")).filter("text <> ''")
    return t.groupBy("book", "text").agg(F.count("*").alias("times")).filter("times > 1")


def listing_lines(ordered: DataFrame) -> DataFrame:
    """(corpus, place, line) of in_order(): one line of text a pattern, as a terminal shows it."""
    return ordered.select("corpus", "place", F.concat_ws(" ", "channel", "glyph", F.nullif("detail", F.lit("")), F.concat("numerator", F.lit("/"), "denominator")).alias("line"))


def snippets(chapter: DataFrame, found: DataFrame, around: int = 10, most: int = 3) -> DataFrame:
    """(corpus, headline, book, chapter, at, snippet): the first places of each corpus and headline with what stands around."""
    rank = F.row_number().over(Window.partitionBy("corpus", "headline").orderBy("book", "chapter", "at"))
    first = found.withColumn("k", rank).filter(F.col("k") <= most).select("corpus", "book", "chapter", "at", "headline")
    met = chapter.join(F.broadcast(first), ["corpus", "book", "chapter"])  # `most` rows a corpus and channel
    begin = F.greatest(F.col("at") - around, F.lit(0))
    return met.select("corpus", "headline", "book", "chapter", "at", F.substring("text", begin + 1, F.col("at") - begin + around + 1).alias("snippet"))


#: least numbers of candidates for a convention to be taken for one
_LEAST = 3
MARKED, LINE_START, ALONE = r"(?:^|\s)[vV]\.?\s*[0-9]{1,3}(?:\s|$)", r"^\s*[0-9]{1,3}(?:-[0-9]{1,3})?\s", r"^\s*[0-9]{1,3}(?:-[0-9]{1,3})?\s*$"


def number_conventions(lines: DataFrame) -> DataFrame:
    """(unit, marked, line_start, alone, mode) of lines(unit, line): how verse numbers are written, if they are."""
    c = F.col("line")
    by = lines.groupBy("unit").agg(
        F.sum(F.regexp_count(c, F.lit(MARKED))).alias("marked"),
        F.count_if(c.rlike(LINE_START) & ~c.rlike(ALONE)).alias("line_start"),
        F.count_if(c.rlike(ALONE)).alias("alone"),
    )
    at_lines = F.col("line_start") + F.col("alone")
    return by.withColumn("mode", F.when((F.col("marked") >= _LEAST) & (F.col("marked") * 2 >= at_lines), "marked").otherwise("line_start"))
