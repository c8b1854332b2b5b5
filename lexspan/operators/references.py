"""Places in a marked-up corpus as text: strict references in, addresses out, and addresses looked up.

The spelling is a book code, chapter, verse with an optional part letter, ranges with -, lists with , and ;. A reference
without a book or chapter takes them from the one before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import words
from ..functions.unicode import folded, search_fold
from .find import located
from .markup import BOOKS, contents

ONE_CHAPTER = ("OBA", "PHM", "2JN", "3JN", "JUD")
_BOOK, _POINT = "[A-Z0-9]{3}", "(?:[0-9]+:[0-9]+[a-z]?|[0-9]+[a-z]?)"
ONE = f"^(?:({_BOOK})(?: |$))?({_POINT})?(?:-({_POINT}))?$"


def parsed(texts: DataFrame) -> DataFrame:
    """(id, at, book, level, from_chapter, from_verse, to_chapter, to_verse, error) of each reference of texts(id, text).

    level: book, intro, chapters or verses. error (then the rest is null): unexpected, no-reference-before, backwards,
    mixed-range or intro-has-no-verses. Context is carried along the list by windows over one text's references.
    """
    item = F.explode(F.transform(F.split("text", "[;,]"), lambda x, i: F.struct(i.alias("at"), F.trim(x).alias("one"))))
    r = texts.select("id", item.alias("x")).select("id", "x.at", "x.one")
    part = lambda k: F.nullif(F.regexp_extract("one", ONE, k), F.lit(""))
    r = r.withColumn("ok", F.col("one").rlike(ONE) & (F.col("one") != "")).withColumn("own", part(1)).withColumn("a", part(2)).withColumn("b", part(3))
    order = Window.partitionBy("id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("book", F.last("own", True).over(order))
    number = lambda c, k: F.nullif(F.regexp_extract(c, "^(?:([0-9]+):)?([0-9]+)", k), F.lit("")).cast("int")
    r = r.withColumn("ac", number("a", 1)).withColumn("av", number("a", 2)).withColumn("bc", number("b", 1)).withColumn("bv", number("b", 2))
    # what a bare number means is fixed by the last reference that says: with a colon, or in a one-chapter book, a verse
    single = F.col("book").isin(*ONE_CHAPTER)
    says = F.when(F.col("a").isNull(), "book").when(F.col("ac").isNotNull() | F.col("bc").isNotNull(), "verse").when(F.col("own").isNotNull(), F.when(single & (F.col("av") > 0), "verse").otherwise("chapter"))
    r = r.withColumn("mode", F.last(says, True).over(order))
    here = F.when(F.col("bc").isNotNull(), F.col("bc")).when(F.col("ac").isNotNull(), F.col("ac")).when(F.col("own").isNotNull() & single, 1)
    r = r.withColumn("said", F.last(here, True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    verse = F.col("mode") == "verse"
    ac = F.when(verse, F.coalesce("ac", F.when(single, 1), F.col("said"))).otherwise(F.col("av"))
    r = r.withColumn("from_chapter", ac).withColumn("from_verse", F.when(verse, F.col("av")))
    r = r.withColumn("to_chapter", F.when(F.col("b").isNull(), F.col("from_chapter")).when(verse, F.coalesce("bc", "from_chapter")).otherwise(F.col("bv"))).withColumn("to_verse", F.when(verse, F.coalesce("bv", "from_verse")))
    mixed = (F.col("b").isNotNull()) & F.col("bc").isNotNull() & F.col("ac").isNull() & F.col("own").isNotNull()
    back = (F.col("to_chapter") < F.col("from_chapter")) | ((F.col("to_chapter") == F.col("from_chapter")) & (F.col("to_verse") < F.col("from_verse")))
    intro = F.col("from_chapter") == 0
    error = F.when(~F.col("ok"), "unexpected").when(F.col("book").isNull(), "no-reference-before").when(mixed, "mixed-range").when(intro & (verse | F.col("b").isNotNull()), "intro-has-no-verses").when(back, "backwards")
    r = r.withColumn("error", error)
    level = F.when(F.col("mode") == "book", "book").when(verse, "verses").when(intro, "intro").otherwise("chapters")
    clear = lambda c: F.when(F.col("error").isNull(), c)
    return r.select("id", "at", clear(F.col("book")).alias("book"), clear(level).alias("level"), *[clear(F.col(c)).alias(c) for c in ("from_chapter", "from_verse", "to_chapter", "to_verse")], "error")


def spelled(refs: DataFrame) -> DataFrame:
    """(id, text): each list written out whole, '; ' between references."""
    point = lambda c, v: F.concat_ws(":", F.col(c), F.col(v))
    start, end = point("from_chapter", "from_verse"), point("to_chapter", "to_verse")
    tail = F.when(start == end, "").when(F.col("from_chapter") == F.col("to_chapter"), F.concat(F.lit("-"), F.coalesce(F.col("to_verse").cast("string"), F.col("to_chapter").cast("string")))).otherwise(F.concat(F.lit("-"), end))
    one = F.when(F.col("level") == "book", F.col("book")).when(F.col("level") == "intro", F.concat("book", F.lit(" 0"))).otherwise(F.concat("book", F.lit(" "), start, tail))
    every = refs.filter("error IS NULL").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("at", one.alias("one")))).alias("all"))
    return every.select("id", F.array_join(F.col("all.one"), "; ").alias("text"))


def resolved(addresses: DataFrame, units: DataFrame) -> DataFrame:
    """(id, verdict, first, last, begin, end) of addresses(id, book, chapter, verse) in units(book, chapter, first, last, begin, end).

    found (with the span and the verses it really covers), missing-chapter, missing-verse or ambiguous.
    """
    hit = addresses.join(units, ["book", "chapter"], "left")
    covers = F.col("verse").between(F.col("first"), F.col("last"))
    got = hit.groupBy("id").agg(F.count_if(covers).alias("n"), F.count("first").alias("in_chapter"), *[F.min(F.when(covers, F.col(c))).alias(c) for c in ("first", "last", "begin", "end")])
    verdict = F.when(F.col("in_chapter") == 0, "missing-chapter").when(F.col("n") == 0, "missing-verse").when(F.col("n") > 1, "ambiguous").otherwise("found")
    only = lambda c: F.when(F.col("n") == 1, F.col(c)).alias(c)
    return got.select("id", verdict.alias("verdict"), only("first"), only("last"), only("begin"), only("end"))


#: English names of the first books of BOOKS, in their order (fixed values).
NAMES = (
    "Genesis, Exodus, Leviticus, Numbers, Deuteronomy, Joshua, Judges, Ruth, 1 Samuel, 2 Samuel, 1 Kings, 2 Kings, 1 Chronicles, 2 Chronicles, Ezra, Nehemiah, Esther, Job, Psalms, Proverbs, Ecclesiastes, "
    "Song of Songs, Isaiah, Jeremiah, Lamentations, Ezekiel, Daniel, Hosea, Joel, Amos, Obadiah, Jonah, Micah, Nahum, Habakkuk, Zephaniah, Haggai, Zechariah, Malachi, Matthew, Mark, Luke, John, Acts, Romans, "
    "1 Corinthians, 2 Corinthians, Galatians, Ephesians, Philippians, Colossians, 1 Thessalonians, 2 Thessalonians, 1 Timothy, 2 Timothy, Titus, Philemon, Hebrews, James, 1 Peter, 2 Peter, 1 John, 2 John, 3 John, Jude, Revelation"
).split(", ")


def catalogue(spark: SparkSession, own: dict[str, str] | None = None) -> DataFrame:
    """(name, code, assumed): every beginning of the books' folded names, English ones and a project's own {name: code}; a whole
    name or code means its book, a beginning the first book in order that has it (assumed)."""
    names = [*((n, c) for n, c in (own or {}).items()), *zip(NAMES, BOOKS, strict=False), *((c, c) for c in BOOKS)]
    rank = {c: i for i, c in enumerate(BOOKS)}
    whole, begun = {}, {}
    for name, code in names:
        key = "".join(folded(name).split())
        whole.setdefault(key, code)
        for k in range(2, len(key)):
            begun[key[:k]] = min(begun.get(key[:k], code), code, key=lambda c: rank.get(c, len(rank)))
    return spark.createDataFrame([(n, c, False) for n, c in whole.items()] + [(n, c, True) for n, c in begun.items() if n not in whole], "name string, code string, assumed boolean")


def cited(texts: DataFrame, names: DataFrame) -> DataFrame:
    """parsed() of citations as people write them: texts(id, text) with books by name or the beginning of one, in any case and
    spacing, `intro` for a book's introduction; with assumed, and error unknown-book.

    names is catalogue()'s table, as large as the names are long, so it is broadcast.
    """
    item = F.explode(F.transform(F.split("text", "[;,]"), lambda x, i: F.struct(i.alias("at"), F.trim(x).alias("one"))))
    r = texts.select("id", item.alias("x")).select("id", "x.at", "x.one")
    pattern = r"^((?:[1-3]\s*)?\p{L}[\p{L}\s]*?)?\.?\s*(intro(?:duction)?|[0-9].*)?$"
    low = F.lower("one")
    name = search_fold(F.regexp_replace(F.regexp_extract(low, pattern, 1), r"\s+", ""))
    r = r.withColumn("name", F.nullif(name, F.lit(""))).withColumn("rest", F.regexp_replace(F.regexp_replace(F.regexp_extract(low, pattern, 2), "^intro.*", "0"), "[–—]", "-"))
    r = r.join(F.broadcast(names), "name", "left")
    unknown = F.col("name").isNotNull() & F.col("code").isNull()
    strict = F.trim(F.concat_ws(" ", F.when(unknown, "?").otherwise(F.col("code")), F.nullif("rest", F.lit(""))))
    told = r.withColumn("strict", strict).withColumn("unknown", unknown)
    lists = told.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "strict"))), lambda x: x["strict"]), ";").alias("text"))
    out = parsed(lists).join(told.select("id", "at", "assumed", "unknown"), ["id", "at"])
    return out.withColumn("error", F.when(F.col("unknown"), "unknown-book").otherwise(F.col("error"))).withColumn("assumed", F.coalesce("assumed", F.lit(False))).drop("unknown")


def in_canonical_order(df: DataFrame, column: str = "book") -> DataFrame:
    """df with rank: a book's place in the order of codes, codes of no place after all."""
    ranks = F.create_map(*[F.lit(x) for i, c in enumerate(BOOKS) for x in (c, i)])
    return df.withColumn("rank", F.coalesce(F.try_element_at(ranks, F.col(column)), F.lit(len(BOOKS))))


def places(books: DataFrame) -> DataFrame:
    """(book, at, kind, chapter, verse): where the introduction, each chapter's head and each verse begin."""
    w = Window.partitionBy("book").orderBy("pos")
    c = contents(books).withColumn("said", F.regexp_extract(F.lead("text").over(w), r"^(\S+)", 1)).filter("kind = 'Marker' AND marker IN ('c', 'v')")
    chapter = F.last(F.when(F.col("marker") == "c", F.col("said")), True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = c.select("book", F.col("start").alias("at"), F.when(F.col("marker") == "c", "chapter").otherwise("verse").alias("kind"), chapter.alias("chapter"), F.when(F.col("marker") == "v", F.col("said")).alias("verse"))
    none = F.lit(None).cast("string")
    return books.select("book", F.lit(-1).alias("at"), F.lit("intro").alias("kind"), none.alias("chapter"), none.alias("verse")).unionByName(rows)


def address_at(points: DataFrame, books: DataFrame) -> DataFrame:
    """points(book, offset) with address: 'intro', a chapter, or chapter:verse as written."""
    spelled_ = F.when(F.col("kind") == "intro", "intro").when(F.col("kind") == "chapter", F.col("chapter")).otherwise(F.concat_ws(":", "chapter", "verse"))
    tiles = places(books).select(F.col("book").alias("id"), spelled_.alias("tile"), F.col("at").alias("tile_start"))
    got = located(points.select(F.col("book").alias("id"), F.col("offset").alias("start")), tiles)
    return got.select(F.col("id").alias("book"), F.col("start").alias("offset"), F.col("tile").alias("address"))


#: One refined reference: translation, book, chapter and verse with its part, word and character, attribute.
_WORD_STEP = r"!([1-9][0-9]*|end)(?:\+([0-9]+|end))?"
REFINED = rf"^(?:([A-Za-z][A-Za-z0-9-]*(?:\+[A-Za-z0-9]+)*)\.)?([A-Z0-9]{{3}})(?: ([0-9]+)(?::([0-9]+|end)([a-z])?(?:{_WORD_STEP})?)?)?(?:@([A-Za-z][A-Za-z0-9-]*))?(?:-(?:{_WORD_STEP}|([1-9][0-9]*|end)(?:{_WORD_STEP})?))?$"


def refined(texts: DataFrame) -> DataFrame:
    """(id, translation, book, chapter, verse, part, word, char, attribute, last_verse, last_word, last_char, error) of
    texts(id, text): references below the verse, such as MAT 2:1!3+2-2!4. Numbers may be `end`, so verse, word and char are
    texts; a range that names no verse stays in the first one's. error: empty, expected-book, unknown-book, backwards or
    unexpected (then the rest is null)."""
    part = lambda k: F.nullif(F.regexp_extract("text", REFINED, k), F.lit(""))
    names = ["translation", "book", "chapter", "verse", "part", "word", "char", "attribute", "range_word", "range_char", "range_verse", "verse_word", "verse_char"]
    r = texts.select("id", "text", *[part(i + 1).alias(n) for i, n in enumerate(names)])
    r = r.withColumn("last_verse", F.coalesce("range_verse", F.when(F.col("range_word").isNotNull(), F.col("verse"))))
    # a bare number after a word is a word, after a verse a verse
    bare = F.col("word").isNotNull() & F.col("range_verse").isNotNull() & F.col("verse_word").isNull()
    r = r.withColumn("last_word", F.when(bare, F.col("range_verse")).otherwise(F.coalesce("range_word", "verse_word"))).withColumn("last_char", F.coalesce("range_char", "verse_char"))
    r = r.withColumn("last_verse", F.when(bare, F.col("verse")).otherwise(F.col("last_verse")))
    n = lambda c: F.coalesce(F.col(c).try_cast("int"), F.lit(1 << 30))
    back = F.col("last_verse").isNotNull() & ((n("last_verse") < n("verse")) | ((n("last_verse") == n("verse")) & (F.coalesce(F.col("last_word").try_cast("int"), F.lit(1 << 30)) < F.coalesce(F.col("word").try_cast("int"), F.lit(0)))))
    code = F.regexp_extract("text", r"^(?:[^.]*\.)?([A-Z0-9]{3})(?![A-Za-z0-9])", 1)
    error = F.when(F.trim("text") == "", "empty").when(code == "", "expected-book").when(~code.isin(*BOOKS), "unknown-book").when(F.col("book").isNull(), "unexpected").when(back, "backwards")
    r = r.withColumn("error", error)
    clear = lambda c: F.when(F.col("error").isNull(), F.col(c)).alias(c)
    kept = ["translation", "book", "chapter", "verse", "part", "word", "char", "attribute", "last_verse", "last_word", "last_char"]
    return r.select("id", *[clear(c) for c in kept], "error")


def word_places(refs: DataFrame, verse: DataFrame) -> DataFrame:
    """(id, found, problem): what refined() references to words, or characters of words, name in verse(book, chapter, verse, text).

    problem: verse, word or character where there is none; ambiguous where the text holds the verse twice. Verses meet in
    one equi-join; `end` is a chapter's last verse, a verse's last word or a word's last character.
    """
    last = verse.groupBy("book", "chapter").agg(F.max("verse").alias("end_verse"))
    r = refs.filter("error IS NULL AND word IS NOT NULL").withColumn("chapter", F.col("chapter").cast("long"))
    r = r.join(last, ["book", "chapter"], "left").withColumn("verse", F.when(F.col("verse") == "end", F.col("end_verse")).otherwise(F.col("verse").try_cast("int")))
    at = verse.groupBy("book", "chapter", "verse").agg(F.count("*").alias("times"), F.min("text").alias("text"))
    met = r.join(at, ["book", "chapter", "verse"], "left").withColumn("words", words(F.col("text")))
    word = F.when(F.col("word") == "end", F.element_at("words", -1)).otherwise(F.get(F.col("words"), F.col("word").try_cast("int") - 1))
    met = met.withColumn("one", F.when(F.size("words") > 0, word))
    char = F.when(F.col("char") == "end", F.right("one", F.lit(1))).otherwise(F.substring(F.col("one"), F.col("char").try_cast("int"), F.lit(1)))
    problem = F.when(F.col("times").isNull(), "verse").when(F.col("times") > 1, "ambiguous").when(F.col("one").isNull(), "word").when(F.col("char").isNotNull() & (char == ""), "character")
    met = met.withColumn("problem", problem)
    return met.select("id", F.when(F.col("problem").isNull(), F.when(F.col("char").isNull(), F.col("one")).otherwise(char)).alias("found"), "problem")
