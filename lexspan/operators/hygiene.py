"""Damage that no text should carry: controls, stray carriage returns, replacement characters, conflict markers, loose
marks, misplaced no-break spaces. One row a maximal run, found with one pass of regular expressions a text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import char_class
from . import census

#: class -> pattern of a maximal run (both engines' dialect)
CLASSES = {
    "C0Control": "[\\x{00}-\\x{08}\\x{0B}\\x{0C}\\x{0E}-\\x{1F}]+",
    "Delete": "\\x{7F}+",
    "C1Control": "[\\x{80}-\\x{9F}]+",
    "ReplacementChar": "\\x{FFFD}+",
    "Noncharacter": "[\\x{FDD0}-\\x{FDEF}\\x{FFFE}\\x{FFFF}]+",
    "StrandedBackslash": "\\\\+",
    "ConflictMarker": "(?m)^(?:<{3,}|={3,}|>{3,}).*$",
    "StrayCarriageReturn": "\\r+(?:[^\\n\\r]|$)",
    "FreeCombiningMark": "(?:^|[\\s\\x{A0}])\\p{M}+",
    "NoBreakSpace": "(?:^|\\s)\\x{A0}+|\\x{A0}+(?:\\s|$)",
    "MisplacedFormat": "(?:^|\\s)[\\x{200B}\\x{2060}\\x{FEFF}]+|[\\x{200B}\\x{2060}\\x{FEFF}]+(?:\\s|$)",
}
#: What a run is replaced by when it is mended; classes that are not here are only reported.
FIXES = {"C0Control": "", "Delete": "", "C1Control": "", "StrandedBackslash": "", "ConflictMarker": "", "MisplacedFormat": " ", "NoBreakSpace": " "}


def findings(chapter: DataFrame) -> DataFrame:
    """(corpus, book, chapter, class, runs, longest): how often each class of damage stands in each text."""
    each = F.array(*[F.struct(F.lit(k).alias("class"), F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias("found")) for k, p in CLASSES.items()])
    rows = chapter.select("corpus", "book", "chapter", F.inline(F.filter(each, lambda x: F.size(x["found"]) > 0)))
    return rows.select("corpus", "book", "chapter", "class", F.size("found").cast("long").alias("runs"), F.array_max(F.transform("found", lambda x: F.char_length(x))).cast("long").alias("longest"))


def groups(found: DataFrame) -> DataFrame:
    """(book, class, runs, chapters): by book and class, and by class over the project (book null)."""
    return found.groupingSets([[F.col("book"), F.col("class")], [F.col("class")]], F.col("book"), F.col("class")).agg(F.sum("runs").alias("runs"), F.count("*").alias("chapters"))


def mended(chapter: DataFrame) -> DataFrame:
    """The texts with every fixable class replaced; judging them again finds none of those classes."""
    text = F.col("text")
    for k, put in FIXES.items():
        text = F.regexp_replace(text, CLASSES[k], put)
    return chapter.withColumn("text", text)


def damaged(chapter: DataFrame) -> DataFrame:
    """A test's input: damage put into the texts by their number, the same in both engines."""
    t, k = F.col("text"), F.col("chapter") % 9
    return chapter.withColumn("text", F.when(k == 0, F.replace(t, F.lit(" the "), F.lit(" \x01the "))).when(k == 1, F.replace(t, F.lit(" de "), F.lit(" \u00a0de "))).when(k == 2, F.replace(t, F.lit(". "), F.lit(".\u200b "))).when(k == 3, F.concat(t, F.lit("\n<<<<<<< ours\nx\n>>>>>>> theirs"))).when(k == 4, F.replace(t, F.lit(", "), F.lit(",\ufffd "))).when(k == 5, F.replace(t, F.lit(" a "), F.lit(" \u0301a "))).when(k == 6, F.replace(t, F.lit("\n"), F.lit("\r"))).when(k == 7, F.replace(t, F.lit(" of "), F.lit(" \\of\x7f "))).otherwise(t))


def damaged_sql(chapters: str) -> str:
    return f"""SELECT corpus, book, chapter, CASE chapter % 9 WHEN 0 THEN replace(text, ' the ', ' \x01the ') WHEN 1 THEN replace(text, ' de ', ' \u00a0de ') WHEN 2 THEN replace(text, '. ', '.\u200b ') WHEN 3 THEN text || chr(10) || '<<<<<<< ours' || chr(10) || 'x' || chr(10) || '>>>>>>> theirs' WHEN 4 THEN replace(text, ', ', ',\ufffd ') WHEN 5 THEN replace(text, ' a ', ' \u0301a ') WHEN 6 THEN replace(text, chr(10), chr(13)) WHEN 7 THEN replace(text, ' of ', ' \\of\x7f ') ELSE text END AS text FROM ({chapters})"""


def findings_sql(texts: str) -> str:
    each = " UNION ALL ".join(f"SELECT corpus, book, chapter, '{k}' AS class, regexp_extract_all(text, '{p}') AS found FROM texts" for k, p in CLASSES.items())
    return f"WITH texts AS ({texts}) SELECT corpus, book, chapter, class, len(found)::bigint AS runs, list_max(list_transform(found, lambda x: length(x)))::bigint AS longest FROM ({each}) WHERE len(found) > 0"


#: Classes that are runs of one kind of character, wherever they stand.
RUNS = {
    "C0Control": "[\\x{00}-\\x{08}\\x{0B}\\x{0C}\\x{0E}-\\x{1F}]",
    "Delete": "[\\x{7F}]",
    "C1Control": "[\\x{80}-\\x{9F}]",
    "ReplacementChar": "[\\x{FFFD}]",
    "Noncharacter": "[\\x{FDD0}-\\x{FDEF}\\x{FFFE}\\x{FFFF}]",
    "NoBreakSpace": "[\\x{A0}]",
    "Format": "[\\x{200B}\\x{2060}\\x{FEFF}]",
}


def placements(chapter: DataFrame) -> DataFrame:
    """(book, class, placement, runs): where runs of each class stand, by book and over the project (book null).

    Alone is a whole text, AtEdge a text's begin or end; then white space or punctuation on a side, letters on both, Other.
    """
    own = "".join(p[1:-1] for p in RUNS.values())
    # what such characters and their neighbours stand in leaves the text, equal stretches once
    held = f"[^{own}]?+[{own}]++(?:[^{own}][{own}]++)*+[^{own}]?+"
    each = chapter.select("book", F.explode(F.regexp_extract_all("text", F.lit(held), F.lit(0))).alias("held"))
    distinct = each.groupBy("book", "held").agg(F.count("*").alias("n"))
    found = None
    for name, pattern in RUNS.items():
        one = census._neighbours(distinct, "held", pattern, "book", "n").withColumn("class", F.lit(name))
        found = one if found is None else found.unionByName(one)
    before, after = char_class(F.col("before")), char_class(F.col("after"))
    space = lambda c, k: c.rlike(r"^[\s\x{A0}]$") | (k == "Space")
    where = (
        F.when(F.col("before").isNull() & F.col("after").isNull(), "Alone")
        .when(F.col("before").isNull() | F.col("after").isNull(), "AtEdge")
        .when(space(F.col("before"), before) | space(F.col("after"), after), "BesideSpace")
        .when(F.col("before").rlike(r"^\p{P}$") | F.col("after").rlike(r"^\p{P}$"), "BesidePunctuation")
        .when((before == "Letter") & (after == "Letter"), "BetweenLetters")
        .otherwise("Other")
    )
    return found.select("book", "class", where.alias("placement"), "n").groupingSets([[F.col("book"), F.col("class"), F.col("placement")], [F.col("class"), F.col("placement")]], F.col("book"), F.col("class"), F.col("placement")).agg(F.sum("n").alias("runs"))


def placements_sql(texts: str) -> str:
    from ..functions.text import char_class_sql as k

    each = " UNION ALL ".join(f"SELECT book, '{name}' AS class, before, after FROM ({census._units_sql(texts, 'text', p, 'book')})" for name, p in RUNS.items())
    space = lambda c: f"(regexp_matches({c}, '^[\\s\\x{{A0}}]$') OR {k(c)} = 'Space')"
    where = f"CASE WHEN before IS NULL AND after IS NULL THEN 'Alone' WHEN before IS NULL OR after IS NULL THEN 'AtEdge' WHEN {space('before')} OR {space('after')} THEN 'BesideSpace' WHEN regexp_matches(before, '^\\p{{P}}$') OR regexp_matches(after, '^\\p{{P}}$') THEN 'BesidePunctuation' WHEN {k('before')} = 'Letter' AND {k('after')} = 'Letter' THEN 'BetweenLetters' ELSE 'Other' END"
    return f"SELECT book, class, placement, count(*) AS runs FROM (SELECT book, class, {where} AS placement FROM ({each})) GROUP BY GROUPING SETS ((book, class, placement), (class, placement))"
