"""Queries of listings, orders, first places, insertion points, scans of books, and lint of form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..binding import CHAPTERS_SQL, VERSES_SQL, chapters, table, verses
from ..functions.ladders import GLYPH
from ..functions.text import CORE, HAS_LETTER, WORD, char_class_sql, words_sql
from ..functions.unicode import nfd_length, search_fold
from ..operators import census as C
from ..operators import compare as K
from ..operators import diff as D
from ..operators import find as S
from ..operators import form as L
from ..operators import hygiene as H
from ..operators import judge as J
from ..operators import listing as G
from ..operators import markup as M
from ..operators import overlay as V
from ..operators import references as R
from ..operators import sites as P
from ..operators import versify as N
from ..operators.passes import Pass, run
from ..sources import writers as W
from . import placed
from .compared import PAIRING_SQL, TYPOS_SQL
from .marked import BOOKS_SQL, CONTENTS_SQL, TOKENS_SQL, books

# lint of form


def odd_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A book a document with the flaws of form that its number asks for, around its own text."""
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    on = lambda m, r, s: F.when(k % m == r, F.lit(s)).otherwise("")
    words = F.trim(F.regexp_replace("text", r"[\\\s]+", " "))
    parts = [
        F.lit("\\id GEN\n"), on(3, 0, "\\usfm 3.0\n"), on(5, 0, "\\usfm 3.0\n"), F.lit("\\h H\n\\mt A\n"), on(7, 0, "\\mt1 B\n"), F.lit("\\c 1\n"), on(2, 0, "\\ca 2\\ca*\n"), F.when(k % 11 == 0, "").otherwise("\\p\n"),
        F.lit("\\v 1 "), on(3, 1, "\\va 2\\va* "), F.lit("x "), words, F.lit(" x "), on(4, 0, "\\f + \\ft note\\f* "), on(4, 1, "\\f longcaller \\ft note\\f* "), on(5, 2, "\\pro y\\pro* "), on(8, 7, "\\va 3\\va* "),
        F.lit("tail"), on(6, 3, "\\q1 poetry"), F.lit("\n"), on(6, 4, "\\q more\n\\q2 still\n"), on(13, 5, "\\+p nested\n"), on(9, 2, "\\p\u00a0glued\n"), on(10, 9, "\\h late\n"), F.lit("\\c 2\n"), on(11, 0, "\\v 1 lost\n\\v 2 lost too\n"), on(12, 1, "\\p\n\\v 1 a\n\\cp X\n"),
    ]
    return d.select(F.concat(F.lit("d"), k.cast("string")).alias("book"), F.concat(*parts).alias("src"))


#: What each rule of odd_books() is to give, by the document's number alone.
FORM_SQL = """WITH e AS (SELECT 'd' || doc_id AS book, doc_id AS k FROM documents)
SELECT book, code, sum(n)::bigint AS n FROM (
SELECT book, 'duplicate-usfm' AS code, 1 AS n FROM e WHERE k % 15 = 0
UNION ALL SELECT book, 'numbering-mix', 1 FROM e WHERE k % 7 = 0
UNION ALL SELECT book, 'numbering-mix', 1 FROM e WHERE k % 6 = 4
UNION ALL SELECT book, 'va-vp-placement', 1 FROM e WHERE k % 8 = 7
UNION ALL SELECT book, 'ca-cp-placement', 1 FROM e WHERE k % 12 = 1
UNION ALL SELECT book, 'missing-paragraph', 2 FROM e WHERE k % 11 = 0
UNION ALL SELECT book, 'caller-shape', 1 FROM e WHERE k % 4 = 1
UNION ALL SELECT book, 'deprecated-marker', 1 FROM e WHERE k % 5 = 2 AND k % 3 = 0
UNION ALL SELECT book, 'marker-not-ws-preceded', 1 FROM e WHERE k % 6 = 3
UNION ALL SELECT book, 'nested-spelling-misuse', 1 FROM e WHERE k % 13 = 5
UNION ALL SELECT book, 'delimiter-shape', 1 FROM e WHERE k % 9 = 2
UNION ALL SELECT book, 'marker-out-of-band', 1 FROM e WHERE k % 10 = 9
) GROUP BY ALL"""


# orders and limits


def find_first(spark, sf_dir):
    """The first hundred hits in the order of texts and offsets."""
    return S.hits(placed.texts(spark, sf_dir), "tion", most=100)


def pattern_order(spark, sf_dir):
    """Patterns in the order in which they are listed."""
    c = chapters(spark, sf_dir)
    return G.in_order(rarity=J.rarity(c), exact_neighbor=J.exact_neighbor(c), placement=J.placement(c))


_EACH = "SELECT corpus, glyph, '{0}' AS channel, numerator, denominator, {1} AS at_, {2}::varchar AS detail FROM ({3})"
PATTERNS_SQL = f"""SELECT corpus, row_number() OVER (PARTITION BY corpus ORDER BY CASE channel WHEN 'rarity' THEN 0 ELSE 1 END, glyph, at_, detail)::int AS place, channel, glyph, detail, numerator, denominator FROM (
{_EACH.format('rarity', 0, "''", J.rarity_sql())} UNION ALL {_EACH.format('exact_neighbor', 1, 'next', J.exact_neighbor_sql())} UNION ALL {_EACH.format('placement', 2, "side || ' ' || class", J.placement_sql())})"""


def typo_groups(spark, sf_dir):
    from .compared import typos

    return G.typo_groups(typos(spark, sf_dir))


TYPO_GROUPS_SQL = f"""SELECT corpus, row_number() OVER (PARTITION BY corpus ORDER BY slips DESC, target)::int AS place, target, target_n, slips, members FROM (
SELECT corpus, target, target_n, count(*) AS slips, string_agg(word || ' ' || n, ', ' ORDER BY n, word) AS members FROM ({TYPOS_SQL}) GROUP BY 1, 2, 3)"""


def first_places(spark, sf_dir):
    """The first three places of each word, in the order of books, chapters and lines."""
    return G.first_places(verses(chapters(spark, sf_dir)))


FIRST_PLACES_SQL = f"""WITH w AS (SELECT DISTINCT corpus, book, chapter, verse, unnest(list_transform({words_sql('text')}, lambda x: lower(replace(x, 'İ', 'i')))) AS word FROM ({VERSES_SQL})),
r AS (SELECT *, row_number() OVER (PARTITION BY corpus, word ORDER BY book, chapter, verse) AS k FROM w)
SELECT corpus, word, string_agg(book || ' ' || chapter || ':' || verse, ', ' ORDER BY book, chapter, verse) AS places FROM r WHERE k <= 3 GROUP BY 1, 2"""


def usual_neighbours(spark, sf_dir):
    """The class that most often stands beside each mark, of equals the first by name."""
    return G.usual(C.pairs(chapters(spark, sf_dir)))


USUAL_SQL = f"""SELECT corpus, glyph, side, class, n FROM (SELECT *, row_number() OVER (PARTITION BY corpus, glyph, side ORDER BY n DESC, class) AS k FROM (
SELECT corpus, glyph, 'before' AS side, before AS class, sum(n)::bigint AS n FROM ({C.PAIRS_SQL}) GROUP BY ALL UNION ALL SELECT corpus, glyph, 'after', after, sum(n)::bigint FROM ({C.PAIRS_SQL}) GROUP BY ALL)) WHERE k = 1"""


def headline_sites(spark, sf_dir):
    """How often each channel is the finest one at a place that several channels name."""
    c = chapters(spark, sf_dir)
    found = G.headlines(("placement", P.placement_sites(c, J.placement(c))), ("rarity", P.rarity_sites(c, J.rarity(c))))
    return found.groupBy("headline", "reasons").agg(F.count("*").alias("places"))


# pairs


def pairing_stats(spark, sf_dir):
    """How many units met in which way, by book."""
    from .compared import pairing

    return G.tally(pairing(spark, sf_dir), "book", "kind")


def insertion_points(spark, sf_dir):
    """Where the German lines that the French lack would go."""
    t, s = _numbered_lines(spark, sf_dir, "fr"), _numbered_lines(spark, sf_dir, "de")
    return K.insertion_points(t, s)


def _numbered_lines(spark, sf_dir, corpus):
    """Documents as verses: chapter = doc_id mod 9, verse = length mod 31, at their place in the book by doc_id; the first of a key counts."""
    d = table(spark, sf_dir, "documents").filter(F.col("lang") == corpus)
    v = d.groupBy(F.col("source").alias("book"), (F.col("doc_id") % 9).cast("int").alias("chapter"), (F.char_length("text") % 31).cast("int").alias("verse")).agg(F.min("doc_id").alias("begin"))
    return v.withColumn("end", F.col("begin") + 1)


_LINES_SQL = "SELECT source AS book, (doc_id % 9)::int AS chapter, (length(text) % 31)::int AS verse, min(doc_id) AS a, min(doc_id) + 1 AS b FROM documents WHERE lang = '{0}' GROUP BY 1, 2, 3"
INSERTION_SQL = f"""WITH t AS ({_LINES_SQL.format('fr')}), s AS ({_LINES_SQL.format('de')}),
m AS (SELECT s.book, s.chapter, s.verse FROM s WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.book = s.book AND t.chapter = s.chapter AND t.verse = s.verse))
SELECT m.book, m.chapter, m.verse, coalesce(
 (SELECT b FROM t WHERE t.book = m.book AND t.chapter = m.chapter AND t.verse < m.verse ORDER BY t.verse DESC LIMIT 1),
 (SELECT a FROM t WHERE t.book = m.book AND t.chapter = m.chapter ORDER BY t.verse LIMIT 1),
 (SELECT b FROM t WHERE t.book = m.book ORDER BY t.chapter DESC, t.verse DESC LIMIT 1), 0)::bigint AS at FROM m"""


PAIRING_STATS_SQL = f"""SELECT book, kind, n, (n * 10000 // sum(n) OVER (PARTITION BY book))::bigint AS share_bp FROM (SELECT book, kind, count(*) AS n FROM ({PAIRING_SQL}) GROUP BY 1, 2)"""


# scans of books


def scanned_books(spark, sf_dir):
    """The books, every third with two-character line ends."""
    k = F.regexp_extract("book", "[0-9]+", 0).cast("int")
    return books(spark, sf_dir).select("book", F.when(k % 3 == 0, F.replace("src", F.lit("\n"), F.lit("\r\n"))).otherwise(F.col("src")).alias("src"))


SCAN_SQL = rf"""WITH {BOOKS_SQL}, x AS (SELECT book, CASE WHEN regexp_extract(book, '[0-9]+')::int % 3 = 0 THEN replace(src, chr(10), chr(13) || chr(10)) ELSE src END AS src FROM books),
p AS (SELECT book, src, list_transform(string_split(src, chr(10) || '\c '), lambda y: length(y)) AS cut FROM x)
SELECT book, list_aggregate(list_transform(range(len(cut)), lambda i: CASE WHEN i = 0 THEN 0 ELSE list_sum(cut[1:i]) + 4 * (i - 1) + 1 END::bigint::varchar), 'string_agg', ',') AS starts,
(length(src) - length(replace(src, chr(10), '')) - (length(src) - length(replace(src, chr(13) || chr(10), ''))) // 2)::int AS lf, ((length(src) - length(replace(src, chr(13) || chr(10), ''))) // 2)::int AS crlf FROM p"""

REBASED_SQL = f"""WITH {CONTENTS_SQL} SELECT book, pos, chapter, verse, start - began AS begin FROM (SELECT *, last_value(CASE WHEN marker = 'c' AND kind = 'Marker' THEN start END IGNORE NULLS) OVER (PARTITION BY book ORDER BY pos ROWS UNBOUNDED PRECEDING) AS began FROM ctx) WHERE kind = 'Text' AND opens = 'v' AND chapter IS NOT NULL"""
REPEATED_SQL = f"""WITH {TOKENS_SQL} SELECT book, trim(text, ' ') AS text, count(*) AS times FROM toks WHERE kind = 'Text' AND trim(text, ' ') <> '' GROUP BY 1, 2 HAVING count(*) > 1"""


# words in texts


def display_units(spark, sf_dir):
    """How each text falls into words and the rest."""
    u = G.display_units(placed.texts(spark, sf_dir))
    size = F.char_length("unit").cast("long")
    return u.groupBy("id").agg(F.count("*").alias("units"), F.count_if("is_word").alias("words"), F.sum(F.when(F.col("is_word"), size)).alias("in_words"), F.max(F.when(F.col("is_word"), size)).alias("longest"), F.sum(F.when(F.col("is_word"), F.col("start").cast("long"))).alias("starts"))


def word_at(spark, sf_dir):
    """The word at a third of each text, where one stands there."""
    t = placed.texts(spark, sf_dir)
    return G.word_at(t.select("id", (F.char_length("text") / 3).cast("int").alias("point")), t)


_UNIT = (WORD + "|[^" + CORE[1:-1] + "]+").replace("'", "''")


def _units_sql(texts: str) -> str:
    return f"""SELECT id, "at", (sum(length(unit)) OVER (PARTITION BY id ORDER BY "at") - length(unit))::int AS start, unit, regexp_matches(unit, '{HAS_LETTER}') AS is_word FROM (
SELECT id, unnest(regexp_extract_all(text, '{_UNIT}')) AS unit, unnest(range(len(regexp_extract_all(text, '{_UNIT}'))))::int AS "at" FROM ({texts}))"""


WORD_AT_SQL = f"""SELECT u.id, point, unit AS word, start FROM (SELECT doc_id AS id, (length(text) // 3)::int AS point FROM documents) p JOIN ({_units_sql('SELECT doc_id AS id, text FROM documents')}) u ON u.id = p.id AND start <= point AND point < start + length(unit) WHERE is_word"""


def search_folds(spark, sf_dir):
    """Words that the fold of search changes beyond their case."""
    w = C.word_forms(chapters(spark, sf_dir)).select("corpus", "word").distinct()
    return w.withColumn("folded", search_fold("word")).filter("folded <> word")


def decomposed(spark, sf_dir):
    """Characters whose canonical form is more than one character."""
    s = C.scalars(chapters(spark, sf_dir)).filter("char_length(glyph) = 1").select("corpus", "glyph")
    return s.withColumn("length", nfd_length("glyph")).filter("length > 1")


# sites

SITES_SQL = f"""WITH chars AS (SELECT corpus, book, chapter, unnest(string_split(text, '')) AS glyph, generate_subscripts(string_split(text, ''), 1) AS pos FROM ({CHAPTERS_SQL}) WHERE text <> ''),
x AS (SELECT corpus, book, chapter, (pos - 1)::int AS at_, glyph, lag(glyph) OVER w AS before, lead(glyph) OVER w AS after FROM chars WINDOW w AS (PARTITION BY chapter ORDER BY pos)),
p AS (SELECT DISTINCT x.corpus, book, chapter, at_, 'placement' AS reason FROM x JOIN ({J.placement_sql()}) c ON c.corpus = x.corpus AND c.glyph = x.glyph AND c.class = CASE c.side WHEN 'before' THEN {char_class_sql('before')} ELSE {char_class_sql('after')} END),
r AS (SELECT DISTINCT x.corpus, book, chapter, at_, 'rarity' AS reason FROM x JOIN ({J.rarity_sql()}) c ON c.corpus = x.corpus AND c.glyph = x.glyph),
g AS (SELECT corpus, book, chapter, at_, bool_or(reason = 'rarity') AS rare, string_agg(reason, ',' ORDER BY reason) AS reasons FROM (SELECT * FROM p UNION ALL SELECT * FROM r) GROUP BY ALL)
SELECT corpus, book, chapter, at_ AS "at", CASE WHEN rare THEN 'rarity' ELSE 'placement' END AS headline, reasons FROM g"""

# blocks of one book put on another


def unblocked(spark, sf_dir):
    """The books without paragraph markers, with others for them, or as they are."""
    k, src = F.regexp_extract("book", "[0-9]+", 0).cast("int"), F.col("src")
    return books(spark, sf_dir).select("book", F.when(k % 3 == 0, F.replace(src, F.lit("\\p\n"), F.lit(""))).when(k % 3 == 1, F.replace(src, F.lit("\\p\n"), F.lit("\\q1\n\\m\n"))).otherwise(src).alias("src"))


def block_pairs(spark, sf_dir):
    return V.block_pairs(unblocked(spark, sf_dir), books(spark, sf_dir)).groupBy("book", "change").agg(F.count("*").alias("n"))


def overlaid_books(spark, sf_dir):
    """The blocks after the overlay, against the source's again."""
    made = V.overlaid(unblocked(spark, sf_dir), books(spark, sf_dir)).select("book", "src")
    return V.block_pairs(made, books(spark, sf_dir)).groupBy("book", "change").agg(F.count("*").alias("n"))


_BLOCKS = rf"WITH {BOOKS_SQL}, b AS (SELECT book, regexp_extract(book, '[0-9]+')::int % 3 AS k, ((length(src) - length(replace(src, '\p' || chr(10), ''))) // 3)::bigint AS n FROM books)"


# versions of texts


def word_changes(spark, sf_dir):
    """Texts against themselves with words put at an end."""
    d = table(spark, sf_dir, "documents")
    k, t = F.col("doc_id") % 3, F.col("text")
    new = F.when(k == 0, F.concat(t, F.lit(" zz"))).when(k == 1, F.concat(F.lit("zz "), t)).otherwise(t)
    return D.word_changes(d.select(F.col("doc_id").alias("unit"), t.alias("old"), new.alias("new")))


WORD_CHANGES_SQL = """WITH d AS (SELECT doc_id AS unit, doc_id % 3 AS k, text FROM documents)
SELECT unit, (CASE k WHEN 1 THEN 1 ELSE 0 END)::int AS "at", 'same' AS change, text AS old, text AS new FROM d WHERE text <> ''
UNION ALL SELECT unit, (CASE WHEN k = 0 AND text <> '' THEN 1 ELSE 0 END)::int, 'added', '', CASE k WHEN 0 THEN ' zz' ELSE 'zz ' END FROM d WHERE k < 2"""


# what finer claims explain

RECURRING_SQL = f"""WITH {C.RUNS_SQL} SELECT corpus, run, n, pooled FROM (SELECT *, (sum(n) OVER (PARTITION BY corpus, shape))::bigint AS pooled FROM (
SELECT corpus, run, count(*) AS n, regexp_replace(run, '[.!?։؟۔।॥።。！？…‼⁇⁈⁉]', 'T', 'g') AS shape FROM runs WHERE length(run) > 1 GROUP BY corpus, run)) WHERE n >= 5 OR pooled >= 5"""
LEADERS_SQL = f"""WITH {C.RUNS_SQL} SELECT corpus, glyph, count(*) AS pairs FROM (SELECT corpus, run[i] AS glyph FROM (SELECT corpus, run, unnest(range(1, length(run))) AS i FROM runs)) GROUP BY 1, 2 HAVING count(*) >= 5"""


# numbers of verses


def verse_steps(spark, sf_dir):
    """Documents' lengths read as verse numbers, source by source."""
    d = table(spark, sf_dir, "documents")
    return N.accepted(d.select(F.col("source").alias("unit"), F.col("doc_id").alias("at"), (F.char_length("text") % 9 + 1).cast("int").alias("number")))


STEPS_SQL = """WITH RECURSIVE d AS (SELECT source AS unit, doc_id AS at_, (length(text) % 9 + 1)::int AS number, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
s AS (SELECT unit, at_, number, i, CASE WHEN number <= 3 THEN 'next' END AS step, CASE WHEN number <= 3 THEN number ELSE 0 END AS verse FROM d WHERE i = 1
UNION ALL SELECT d.unit, d.at_, d.number, d.i, CASE WHEN d.number > s.verse AND d.number <= s.verse + 3 THEN 'next' WHEN d.number = 1 AND s.verse >= 1 THEN 'restart' END, CASE WHEN (d.number > s.verse AND d.number <= s.verse + 3) OR (d.number = 1 AND s.verse >= 1) THEN d.number ELSE s.verse END FROM s JOIN d ON d.unit = s.unit AND d.i = s.i + 1)
SELECT unit, at_ AS "at", number, step, verse FROM s"""


def number_conventions(spark, sf_dir):
    """Documents with every fifth line numbered, in one of three ways."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("unit"), F.posexplode(F.split("text", "\n")).alias("i", "line"))
    k, n = F.col("unit") % 3, (F.col("i") % 50 + 1).cast("string")
    mark = F.when(F.col("i") % 5 == 0, F.when(k == 0, F.concat(F.lit("v. "), n, F.lit(" "))).when(k == 1, F.concat(n, F.lit(" "))).otherwise(""))
    return G.number_conventions(d.select("unit", F.concat(F.coalesce(mark, F.lit("")), "line").alias("line")))


CONVENTIONS_SQL = rf"""WITH d AS (SELECT doc_id AS unit, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10)))))::int AS i FROM documents),
l AS (SELECT unit, CASE WHEN i % 5 = 0 THEN CASE unit % 3 WHEN 0 THEN 'v. ' || (i % 50 + 1) || ' ' WHEN 1 THEN (i % 50 + 1) || ' ' ELSE '' END ELSE '' END || line AS line FROM d),
c AS (SELECT unit, sum(len(regexp_extract_all(line, '{G.MARKED}')))::bigint AS marked, count(*) FILTER (regexp_matches(line, '{G.LINE_START}') AND NOT regexp_matches(line, '{G.ALONE}')) AS line_start, count(*) FILTER (regexp_matches(line, '{G.ALONE}')) AS alone FROM l GROUP BY 1)
SELECT *, CASE WHEN marked >= 3 AND marked * 2 >= line_start + alone THEN 'marked' ELSE 'line_start' END AS mode FROM c"""


def _edges(spark, sf_dir):
    """What the alternative scheme's verses correspond to: alternative and hub names of the verses."""
    counts, rows = placed.schemes(spark, sf_dir)
    name = lambda side, c, v: F.concat(F.lit(side + " "), c, F.lit(":"), v)
    return N.hub_places(counts, rows).filter("scheme = 'alt'").select("book", name("a", "chapter", "verse").alias("a"), name("h", "hub_chapter", "hub_verse").alias("b"))


def linked_verses(spark, sf_dir):
    return N.linked(_edges(spark, sf_dir))


LINKED_SQL = """WITH RECURSIVE hub AS (SELECT source AS book, (doc_id % 5 + 1)::int AS chapter, (count(*) % 9 + 6)::int AS last FROM documents GROUP BY 1, 2),
v AS (SELECT book, chapter, last, unnest(range(0, last + CASE chapter WHEN 2 THEN -1 WHEN 3 THEN 1 WHEN 4 THEN -1 ELSE 0 END + 1))::int AS verse FROM hub),
e AS (SELECT book, 'a ' || chapter || ':' || verse AS a, 'h ' || CASE WHEN chapter = 5 AND verse = 6 THEN 1 ELSE chapter END || ':' || unnest(CASE WHEN chapter = 2 THEN CASE WHEN verse < last THEN [verse + 1] ELSE [verse] END WHEN chapter = 3 AND verse = 3 THEN [2] WHEN chapter = 3 AND verse > 3 THEN CASE WHEN verse - 4 < last - 2 THEN [verse - 1] ELSE [verse] END WHEN chapter = 4 AND verse = 4 THEN [4, 5] WHEN chapter = 4 AND verse > 4 THEN CASE WHEN verse - 5 < last - 5 THEN [verse + 1] ELSE [verse] END WHEN chapter = 5 AND verse = 6 THEN [1] ELSE [verse] END) AS b FROM v),
x AS (SELECT book, a, b FROM e UNION SELECT book, b, a FROM e),
r AS (SELECT DISTINCT book, a AS node, a AS g FROM x UNION SELECT r.book, r.node, x.b FROM r JOIN x ON x.book = r.book AND x.a = r.g)
SELECT book, node, min(g) AS "group" FROM r GROUP BY 1, 2"""


def scheme_problems(spark, sf_dir):
    """The schemes of the sources, and one more with a flaw of each kind."""
    counts, rows = placed.schemes(spark, sf_dir)
    flawed = spark.createDataFrame([("own", "GEN", 1, 5), ("own", "GEN", 3, 4), ("own", "EXO", 1, 0), ("own", "LEV", 1, 4), ("own", "LEV", 1, 4), ("own", "NUM", 1, 6), ("eng", "RUT", 1, 3)], "scheme string, book string, chapter int, last int")
    wrong = spark.createDataFrame([("own", "NUM", 1, 2, "NUM", 1, 3, None, 5, "Parallel"), ("own", "NUM", 1, 3, "NUM", 1, 3, None, 5, "Parallel"), ("own", "NUM", 1, 4, "NUM", 1, 4, "a", 2, "Merge"), ("own", "NUM", 2, 1, "NUM", 2, 1, None, 1, "Parallel"), ("own", "NUM", 1, 1, "NUM", 1, 1, None, 2, "Uneven")], rows.schema)
    gone = spark.createDataFrame([("own", "NUM", 1, 6), ("own", "NUM", 1, 7), ("own", "NUM", 9, 1)], "scheme string, book string, chapter int, verse int")
    found = N.scheme_problems(counts.unionByName(flawed), rows.unionByName(wrong), gone, M.BOOKS, ("eng",))
    return found.filter("problem <> 'not a book code'")  # the sources' names are none


PROBLEMS_SQL = """SELECT * FROM (VALUES ('eng', '', 'a built-in scheme''s name'), ('own', 'GEN', 'chapters are missing'), ('own', 'EXO', 'a chapter without verses'), ('own', 'LEV', 'given twice'), ('own', 'NUM 1:3', 'past the scheme''s counts'), ('own', 'NUM 1:4', 'a part on a range'),
('own', 'NUM 2:1', 'no such chapter'), ('own', 'NUM 1:1', 'ranges of unlike lengths'), ('own', 'NUM 1:7', 'past the scheme''s counts'), ('own', 'NUM 9:1', 'no such chapter')) AS t(scheme, entry, problem)"""


# listings


def listing(spark, sf_dir):
    return G.listing_lines(pattern_order(spark, sf_dir))


def site_snippets(spark, sf_dir):
    return G.snippets(chapters(spark, sf_dir), placed.site_reasons(spark, sf_dir))


# passes of one's own


def line_ends(chapter: DataFrame) -> DataFrame:
    """How lines end: their last character's class of mark, a pass outside the built-in ones."""
    line = chapter.select("corpus", "book", F.explode(F.split("text", "\n")).alias("line")).filter("line <> ''")
    return line.groupBy("corpus", "book", F.lit("line").alias("slot"), F.right("line", F.lit(1)).alias("key")).agg(F.count("*").alias("n"))


def own_pass(spark, sf_dir):
    return run(chapters(spark, sf_dir), Pass("line_ends", line_ends))


OWN_PASS_SQL = f"""SELECT 'line_ends' AS pass, corpus, 'line' AS slot, key, books, numerator, denominator, ceiling_bp, share_bp FROM ({J._judged_sql(f"SELECT *, sum(numerator) OVER (PARTITION BY corpus)::bigint AS denominator FROM (SELECT corpus, right(line, 1) AS key, count(*) AS numerator, count(DISTINCT book) AS books FROM (SELECT corpus, book, unnest(string_split(text, chr(10))) AS line FROM ({CHAPTERS_SQL})) WHERE line <> '' GROUP BY 1, 2)", "corpus, key, books", GLYPH)})"""

# places by name


def citations(spark, sf_dir):
    """Citations as people write them, names and spacing by the documents' numbers."""
    d = table(spark, sf_dir, "documents")
    k, a, b = F.col("doc_id") % 8, F.col("doc_id") % 40 + 1, F.char_length("text") % 30 + 1
    name = F.element_at(F.array(*[F.lit(n) for n in _CITED]), (k + 1).cast("int"))
    text = F.concat(name, F.lit(" "), a, F.lit(":"), b, F.lit("; "), a + 1, F.lit(":2–3; exod intro"))
    got = R.in_canonical_order(R.cited(d.select(F.col("doc_id").alias("id"), text.alias("text")), R.catalogue(spark, {"Génesis": "GEN"})))
    return got.select("id", "at", "book", "rank", "from_chapter", "from_verse", "to_verse", "assumed", "error")


_CITED = ("Génesis", "gen.", "1john", "1 John", "phil", "LUK", "Song of  Songs", "Nobody")
CITATIONS_SQL = """WITH d AS (SELECT doc_id AS id, doc_id % 8 AS k, doc_id % 40 + 1 AS a, length(text) % 30 + 1 AS b, CASE doc_id % 8 WHEN 0 THEN 'GEN' WHEN 1 THEN 'GEN' WHEN 2 THEN '1JN' WHEN 3 THEN '1JN' WHEN 4 THEN 'PHP' WHEN 5 THEN 'LUK' WHEN 6 THEN 'SNG' END AS book, CASE doc_id % 8 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 61 WHEN 3 THEN 61 WHEN 4 THEN 49 WHEN 5 THEN 41 WHEN 6 THEN 21 END AS rank FROM documents)
SELECT id, 0 AS "at", book, coalesce(rank, {none})::int AS rank, CASE WHEN k < 7 THEN a END::int AS from_chapter, CASE WHEN k < 7 THEN b END::int AS from_verse, CASE WHEN k < 7 THEN b END::int AS to_verse, k = 4 AS assumed, CASE WHEN k = 7 THEN 'unknown-book' END AS error FROM d
UNION ALL SELECT id, 1, book, coalesce(rank, {none})::int, CASE WHEN k < 7 THEN a + 1 END::int, CASE WHEN k < 7 THEN 2 END::int, CASE WHEN k < 7 THEN 3 END::int, false, CASE WHEN k = 7 THEN 'no-reference-before' END FROM d
UNION ALL SELECT id, 2, 'EXO', 1, 0, NULL, NULL, true, NULL FROM d""".replace("{none}", str(len(M.BOOKS)))


def word_references(spark, sf_dir):
    """References to a word, or a character, of each document's first line, as lines of one book; some past the end."""
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    text = F.concat(F.when(k % 3 == 0, "en+ulb.").otherwise(""), F.lit("GEN "), k, F.lit(":"), F.when(k % 7 == 0, "999").otherwise("1"), F.lit("!"), F.when(k % 5 == 0, "end").otherwise((k % 40 + 1).cast("string")), F.when(k % 2 == 0, "+2").otherwise(""))
    lines = verses(chapters(spark, sf_dir)).select(F.lit("GEN").alias("book"), "chapter", "verse", "text")
    return R.word_places(R.refined(d.select(k.alias("id"), text.alias("text"))), lines)


WORD_REFERENCES_SQL = f"""WITH l AS (SELECT doc_id AS k, {words_sql("string_split(text, chr(10))[1]")} AS w FROM documents), o AS (SELECT k, CASE WHEN k % 5 = 0 THEN w[-1] ELSE w[k % 40 + 1] END AS one FROM l),
p AS (SELECT k, one, CASE WHEN k % 7 = 0 THEN 'verse' WHEN one IS NULL THEN 'word' WHEN k % 2 = 0 AND length(one) < 2 THEN 'character' END AS problem FROM o)
SELECT k AS id, CASE WHEN problem IS NULL THEN CASE WHEN k % 2 = 0 THEN substring(one, 2, 1) ELSE one END END AS found, problem FROM p"""


def address_at(spark, sf_dir):
    """The place in the middle of each book."""
    b = books(spark, sf_dir)
    return R.address_at(b.select("book", (F.char_length("src") / 2).cast("int").alias("offset")), b)


ADDRESS_AT_SQL = f"""WITH {CONTENTS_SQL}, q AS (SELECT book, (length(src) // 2)::int AS offset_ FROM books),
m AS (SELECT book, pos, start, marker, kind, regexp_extract(lead(text) OVER (PARTITION BY book ORDER BY pos), '^(\\S+)', 1) AS said FROM toks),
p AS (SELECT book, start, marker, said, last_value(CASE WHEN marker = 'c' THEN said END IGNORE NULLS) OVER (PARTITION BY book ORDER BY pos ROWS UNBOUNDED PRECEDING) AS ch FROM m WHERE kind = 'Marker' AND marker IN ('c', 'v')),
l AS (SELECT q.book, offset_, max(start) AS at_ FROM q LEFT JOIN p ON p.book = q.book AND start <= offset_ GROUP BY 1, 2)
SELECT l.book, offset_ AS "offset", CASE WHEN at_ IS NULL THEN 'intro' WHEN marker = 'c' THEN ch ELSE concat_ws(':', ch, said) END AS address FROM l LEFT JOIN p ON p.book = l.book AND p.start = at_"""


def manifests(spark, sf_dir):
    """A manifest a source of its documents as files."""
    d = table(spark, sf_dir, "documents")
    return W.manifest(d.select(F.col("source").alias("unit"), F.col("doc_id").cast("string").alias("name"), F.col("text").cast("binary").alias("content")))


MANIFESTS_SQL = """SELECT source AS unit, '{"ingredients":[' || string_agg('{"name":"' || doc_id || '","size":' || strlen(text) || ',"md5":"' || md5(text) || '"}', ',' ORDER BY doc_id::varchar) || ']}' AS json FROM documents GROUP BY 1"""


def drawn_alike(chapter: DataFrame) -> DataFrame:
    """A test's input: commas and hyphens of some texts in another form."""
    t, k = F.col("text"), F.col("chapter") % 4
    return chapter.withColumn("text", F.when(k == 0, F.replace(t, F.lit(","), F.lit("‚"))).when(k == 1, F.replace(t, F.lit(" a "), F.lit(" – "))).when(k == 2, F.replace(t, F.lit(" a "), F.lit(" - "))).otherwise(t))


_ALIKE_SQL = f"SELECT corpus, book, chapter, CASE chapter % 4 WHEN 0 THEN replace(text, ',', '‚') WHEN 1 THEN replace(text, ' a ', ' – ') WHEN 2 THEN replace(text, ' a ', ' - ') ELSE text END AS text FROM ({CHAPTERS_SQL})"

QUERIES = {
    "word_references": word_references,
    "separated_doubles": lambda s, d: C.separated_doubles(chapters(s, d)),
    "citations": citations,
    "address_at": address_at,
    "manifests": manifests,
    "faced_runs": lambda s, d: C.faced_runs(chapters(s, d)),
    "follow_contexts": lambda s, d: C.follow_contexts(chapters(s, d)),
    "lookalikes": lambda s, d: C.lookalikes(drawn_alike(chapters(s, d))),
    "hygiene_placements": lambda s, d: H.placements(H.damaged(chapters(s, d))),
    "explained_leaders": lambda s, d: J.leaders(chapters(s, d)),
    "recurring_runs": lambda s, d: J.recurring_runs(chapters(s, d)),
    "unexplained_placement": lambda s, d: J.unexplained_placement(chapters(s, d)),
    "verse_steps": verse_steps,
    "number_conventions": number_conventions,
    "linked_verses": linked_verses,
    "scheme_problems": scheme_problems,
    "listing_lines": listing,
    "site_snippets": site_snippets,
    "block_pairs": block_pairs,
    "overlaid_books": overlaid_books,
    "word_changes": word_changes,
    "own_pass": own_pass,
    "form_lint": lambda s, d: L.form_lint(odd_books(s, d)),
    "find_first_hits": find_first,
    "pattern_order": pattern_order,
    "typo_groups": typo_groups,
    "first_places": first_places,
    "usual_neighbours": usual_neighbours,
    "headline_sites": headline_sites,
    "pairing_stats": pairing_stats,
    "insertion_points": insertion_points,
    "chapter_scan": lambda s, d: G.chapter_scan(scanned_books(s, d)),
    "rebased_verses": lambda s, d: G.rebased_verses(books(s, d)),
    "repeated_blocks": lambda s, d: G.repeated_blocks(books(s, d)),
    "display_units": display_units,
    "word_at": word_at,
    "search_folds": search_folds,
    "decomposed": decomposed,
}
ORACLES = {
    "word_references": WORD_REFERENCES_SQL,
    "separated_doubles": C.SEPARATED_SQL,
    "citations": CITATIONS_SQL,
    "address_at": ADDRESS_AT_SQL,
    "manifests": MANIFESTS_SQL,
    "faced_runs": C.FACED_RUNS_SQL,
    "follow_contexts": C.FOLLOW_CONTEXTS_SQL,
    "lookalikes": C._lookalikes_sql().replace(CHAPTERS_SQL, _ALIKE_SQL),
    "hygiene_placements": H.placements_sql(H.damaged_sql(CHAPTERS_SQL)),
    "explained_leaders": LEADERS_SQL,
    "recurring_runs": RECURRING_SQL,
    "unexplained_placement": J.unexplained_placement_sql(),
    "verse_steps": STEPS_SQL,
    "number_conventions": CONVENTIONS_SQL,
    "linked_verses": LINKED_SQL,
    "scheme_problems": PROBLEMS_SQL,
    "listing_lines": f"SELECT corpus, place, concat_ws(' ', channel, glyph, nullif(detail, ''), numerator || '/' || denominator) AS line FROM ({PATTERNS_SQL})",
    "site_snippets": f"SELECT s.corpus, headline, s.book, s.chapter, s.\"at\", substring(text, greatest(s.\"at\" - 10, 0) + 1, s.\"at\" - greatest(s.\"at\" - 10, 0) + 11) AS snippet FROM (SELECT *, row_number() OVER (PARTITION BY corpus, headline ORDER BY book, chapter, \"at\") AS k FROM ({SITES_SQL})) s JOIN ({CHAPTERS_SQL}) c ON c.chapter = s.chapter WHERE k <= 3",
    "block_pairs": f"{_BLOCKS} SELECT book, change, n FROM (SELECT book, 'missing' AS change, n FROM b WHERE k = 0 UNION ALL SELECT book, 'respelled', n FROM b WHERE k = 1 UNION ALL SELECT book, 'extra', n FROM b WHERE k = 1 UNION ALL SELECT book, 'same', n FROM b WHERE k = 2) WHERE n > 0",
    "overlaid_books": f"{_BLOCKS} SELECT book, 'same' AS change, n FROM b WHERE n > 0",
    "word_changes": WORD_CHANGES_SQL,
    "own_pass": OWN_PASS_SQL,
    "form_lint": FORM_SQL,
    "find_first_hits": f"SELECT * FROM ({placed._hits_sql('tion')}) ORDER BY id, start LIMIT 100",
    "pattern_order": PATTERNS_SQL,
    "typo_groups": TYPO_GROUPS_SQL,
    "first_places": FIRST_PLACES_SQL,
    "usual_neighbours": USUAL_SQL,
    "headline_sites": f"SELECT headline, reasons, count(*) AS places FROM ({SITES_SQL}) GROUP BY 1, 2",
    "site_reasons": SITES_SQL,
    "pairing_stats": PAIRING_STATS_SQL,
    "insertion_points": INSERTION_SQL,
    "chapter_scan": SCAN_SQL,
    "rebased_verses": REBASED_SQL,
    "repeated_blocks": REPEATED_SQL,
    "display_units": f"SELECT id, count(*) AS units, count(*) FILTER (is_word) AS words, (sum(length(unit)) FILTER (is_word))::bigint AS in_words, (max(length(unit)) FILTER (is_word))::bigint AS longest, (sum(start) FILTER (is_word))::bigint AS starts FROM ({_units_sql('SELECT doc_id AS id, text FROM documents')}) GROUP BY 1",
    "word_at": WORD_AT_SQL,
    "search_folds": f"WITH {C.WORD_FORMS_SQL} SELECT DISTINCT corpus, word, lower(strip_accents(word)) AS folded FROM word_forms WHERE lower(strip_accents(word)) <> word",
    "decomposed": f"SELECT corpus, glyph, 2 AS length FROM ({C.SCALARS_SQL}) WHERE strip_accents(glyph) <> glyph",
}
