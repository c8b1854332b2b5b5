"""Queries of search, places, histories, numbering schemes and references."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..binding import chapters, table
from ..functions.text import CORE, JOIN, LETTER
from ..operators import find as S
from ..operators import history as T
from ..operators import judge as J
from ..operators import markup as M
from ..operators import references as R
from ..operators import sites as P
from ..operators import versify as V
from .marked import MASK_SQL, VERSE_ROWS_SQL, books

LATEST = 1_700_000_000


# search


def texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def _hits_sql(needle: str, fold: bool = False, word: bool = False) -> str:
    hay = "lower(text)" if fold else "text"
    n = len(needle)
    quote = JOIN.replace("'", "''")
    keep = f"AND NOT (regexp_matches(x, '{CORE}$') OR regexp_matches(x, '{LETTER}{quote}$') OR regexp_matches(nx, '^{CORE}') OR regexp_matches(nx, '^{quote}{LETTER}'))" if word else ""
    return f"""SELECT id, start::int AS start, (start + {n})::int AS "end" FROM (SELECT id, x, i, sum(length(x)) OVER (PARTITION BY id ORDER BY i) + i * {n} AS start, lead(x) OVER (PARTITION BY id ORDER BY i) AS nx FROM (
SELECT doc_id AS id, unnest(string_split({hay}, '{needle}')) AS x, unnest(range(0, len(string_split({hay}, '{needle}')))) AS i FROM documents)) WHERE nx IS NOT NULL {keep}"""


def find_lines(spark, sf_dir):
    t = texts(spark, sf_dir)
    return S.located(S.hits(t, "tion"), S.lines(t)).select("id", "start", F.col("tile").alias("line"))


FIND_LINES_SQL = f"SELECT h.id, h.start, (length(left(d.text, h.start)) - length(replace(left(d.text, h.start), chr(10), '')) + 1)::int AS line FROM ({_hits_sql('tion')}) h JOIN documents d ON d.doc_id = h.id"


def offset_units(spark, sf_dir):
    t, at = F.col("text"), (F.char_length("text") / 3).cast("int")
    return texts(spark, sf_dir).select("id", at.alias("point"), S.utf8_offset(t, at).cast("long").alias("utf8"), S.utf16_offset(t, at).cast("long").alias("utf16"))


OFFSETS_SQL = "SELECT doc_id AS id, (length(text) // 3)::int AS point, strlen(left(text, length(text) // 3))::bigint AS utf8, (length(text) // 3 + length(regexp_replace(left(text, length(text) // 3), '[^\\x{10000}-\\x{10FFFF}]', '', 'g')))::bigint AS utf16 FROM documents"


def mask_pieces(spark, sf_dir):
    """Three stretches of every book's projection, as source ranges."""
    kept = M.masked(books(spark, sf_dir)).withColumnRenamed("book", "id")
    spans = kept.select("id").distinct().select("id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")).select("id", (F.col("k") * 60).alias("start"), (F.col("k") * 60 + 90).alias("end"))
    return S.pieces(spans, kept).select("id", "start", "end", F.array_join(F.transform("pieces", lambda x: F.concat_ws("-", x["from"], x["to"])), " ").alias("pieces"))


PIECES_SQL = f"""WITH m AS ({MASK_SQL}), s AS (SELECT DISTINCT book, k * 60 AS a, k * 60 + 90 AS b FROM m, (SELECT unnest(range(0, 3)) AS k))
SELECT s.book AS id, a::int AS start, b::int AS "end", string_agg((source_from + greatest(a - kept_from, 0)) || '-' || (source_from + least(b - kept_from, source_to - source_from)), ' ' ORDER BY source_from) AS pieces
FROM s JOIN m ON m.book = s.book AND kept_from < b AND kept_from + source_to - source_from > a GROUP BY s.book, a, b"""


# sites


def placement_tally(spark, sf_dir):
    c = chapters(spark, sf_dir)
    return P.placement_sites(c, J.placement(c)).groupBy("corpus", "glyph", "side", "class").agg(F.count("*").alias("sites"))


def rarity_tally(spark, sf_dir):
    c = chapters(spark, sf_dir)
    return P.rarity_sites(c, J.rarity(c)).groupBy("corpus", "glyph").agg(F.count("*").alias("sites"))


def site_reasons(spark, sf_dir):
    c = chapters(spark, sf_dir)
    return P.reasons(("placement", P.placement_sites(c, J.placement(c))), ("rarity", P.rarity_sites(c, J.rarity(c))))


# histories


def saves(spark, sf_dir):
    """Events as saves of histories; every eleventh clock is reset to 2000, some to the far future."""
    e = table(spark, sf_dir, "events")
    at = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    k = F.col("event_id")
    clock = F.when(k % 11 < 2, 946_684_800 + k).when(k % 37 == 5, 4_000_000_000 - k).otherwise(at)
    return e.select((F.col("user_id") % 50).alias("book"), k.alias("seq"), clock.alias("author_at"), (clock + k % 90).alias("committer_at"), F.col("event_type").alias("chunk"), (F.floor("value").cast("long") % 7).alias("verses"))


_CLOCK = "CASE WHEN event_id % 11 < 2 THEN 946684800 + event_id WHEN event_id % 37 = 5 THEN 4000000000 - event_id ELSE date_diff('second', TIMESTAMP '1970-01-01', date_trunc('second', ts)) END"
SAVES_SQL = f"SELECT user_id % 50 AS book, event_id AS seq, ({_CLOCK})::bigint AS author_at, ({_CLOCK} + event_id % 90)::bigint AS committer_at, event_type AS chunk, floor(value)::bigint % 7 AS verses FROM events"
CLOCKS_SQL = T.repaired_clocks_sql(SAVES_SQL, LATEST)
LINE_SQL = f"""SELECT merge_at, book, seq, chunk FROM (SELECT *, max(estimate_at) OVER (PARTITION BY book ORDER BY seq ROWS UNBOUNDED PRECEDING) AS merge_at, lag(verses) OVER (PARTITION BY book, chunk ORDER BY seq) AS was,
row_number() OVER (PARTITION BY book, chunk ORDER BY seq) AS k FROM ({CLOCKS_SQL})) WHERE k = 1 OR was <> verses"""
PROGRESS_SQL = f"SELECT book, seq, (sum(delta) OVER (PARTITION BY book ORDER BY seq ROWS UNBOUNDED PRECEDING))::bigint AS verses_present FROM (SELECT book, seq, verses - coalesce(lag(verses) OVER (PARTITION BY book, chunk ORDER BY seq), 0) AS delta FROM ({SAVES_SQL}))"


# numbering schemes


def schemes(spark, sf_dir):
    """Two schemes of the sources: `alt` starts chapter 2 at a title, merges two verses of 3, splits one of 4 and moves the end of 5."""
    d = table(spark, sf_dir, "documents")
    hub = d.groupBy(F.col("source").alias("book"), (F.col("doc_id") % 5 + 1).cast("int").alias("chapter")).agg((F.count("*") % 9 + 6).cast("int").alias("last"))
    c = F.col("chapter")
    alt = F.col("last") + F.when(c == 2, -1).when(c == 3, 1).when(c == 4, -1).otherwise(0)
    counts = hub.select(F.lit("hub").alias("scheme"), "book", "chapter", "last").union(hub.select(F.lit("alt"), "book", "chapter", alt.cast("int")))
    row = lambda ch, v, tc, tv, n, shape: hub.filter(c == ch).select(F.lit("alt").alias("scheme"), F.col("book").alias("from_book"), F.lit(ch).alias("from_chapter"), F.lit(v).alias("from_verse"), F.col("book").alias("to_book"), F.lit(tc).alias("to_chapter"), F.lit(tv).alias("to_verse"), F.lit(None).cast("string").alias("to_part"), n.cast("int").alias("len"), F.lit(shape).alias("shape"))
    rows = row(2, 0, 2, 1, F.col("last"), "Parallel").union(row(3, 2, 3, 2, F.lit(2), "Merge")).union(row(3, 4, 3, 3, F.col("last") - 2, "Parallel")).union(row(4, 4, 4, 4, F.lit(2), "Split")).union(row(4, 5, 4, 6, F.col("last") - 5, "Parallel")).union(row(5, 6, 1, 1, F.lit(1), "Parallel"))
    return counts, rows


def renumbering(spark, sf_dir):
    counts, rows = schemes(spark, sf_dir)
    verses = V.numbered(counts.withColumn("last", F.col("last") + 1)).filter("scheme = 'alt'")  # one past the end too
    return V.renumbered(verses, counts, rows, "alt", "hub")


RENUMBER_SQL = """WITH hub AS (SELECT source AS book, (doc_id % 5 + 1)::int AS chapter, (count(*) % 9 + 6)::int AS last FROM documents GROUP BY 1, 2),
alt AS (SELECT book, chapter, last + CASE chapter WHEN 2 THEN -1 WHEN 3 THEN 1 WHEN 4 THEN -1 ELSE 0 END AS last, last AS hub_last FROM hub),
v AS (SELECT book, chapter, last, hub_last, unnest(range(0, last + 2))::int AS verse FROM alt),
t AS (SELECT v.*, unnest(CASE WHEN verse > last THEN []::int[] WHEN chapter = 2 THEN [verse + 1] WHEN chapter = 3 AND verse = 3 THEN [2] WHEN chapter = 3 AND verse > 3 THEN [verse - 1] WHEN chapter = 4 AND verse = 4 THEN [4, 5] WHEN chapter = 4 AND verse > 4 THEN [verse + 1] ELSE [verse] END) AS to_verse, CASE WHEN chapter = 5 AND verse = 6 THEN 1 ELSE chapter END AS to_chapter FROM v),
u AS (SELECT book, chapter, verse, CASE WHEN chapter = 5 AND verse = 6 THEN 1 ELSE to_verse END AS to_verse, to_chapter FROM t),
w AS (SELECT u.* FROM u JOIN hub h ON h.book = u.book AND h.chapter = u.to_chapter AND u.to_verse <= h.last),
x AS (SELECT *, count(*) OVER (PARTITION BY book, to_chapter, to_verse) AS sharing FROM w),
g AS (SELECT book, chapter, verse, count(*) AS n, max(sharing) AS sharing, min(to_chapter) AS tc, min(to_verse) AS tv, string_agg(book || ' ' || to_chapter || ':' || to_verse, '; ' ORDER BY to_chapter, to_verse) AS there FROM x GROUP BY 1, 2, 3)
SELECT v.book, v.chapter, v.verse, CASE WHEN n IS NULL THEN 'Absent' WHEN n > 1 THEN 'Split' WHEN sharing > 1 THEN 'Merged' WHEN tc = v.chapter AND tv = v.verse THEN 'Same' ELSE 'Moved' END AS verdict, coalesce(there, '') AS there FROM v LEFT JOIN g USING (book, chapter, verse)"""


def verse_units(spark, sf_dir):
    """(book, chapter, at, first, last, begin, end) of documents: numbers by their lengths, some bridges, some malformed (0)."""
    d = table(spark, sf_dir, "documents")
    first = (F.col("n_chars") % 23).cast("int")
    return d.select(F.col("source").alias("book"), (F.col("doc_id") % 5 + 1).cast("int").alias("chapter"), F.col("doc_id").alias("at"), first.alias("first"), F.when(F.col("doc_id") % 7 == 0, first + 2).otherwise(first).alias("last"), (F.col("doc_id") * 10).alias("begin"), (F.col("doc_id") * 10 + 9).alias("end"))


UNITS_SQL = 'SELECT source AS book, (doc_id % 5 + 1)::int AS chapter, doc_id AS at_, (n_chars % 23)::int AS first, (n_chars % 23)::int + CASE WHEN doc_id % 7 = 0 THEN 2 ELSE 0 END AS last, doc_id * 10 AS begin_, doc_id * 10 + 9 AS end_ FROM documents'
INVENTORY_SQL = f"""WITH u AS (SELECT * FROM ({UNITS_SQL}) WHERE first > 0),
b AS (SELECT book, chapter, coalesce(bool_or(back), false) AS out_of_order FROM (SELECT *, first < lag(first) OVER (PARTITION BY book, chapter ORDER BY at_) AS back FROM u) GROUP BY 1, 2),
e AS (SELECT book, chapter, verse, count(*) AS times FROM (SELECT book, chapter, unnest(range(first, last + 1)) AS verse FROM u) GROUP BY 1, 2, 3),
c AS (SELECT book, chapter, count(*) AS verses, max(verse)::int AS last, bool_or(times > 1) AS duplicate FROM e GROUP BY 1, 2)
SELECT book, chapter, verses, last, verses <> last AS gap, duplicate, out_of_order, verses <> last OR duplicate OR out_of_order AS defective FROM c JOIN b USING (book, chapter)"""


def beyond_scheme(spark, sf_dir):
    counts, _ = schemes(spark, sf_dir)
    return V.beyond_scheme(verse_units(spark, sf_dir), counts, "hub")


BEYOND_SQL = f"""WITH h AS (SELECT source AS book, (doc_id % 5 + 1)::int AS chapter, (count(*) % 9 + 6)::int AS n FROM documents GROUP BY 1, 2), t AS (SELECT u.book, u.chapter, last AS e, n FROM ({UNITS_SQL}) u JOIN h USING (book, chapter) WHERE first > 0)
SELECT DISTINCT book, chapter, 'verse-beyond-scheme' AS code, e AS verse FROM t WHERE e > n UNION ALL SELECT book, chapter, 'chapter-ends-early', max(e) FROM t GROUP BY book, chapter, n HAVING max(e) < n"""


def census(spark, sf_dir):
    """Chapters and verses of every marked-up book."""
    rows = M.verse_rows(books(spark, sf_dir))
    return rows.groupBy("book").agg(F.countDistinct("chapter").alias("chapters"), F.count("*").alias("verses"))


# references


def _reference_texts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    a, b = F.col("doc_id") % 40 + 1, F.col("n_chars") % 30 + 1
    first = F.concat(F.lit("GEN "), a, F.lit(":"), b)
    rest = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("-"), b + 2)).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("-"), a + 1, F.lit(":"), F.lit("3"))).otherwise("")
    more = F.concat(F.lit(", "), b + 5, F.lit("; EXO "), a, F.lit("; "), a + 1, F.lit("-"), a + 2, F.lit("; JUD 3; PSA 0; MAT"))
    return d.select(F.col("doc_id").alias("id"), F.concat(first, rest, more).alias("text"))


REFERENCES_SQL = """SELECT doc_id AS id, 'GEN ' || a || ':' || b || CASE doc_id % 4 WHEN 0 THEN '-' || (b + 2) WHEN 1 THEN '-' || (a + 1) || ':3' ELSE '' END || '; GEN ' || CASE WHEN doc_id % 4 = 1 THEN a + 1 ELSE a END || ':' || (b + 5) || '; EXO ' || a || '; EXO ' || (a + 1) || '-' || (a + 2) || '; JUD 1:3; PSA 0; MAT' AS text
FROM (SELECT doc_id, doc_id % 40 + 1 AS a, n_chars % 30 + 1 AS b FROM documents)"""


def addresses(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    a = d.select(F.col("doc_id").alias("id"), F.col("source").alias("book"), (F.col("doc_id") % 6 + 1).cast("int").alias("chapter"), (F.col("n_chars") % 29).cast("int").alias("verse"))
    return R.resolved(a, verse_units(spark, sf_dir))


ADDRESSES_SQL = f"""WITH a AS (SELECT doc_id AS id, source AS book, (doc_id % 6 + 1)::int AS chapter, (n_chars % 29)::int AS verse FROM documents), u AS ({UNITS_SQL}),
j AS (SELECT a.id, a.verse, u.*, a.verse BETWEEN u.first AND u.last AS c FROM a LEFT JOIN u ON u.book = a.book AND u.chapter = a.chapter),
g AS (SELECT id, count(*) FILTER (c) AS n, count(first) AS k, min(first) FILTER (c) AS f, min(last) FILTER (c) AS l, min(begin_) FILTER (c) AS b, min(end_) FILTER (c) AS e FROM j GROUP BY 1)
SELECT id, CASE WHEN k = 0 THEN 'missing-chapter' WHEN n = 0 THEN 'missing-verse' WHEN n > 1 THEN 'ambiguous' ELSE 'found' END AS verdict, CASE WHEN n = 1 THEN f END AS first, CASE WHEN n = 1 THEN l END AS last, CASE WHEN n = 1 THEN b END AS begin, CASE WHEN n = 1 THEN e END AS "end" FROM g"""

QUERIES = {
    "find_literal": lambda s, d: S.hits(texts(s, d), "tion"),
    "find_folded_word": lambda s, d: S.hits(texts(s, d), "THE", fold_case=True, whole_word=True),
    "find_lines": find_lines,
    "offset_units": offset_units,
    "mask_pieces": mask_pieces,
    "placement_sites": placement_tally,
    "rarity_sites": rarity_tally,
    "site_reasons": site_reasons,
    "clock_repair": lambda s, d: T.repaired_clocks(saves(s, d), LATEST),
    "merged_line": lambda s, d: T.merged_line(T.repaired_clocks(saves(s, d), LATEST)),
    "progress_series": lambda s, d: T.progress(saves(s, d)),
    "scheme_renumbering": renumbering,
    "verse_inventory": lambda s, d: V.inventory(verse_units(s, d)),
    "scheme_bounds": beyond_scheme,
    "book_census": census,
    "reference_lists": lambda s, d: R.spelled(R.parsed(_reference_texts(s, d))),
    "address_lookup": addresses,
}
ORACLES = {
    "find_literal": _hits_sql("tion"),
    "find_folded_word": _hits_sql("the", True, True),
    "find_lines": FIND_LINES_SQL,
    "offset_units": OFFSETS_SQL,
    "mask_pieces": PIECES_SQL,
    "placement_sites": f"SELECT corpus, glyph, side, class, numerator AS sites FROM ({J.placement_sql()})",
    "rarity_sites": f"SELECT corpus, glyph, numerator AS sites FROM ({J.rarity_sql()})",
    "clock_repair": CLOCKS_SQL,
    "merged_line": LINE_SQL,
    "progress_series": PROGRESS_SQL,
    "scheme_renumbering": RENUMBER_SQL,
    "verse_inventory": INVENTORY_SQL,
    "scheme_bounds": BEYOND_SQL,
    "book_census": f"SELECT book, count(DISTINCT chapter) AS chapters, count(*) AS verses FROM ({VERSE_ROWS_SQL}) GROUP BY 1",
    "reference_lists": REFERENCES_SQL,
    "address_lookup": ADDRESSES_SQL,
}
