"""Queries over two versions of books, edits, attribute lists, trees, and totals that follow changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..binding import chapters, table
from ..operators import attributes as A
from ..operators import census as C
from ..operators import diff as D
from ..operators import formatting as L
from ..operators import judge as J
from ..operators import markup as M
from ..operators import tree as N
from ..sources import writers as W
from ..streaming import incremental as I
from .marked import BOOKS_SQL, CONTENTS_SQL, VERSE_ROWS_SQL, books


def revised(old):
    """A later version of the books: verses retouched, rebridged, dropped, put out of order; headings renamed."""
    k = F.regexp_extract("book", "[0-9]+", 0).cast("int")
    src = F.col("src")
    for n, a, b in _EDITS:
        src = F.when(k % 5 == n, F.replace(src, F.lit(a), F.lit(b))).otherwise(src)
    return old.select("book", src.alias("src"))


#: documents' number mod 5, what stands, what comes in its place
_EDITS = ((0, "\\v 2 ", "\\v 2 new "), (0, "\\v 3 ", "\\v 3  "), (1, "\\v 4 ", "\\v 4-5 "), (1, "\\s1 ", "\\s1 New "), (2, "\\v 5 ", "\\v 15 "), (2, "\\p\n", "\\m\n"), (3, "\\c 1\n\\p\n", "\\c 1\n\\p\n\\v 99 first\n"))


def _revised_sql() -> str:
    src = "src"
    for n, a, b in _EDITS:
        lit = lambda s: "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
        src = f"CASE WHEN regexp_extract(book, '[0-9]+')::int % 5 = {n} THEN replace({src}, {lit(a)}, {lit(b)}) ELSE {src} END"
    return f"WITH {BOOKS_SQL} SELECT book, {src} AS src FROM books"


def _merged(default):
    def query(spark, sf_dir):
        old = books(spark, sf_dir)
        none = spark.createDataFrame([], "book string, id string, side string")
        return D.merged(D.diff(old, revised(old)), none, default)

    return query


def diff_units(spark, sf_dir):
    old = books(spark, sf_dir)
    return D.diff(old, revised(old)).select("book", "id", "slot", "kind", "status", "whitespace", "markup")


def diff_changes(spark, sf_dir):
    """What a diff says of one word put into every second verse and of one verse put at the end."""
    old = books(spark, sf_dir)
    new = old.select("book", F.concat(F.replace("src", F.lit("\\v 2 "), F.lit("\\v 2 new ")), F.lit("\\v 98 added\n")).alias("src"))
    return D.diff(old, new).filter("status <> 'Unchanged'").groupBy("book", "kind", "status").agg(F.count("*").alias("n"))


DIFF_CHANGES_SQL = rf"WITH {BOOKS_SQL}, n AS (SELECT book, ((length(src) - length(replace(src, '\v 2 ', ''))) // 5)::bigint AS n FROM books) SELECT book, 'Shared' AS kind, 'Modified' AS status, n FROM n WHERE n > 0 UNION ALL SELECT book, 'Added', 'Added', 1 FROM n"

_ESCAPED = "replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
HTML_SQL = rf"""WITH {CONTENTS_SQL},
p AS (SELECT book, pos, text, coalesce(marker, opens) AS m, regexp_extract(text, '^(\S+)', 1) AS number, regexp_replace(text, '^\S+[ ]?', '') AS rest, CASE WHEN kind = 'Text' THEN CASE opens WHEN 'c' THEN 'chapter' WHEN 'v' THEN 'verse' ELSE 'text' END WHEN kind = 'Marker' AND marker NOT IN ('c', 'v') THEN 'para' END AS what FROM ctx WHERE kind <> 'Newline')
SELECT book, '<article lang="und">' || string_agg(CASE what WHEN 'para' THEN '<p class="' || m || '">' WHEN 'chapter' THEN '<h2>' || number || '</h2>' || {_ESCAPED.format('rest')} WHEN 'verse' THEN '<sup>' || number || '</sup>' || {_ESCAPED.format('rest')} ELSE {_ESCAPED.format('text')} END, '' ORDER BY pos) || '</article>' AS html FROM p WHERE what IS NOT NULL GROUP BY 1"""


def block_texts(spark, sf_dir):
    """The blocks of every book put together again."""
    b = D.blocks(books(spark, sf_dir))
    return b.groupBy("book").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "").alias("src"))


def spliced(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    b = d.select(F.col("doc_id").cast("string").alias("book"), F.col("text").alias("src"))
    n = F.char_length(F.col("text"))
    edit = lambda at, a, z, t: F.struct(F.lit(at).alias("at"), a.cast("int").alias("begin"), z.cast("int").alias("end"), t.alias("put"))
    third = (n / 3).cast("int")
    e = d.select(F.col("doc_id").cast("string").alias("book"), F.inline(F.array(edit(0, third, F.when(F.col("doc_id") % 5 == 0, third * 2 + 1).otherwise(third + F.least(n - third, F.lit(2))), F.lit("[A]")), edit(1, third * 2, third * 2 + F.when(F.col("doc_id") % 7 == 0, 100).otherwise(0), F.lit("<B>")))))
    return D.spliced(b, e)


SPLICED_SQL = """SELECT book, CASE WHEN error IS NULL THEN left(src, t) || '[A]' || substring(src, z + 1, 2 * t - z) || '<B>' || substring(src, 2 * t + CASE WHEN doc_id % 7 = 0 THEN 100 ELSE 0 END + 1) ELSE src END AS src, error FROM (
SELECT *, CASE WHEN doc_id % 7 = 0 AND 2 * t + 100 > n OR z > n THEN 'out-of-range' WHEN 2 * t < z OR (t = 2 * t AND false) THEN 'overlap' END AS error FROM (
SELECT *, CASE WHEN doc_id % 5 = 0 THEN 2 * t + 1 ELSE t + least(n - t, 2) END AS z FROM (SELECT doc_id, doc_id::varchar AS book, text AS src, length(text) AS n, length(text) // 3 AS t FROM documents)))"""


def chunks_changed(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("book"), F.col("doc_id").alias("chunk"), "text")
    k = F.col("chunk")
    return D.changed_chunks(d.filter(k % 6 != 0), d.filter(k % 4 != 0).withColumn("text", F.when(k % 5 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text"))))


CHUNKS_SQL = "SELECT source AS book, doc_id AS chunk, CASE WHEN doc_id % 6 = 0 THEN 'new' WHEN doc_id % 4 = 0 THEN 'gone' ELSE 'changed' END AS change FROM documents WHERE (doc_id % 6 = 0 AND doc_id % 4 <> 0) OR (doc_id % 4 = 0 AND doc_id % 6 <> 0) OR (doc_id % 5 = 0 AND doc_id % 4 <> 0 AND doc_id % 6 <> 0)"


def attribute_lists(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    k, lang, n = F.col("doc_id").cast("string"), F.col("lang"), F.col("n_chars").cast("string")
    span = (
        F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("|"), lang, F.lit(" "), n))
        .when(F.col("doc_id") % 7 == 1, F.concat(F.lit('|lemma="'), lang, F.lit('" strong='), n))
        .when(F.col("doc_id") % 7 == 2, F.concat(F.lit('|x-id="'), k, F.lit('", lemma="a"')))
        .when(F.col("doc_id") % 7 == 3, F.concat(F.lit('| lemma="'), k))
        .when(F.col("doc_id") % 7 == 4, F.lit('|="x"'))
        .when(F.col("doc_id") % 7 == 5, F.concat(F.lit('|lemma="'), lang, F.lit(' '), n, F.lit('" '), F.lit('|')))
        .otherwise(F.concat(F.lit("|strong= "), n))
    )
    known = spark.createDataFrame([("w", "lemma", True), ("w", "strong", False), ("w", "a-*", False)], "marker string, attribute string, is_default boolean")
    found = A.attributes(d.select(F.col("doc_id").alias("id"), span.alias("span"))).withColumn("marker", F.lit("w"))
    return A.checked(found, known).select("id", "at", "name", "value", "malformed", "status")


ATTRIBUTES_SQL = """WITH d AS (SELECT doc_id AS id, doc_id % 7 AS k, lang, n_chars::varchar AS n, doc_id::varchar AS i FROM documents)
SELECT id, 0 AS at, '' AS name, lang || ' ' || n AS value, NULL AS malformed, 'defined' AS status FROM d WHERE k = 0
UNION ALL SELECT id, 0, 'lemma', lang, NULL, 'defined' FROM d WHERE k = 1 UNION ALL SELECT id, 1, 'strong', n, NULL, 'defined' FROM d WHERE k = 1
UNION ALL SELECT id, 0, 'x-id', i, NULL, 'user' FROM d WHERE k = 2 UNION ALL SELECT id, 1, NULL, NULL, 'bare-junk', 'malformed' FROM d WHERE k = 2
UNION ALL SELECT id, 0, NULL, NULL, 'unterminated-quote', 'malformed' FROM d WHERE k = 3 UNION ALL SELECT id, 0, NULL, NULL, 'empty-name', 'malformed' FROM d WHERE k = 4
UNION ALL SELECT id, 0, 'lemma', lang || ' ' || n, NULL, 'defined' FROM d WHERE k = 5 UNION ALL SELECT id, 0, NULL, NULL, 'missing-value', 'malformed' FROM d WHERE k = 6"""


def noted(spark, sf_dir):
    """The books with notes and spans put in, some left open."""
    k = F.regexp_extract("book", "[0-9]+", 0).cast("int")
    note = F.when(k % 3 == 0, "\\f + \\ft note\\f* ").when(k % 3 == 1, "\\f + \\ft open ").otherwise("\\add word\\add* \\nd* ")
    return books(spark, sf_dir).select("book", F.replace("src", F.lit(" the "), F.concat(F.lit(" the "), note)).alias("src"))


def structure(spark, sf_dir):
    return N.structure_lint(N.nodes(noted(spark, sf_dir)))


def moved_totals(spark, sf_dir):
    """Totals of marks after two sources leave and one comes back: the signed sums are those of a cold count."""
    c = C.runs(chapters(spark, sf_dir)).withColumnRenamed("run", "key")
    out, back = c.filter(F.col("book").isin("src1", "src2")), c.filter("book = 'src2'")
    totals = c.groupBy("corpus", "key").agg(F.sum("n").alias("n"), F.count("*").alias("holders"))
    return I.moved_totals(totals, out, back)


MOVED_SQL = f"WITH {C.RUNS_SQL} SELECT corpus, run AS key, sum(n)::bigint AS n, count(*) AS holders FROM (SELECT corpus, book, run, count(*) AS n FROM runs WHERE book <> 'src1' GROUP BY 1, 2, 3) GROUP BY 1, 2"


def judged_state(spark, sf_dir):
    """The placement claims judged from per-book counts, as the incremental run judges them."""
    c = chapters(spark, sf_dir)
    return I.judged(I.book_counts(c.select("corpus", F.col("chapter").cast("string").alias("book"), "text"))).drop("books")


def untidy(spark, sf_dir):
    """The books with white space gone astray."""
    k = F.regexp_extract("book", "[0-9]+", 0).cast("int")
    src = F.col("src")
    for n, a, b in _UNTIDY:
        src = F.when(k % 4 == n, F.replace(src, F.lit(a), F.lit(b))).otherwise(src)
    return books(spark, sf_dir).select("book", src.alias("src"))


_UNTIDY = ((0, "\n", "\r\n"), (1, "\\v ", "\\v   "), (2, "\n\\p\n", "  \\p \n\n"), (3, "\n", " \n\n"))


def _untidy_sql() -> str:
    src = "src"
    for n, a, b in _UNTIDY:
        lit = lambda s: "'" + s.replace("\r", "' || chr(13) || '").replace("\n", "' || chr(10) || '") + "'"
        src = f"CASE WHEN regexp_extract(book, '[0-9]+')::int % 4 = {n} THEN replace({src}, {lit(a)}, {lit(b)}) ELSE {src} END"
    return f"WITH {BOOKS_SQL} SELECT book, {src} AS src FROM books"


QUERIES = {
    "format_books": lambda s, d: L.formatted(untidy(s, d)),
    "format_twice": lambda s, d: L.formatted(L.formatted(untidy(s, d))),
    "format_findings": lambda s, d: L.rules_broken(untidy(s, d)),
    "diff_units": diff_units,
    "diff_changes": diff_changes,
    "diff_merge_new": _merged("new"),
    "diff_merge_old": _merged("old"),
    "block_texts": block_texts,
    "splices": spliced,
    "changed_chunks": chunks_changed,
    "attribute_lists": attribute_lists,
    "structure_lint": structure,
    "verse_lines": lambda s, d: W.verse_line_rows(books(s, d)),
    "export_html": lambda s, d: W.html(books(s, d)),
    "export_usx": lambda s, d: W.usx(noted(s, d)),
    "export_usj": lambda s, d: W.usj(books(s, d)),
    "moved_totals": moved_totals,
    "judged_state": judged_state,
}
#: Of noted(): notes left open end with the next marker, but for one that nothing follows; a closing marker alone is an orphan.
STRUCTURE_SQL = f"""WITH {BOOKS_SQL}, b AS (SELECT book, regexp_extract(book, '[0-9]+')::int % 3 AS k, (length(src) - length(replace(src, ' the ', ''))) // 5 AS n, contains(string_split(src, chr(92) || 'v ')[-1], ' the ') AND NOT contains(string_split(string_split(src, chr(92) || 'v ')[-1], ' the ')[-1], chr(92)) AS last FROM books)
SELECT book, 'unclosed-note' AS code, (n - CASE WHEN last THEN 1 ELSE 0 END)::bigint AS n FROM b WHERE k = 1 AND n > CASE WHEN last THEN 1 ELSE 0 END
UNION ALL SELECT book, 'unclosed-at-eof', 1 FROM b WHERE k = 1 AND last UNION ALL SELECT book, 'orphan-closer', n FROM b WHERE k = 2 AND n > 0"""

ORACLES = {
    "diff_changes": DIFF_CHANGES_SQL,
    "export_html": HTML_SQL,
    "structure_lint": STRUCTURE_SQL,
    "format_findings": L.rules_broken_sql(_untidy_sql()),
    "format_books": L.formatted_sql(_untidy_sql()),
    "format_twice": L.formatted_sql(_untidy_sql()),
    "diff_merge_new": _revised_sql(),
    "diff_merge_old": f"WITH {BOOKS_SQL} SELECT book, src FROM books",
    "block_texts": f"WITH {BOOKS_SQL} SELECT book, src FROM books",
    "splices": SPLICED_SQL,
    "changed_chunks": CHUNKS_SQL,
    "attribute_lists": ATTRIBUTES_SQL,
    "verse_lines": f"SELECT book, chapter, verse, book || ' ' || chapter || ':' || verse || chr(9) || text AS line FROM ({VERSE_ROWS_SQL})",
    "moved_totals": MOVED_SQL,
    "judged_state": f"SELECT corpus, glyph, side, class, numerator, denominator, ceiling_bp, share_bp FROM ({J.placement_sql()})",
}
