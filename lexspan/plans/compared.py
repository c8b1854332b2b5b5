"""Queries that compare: turns of conversations against each other, two languages' lines, and words against words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..binding import CHAPTERS_SQL, chapters, table
from ..functions.text import words_sql
from ..operators import census as C
from ..operators import compare as K


def units(spark: SparkSession, sf_dir: str, corpus: str) -> DataFrame:
    """Documents of a language as units: book = source, chapter = doc_id mod 40, bridges where the document's length says so."""
    d = table(spark, sf_dir, "documents").filter(F.col("lang") == corpus)
    chapter, first = (F.col("doc_id") % 7).cast("int"), (F.col("n_chars") % 23).cast("int") + 1
    return d.select(F.col("source").alias("book"), chapter.alias("chapter"), first.alias("first"), F.when(F.col("n_chars") % 5 == 0, first + 2).otherwise(first).alias("last"), F.col("doc_id").alias("at"), "text")


def _units_sql(corpus: str) -> str:
    return f"SELECT source AS book, (doc_id % 7)::int AS chapter, (n_chars % 23)::int + 1 AS first, (n_chars % 23)::int + 1 + CASE WHEN n_chars % 5 = 0 THEN 2 ELSE 0 END AS last, doc_id AS at_, text FROM documents WHERE lang = '{corpus}'"


def pairing(spark, sf_dir):
    return K.paired(units(spark, sf_dir, "fr"), units(spark, sf_dir, "de"))


PAIRING_SQL = f"""WITH t0 AS ({_units_sql('fr')}), s0 AS ({_units_sql('de')}),
t AS (SELECT book, chapter, first, last, row_number() OVER (PARTITION BY book, chapter, first, last ORDER BY at_)::int AS ordinal, count(*) OVER (PARTITION BY book, chapter, first, last) AS times, text FROM t0),
s AS (SELECT book, chapter, first, last, row_number() OVER (PARTITION BY book, chapter, first, last ORDER BY at_)::int AS ordinal, count(*) OVER (PARTITION BY book, chapter, first, last) AS times, text FROM s0),
tk AS (SELECT DISTINCT book, chapter, first, last, times AS tn FROM t), sk AS (SELECT DISTINCT book, chapter, first, last, times AS sn FROM s),
b AS (SELECT book, chapter, first, last, ordinal, t.text AS target_text, s.text AS source_text, tn, sn FROM t FULL JOIN s USING (book, chapter, first, last, ordinal) LEFT JOIN tk USING (book, chapter, first, last) LEFT JOIN sk USING (book, chapter, first, last)),
l AS (SELECT * FROM b WHERE sn IS NULL), r AS (SELECT * FROM b WHERE tn IS NULL),
lc AS (SELECT x.book, x.chapter, x.first, x.last, string_agg(o.source_text, ' ' ORDER BY o.first) AS joined FROM (SELECT DISTINCT book, chapter, first, last FROM l WHERE first < last) x JOIN r o ON o.book = x.book AND o.chapter = x.chapter AND o.first = o.last AND o.first BETWEEN x.first AND x.last GROUP BY x.book, x.chapter, x.first, x.last HAVING count(*) = x.last - x.first + 1 AND count(DISTINCT o.first) = count(*)),
rc AS (SELECT x.book, x.chapter, x.first, x.last, string_agg(o.target_text, ' ' ORDER BY o.first) AS joined FROM (SELECT DISTINCT book, chapter, first, last FROM r WHERE first < last) x JOIN l o ON o.book = x.book AND o.chapter = x.chapter AND o.first = o.last AND o.first BETWEEN x.first AND x.last GROUP BY x.book, x.chapter, x.first, x.last HAVING count(*) = x.last - x.first + 1 AND count(DISTINCT o.first) = count(*)),
br AS (SELECT l.book, l.chapter, l.first, l.last, l.ordinal, 'bridge' AS kind, l.target_text, joined AS source_text FROM l JOIN lc USING (book, chapter, first, last)
  UNION ALL SELECT r.book, r.chapter, r.first, r.last, r.ordinal, 'bridge', joined, r.source_text FROM r JOIN rc USING (book, chapter, first, last)),
lf AS (SELECT *, 'target_only' AS k FROM l WHERE NOT EXISTS (SELECT 1 FROM br WHERE br.book = l.book AND br.chapter = l.chapter AND l.first >= br.first AND l.last <= br.last)),
rf AS (SELECT *, 'source_only' AS k FROM r WHERE NOT EXISTS (SELECT 1 FROM br WHERE br.book = r.book AND br.chapter = r.chapter AND r.first >= br.first AND r.last <= br.last))
SELECT book, chapter, first, last, ordinal, 'exact' AS kind, target_text, source_text FROM b WHERE tn = sn
UNION ALL SELECT book, chapter, first, last, ordinal, 'ambiguous', target_text, source_text FROM b WHERE tn <> sn
UNION ALL SELECT * FROM br
UNION ALL SELECT book, chapter, first, last, ordinal, CASE WHEN EXISTS (SELECT 1 FROM r o WHERE o.book = lf.book AND o.chapter = lf.chapter AND lf.first <= o.last AND o.first <= lf.last) THEN 'overlap' ELSE k END, target_text, source_text FROM lf
UNION ALL SELECT book, chapter, first, last, ordinal, CASE WHEN EXISTS (SELECT 1 FROM l o WHERE o.book = rf.book AND o.chapter = rf.chapter AND rf.first <= o.last AND o.first <= rf.last) THEN 'overlap' ELSE k END, target_text, source_text FROM rf"""


def turn_lengths(spark, sf_dir) -> DataFrame:
    """Each turn against the one before it: (book, chapter, first, target_n, source_n)."""
    c = table(spark, sf_dir, "conversations")
    a = c.select(F.col("conv_id"), "turn", F.col("role").alias("book"), F.char_length("text").cast("long").alias("target_n")).filter("turn > 0")
    b = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.char_length("text").cast("long").alias("source_n"))
    return a.join(b, ["conv_id", "turn"]).select("book", F.col("conv_id").alias("chapter"), F.col("turn").alias("first"), "target_n", "source_n")


def length_outliers(spark, sf_dir):
    return K.length_outliers(turn_lengths(spark, sf_dir))


LENGTHS_SQL = """WITH r AS (SELECT *, target_n / source_n AS ratio FROM (SELECT a.role AS book, a.conv_id AS chapter, a.turn AS first, length(a.text) AS target_n, length(b.text) AS source_n FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1 WHERE a.turn > 0) WHERE target_n > 0 AND source_n > 0),
bm AS (SELECT book, median(ratio) AS med, count(*) AS n FROM r GROUP BY 1), pm AS (SELECT median(ratio) AS med, count(*) AS n FROM r),
bd AS (SELECT r.*, med, n, ratio - med AS d FROM r JOIN bm USING (book)), pd AS (SELECT r.*, med, n, ratio - med AS d FROM r, pm),
bs AS (SELECT book, any_value(med) AS med, any_value(n) AS n, CASE WHEN count(*) FILTER (d > 0) >= 3 AND median(d) FILTER (d > 0) > 0 THEN median(d) FILTER (d > 0) ELSE median(abs(d)) END AS up, CASE WHEN count(*) FILTER (d < 0) >= 3 AND median(-d) FILTER (d < 0) > 0 THEN median(-d) FILTER (d < 0) ELSE median(abs(d)) END AS down FROM bd GROUP BY 1),
ps AS (SELECT any_value(med) AS med, any_value(n) AS n, CASE WHEN count(*) FILTER (d > 0) >= 3 AND median(d) FILTER (d > 0) > 0 THEN median(d) FILTER (d > 0) ELSE median(abs(d)) END AS up, CASE WHEN count(*) FILTER (d < 0) >= 3 AND median(-d) FILTER (d < 0) > 0 THEN median(-d) FILTER (d < 0) ELSE median(abs(d)) END AS down FROM pd),
z AS (SELECT r.*, CASE WHEN bs.n >= 50 AND (CASE WHEN ratio >= bs.med THEN bs.up ELSE bs.down END) > 0 THEN round(0.6745 * (ratio - bs.med) / (CASE WHEN ratio >= bs.med THEN bs.up ELSE bs.down END), 6) END AS book_z,
CASE WHEN ps.n >= 50 AND (CASE WHEN ratio >= ps.med THEN ps.up ELSE ps.down END) > 0 THEN round(0.6745 * (ratio - ps.med) / (CASE WHEN ratio >= ps.med THEN ps.up ELSE ps.down END), 6) END AS project_z FROM r JOIN bs USING (book), ps)
SELECT book, chapter, first, target_n, source_n, book_z, project_z FROM z WHERE abs(book_z) > 3.5 OR abs(project_z) > 3.5"""


def presence(spark, sf_dir):
    """French against German documents as verses 1-40 of chapters of a source."""
    d = table(spark, sf_dir, "documents")
    v = d.groupBy("lang", F.col("source").alias("book"), (F.col("doc_id") % 3).cast("int").alias("chapter"), (F.col("n_chars") % 29).cast("int").alias("verse")).agg(F.min("n_chars").alias("n"))
    text = F.when(F.col("n") % 4 == 0, "").otherwise("x").alias("text")
    return K.presence(v.filter("lang = 'fr'").select("book", "chapter", "verse", text), v.filter("lang = 'de'").select("book", "chapter", "verse", text))


PRESENCE_SQL = """WITH v AS (SELECT lang, source AS book, (doc_id % 3)::int AS chapter, (n_chars % 29)::int AS verse, CASE WHEN min(n_chars) % 4 = 0 THEN 0 ELSE 1 END AS n FROM documents GROUP BY 1, 2, 3, 4),
b AS (SELECT book, chapter, verse, CASE WHEN t.n IS NULL THEN 'Missing' WHEN s.n IS NULL THEN 'Extra' WHEN t.n = 0 AND s.n > 0 THEN 'Empty' END AS kind FROM (SELECT * FROM v WHERE lang = 'fr') t FULL JOIN (SELECT * FROM v WHERE lang = 'de') s USING (book, chapter, verse)),
r AS (SELECT *, verse - row_number() OVER (PARTITION BY book, chapter, kind ORDER BY verse) AS run FROM b WHERE kind IS NOT NULL)
SELECT book, chapter, kind, min(verse) AS first, max(verse) AS last, count(*) AS keys FROM r GROUP BY book, chapter, kind, run"""


def copied_runs(spark, sf_dir):
    """Turns that repeat runs of words of the turn before."""
    c = table(spark, sf_dir, "conversations")
    b = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("source"))
    both = c.select("conv_id", "turn", F.col("text").alias("target")).join(b, ["conv_id", "turn"])
    return K.copied_runs(both.select(F.concat_ws(":", "conv_id", "turn").alias("unit"), "target", "source"))


COPIED_SQL = f"""WITH p AS (SELECT a.conv_id || ':' || a.turn AS unit, {words_sql('a.text')} AS t, {words_sql('b.text')} AS s FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1),
m AS (SELECT unit, len(t)::bigint AS eligible, list_max(list_transform(string_split_regex(list_aggregate(list_transform(t, lambda x: CASE WHEN list_contains(s, x) THEN '1' ELSE '0' END), 'string_agg', ''), '0+'), lambda x: length(x)))::bigint AS run FROM p WHERE len(t) > 0)
SELECT unit, eligible, run FROM m WHERE run >= 3"""


def typos(spark, sf_dir):
    forms = C.word_forms(chapters(spark, sf_dir)).groupBy("corpus", "word").agg(F.sum("n").alias("n"), F.sum("title").alias("title"))
    return K.typos(forms)


TYPOS_SQL = f"""WITH {C.WORD_FORMS_SQL}, f AS (SELECT corpus, word, sum(n)::bigint AS n, sum(title) AS title FROM word_forms GROUP BY 1, 2 HAVING length(word) >= 4),
v AS (SELECT DISTINCT corpus, word, n, n < 5 AND title = 0 AS rare, unnest(list_append(list_transform(range(1, length(word) + 1), lambda i: left(word, i - 1) || substring(word, i + 1)), word)) AS variant FROM f WHERE n >= 200 OR n < 5 AND title = 0),
c AS (SELECT DISTINCT r.corpus, r.word, r.n, t.word AS target, t.n AS target_n FROM v r JOIN v t ON r.corpus = t.corpus AND r.variant = t.variant AND r.rare AND t.n >= 200 AND left(r.word, 1) = left(t.word, 1) AND r.word <> t.word)
SELECT * FROM c WHERE len(list_filter(range(1, greatest(length(word), length(target)) + 1), lambda i: CASE
  WHEN length(word) = length(target) THEN left(word, i - 1) = left(target, i - 1) AND (substring(word, i + 1) = substring(target, i + 1) OR (substring(word, i, 1) = substring(target, i + 1, 1) AND substring(word, i + 1, 1) = substring(target, i, 1) AND substring(word, i + 2) = substring(target, i + 2)))
  WHEN length(word) > length(target) THEN left(word, i - 1) || substring(word, i + 1) = target
  ELSE left(target, i - 1) || substring(target, i + 1) = word END)) > 0"""

QUERIES = {"verse_pairing": pairing, "length_outliers": length_outliers, "presence_runs": presence, "copied_runs": copied_runs, "typo_candidates": typos}
ORACLES = {"verse_pairing": PAIRING_SQL, "length_outliers": LENGTHS_SQL, "presence_runs": PRESENCE_SQL, "copied_runs": COPIED_SQL, "typo_candidates": TYPOS_SQL}
