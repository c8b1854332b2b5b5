"""Counts over a corpus: the lanes that every judged channel reads.

Neither texts nor characters travel: each text is cut at its spaces where it is read, the distinct pieces are counted
map-side, and only distinct pieces are taken apart further, into words or characters, each with its piece's count. Classes
are given to the few distinct triples and words afterwards: after() keeps such a filter above the aggregation, where the
optimizer would run it once a character.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import BRACKET, CLOSER, CORE, DIRECTIONLESS, HAS_LETTER, LOOKALIKES, QUOTE, RUN, WORD, WORD_ONCE, char_class, char_class_sql, facing, facing_sql, fold, words_of_chunk, words_sql
from ..binding import CHAPTERS_SQL


def after(condition: Column) -> Column:
    """The condition, to be tested on the rows of an aggregation (n): not pushed below it."""
    return F.when(F.col("n") > 0, condition)


def once(**columns: Column) -> Column:
    """The columns, each computed once a row: a generator is not merged with what is above it, where a plain projection would
    be computed again in every place that names it."""
    return F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))


def chunks(chapter: DataFrame) -> DataFrame:
    """(corpus, book, chunk, n): the distinct stretches between spaces."""
    cut = chapter.select("corpus", "book", F.explode(F.split("text", " ")).alias("chunk"))
    return cut.groupBy("corpus", "book", "chunk").agg(F.count("*").alias("n"))


def stretches(chapter: DataFrame) -> DataFrame:
    """(corpus, book, held, times): the distinct stretches between spaces with the spaces beside them, so that they hold all
    that their characters see."""
    cut = chapter.select("corpus", "book", F.split("text", " ").alias("parts"))
    cut = cut.select("corpus", "book", (F.size("parts") - 1).alias("last"), F.posexplode("parts").alias("at", "part"))
    space = lambda here: F.when(here, " ").otherwise("")
    held = cut.select("corpus", "book", F.concat(space(F.col("at") > 0), "part", space(F.col("at") < F.col("last"))).alias("held"))
    return held.groupBy("corpus", "book", "held").agg(F.count("*").alias("times"))


def triples(chapter: DataFrame) -> DataFrame:
    """(corpus, book, before, glyph, after, n): every character but the space with its neighbours, null at the ends of a
    text."""
    rows = beside(stretches(chapter).filter("held <> ''").select("corpus", "book", "times", F.split("held", "").alias("chars")), "corpus", "book", "times")
    return rows.filter("glyph <> '' AND glyph <> ' '").groupBy("corpus", "book", "before", "glyph", "after").agg(F.sum("times").alias("n"))


#: A mark, anything else, and stretches that hold marks with all that they see: single characters between marks are shared.
_OTHER = "[\\n\\r \\t\\x{A0}\\x{2000}-\\x{200A}\\x{202F}\\x{3000}\\p{Nd}\\p{L}\\p{M}\\p{Nl}]"
MARK = f"[^{_OTHER[1:-1]}]"
_HELD = f"{_OTHER}?+{MARK}++(?:{_OTHER}{MARK}++)*+{_OTHER}?+"


def is_mark(glyph: Column) -> Column:
    """Of single characters: the nonletters. Most are plain letters or spaces, which need no regular expression."""
    plain = glyph.between("a", "z") | glyph.between("A", "Z") | glyph.isin(" ", "\n")
    return ~plain & glyph.rlike(f"^{MARK}$")


def marks(chapter: DataFrame) -> DataFrame:
    """(corpus, book, before, glyph, after, n): the nonletters of triples(), without taking letters apart: only the
    stretches that marks stand in leave a text."""
    found = chapter.select("corpus", "book", F.explode(F.regexp_extract_all("text", F.lit(_HELD), F.lit(0))).alias("held"))
    distinct = found.groupBy("corpus", "book", "held").agg(F.count("*").alias("times"))
    rows = beside(distinct.select("corpus", "book", "times", F.split("held", "").alias("chars")), "corpus", "book", "times")
    return rows.filter(is_mark(F.col("glyph"))).groupBy("corpus", "book", "before", "glyph", "after").agg(F.sum("times").alias("n"))


def beside(texts: DataFrame, *keep: str) -> DataFrame:
    """(keep.., before, glyph, after) of texts(keep.., chars), none of them empty: every character with its neighbours. Three
    arrays side by side stay inside generated code where a lambda would not."""
    c, n = F.col("chars"), F.size("chars") - 1
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice(c, F.lit(1), n))
    each = F.arrays_zip(before.alias("before"), c.alias("glyph"), F.slice(c, F.lit(2), n).alias("after"))
    return texts.select(*keep, F.inline(each)).toDF(*keep, "before", "glyph", "after")


TRIPLES_SQL = f"""
chars AS (SELECT corpus, book, chapter, unnest(string_split(text, '')) AS glyph, generate_subscripts(string_split(text, ''), 1) AS pos FROM ({CHAPTERS_SQL}) WHERE text <> ''),
triples AS (SELECT corpus, book, lag(glyph) OVER w AS before, glyph, lead(glyph) OVER w AS after FROM chars WINDOW w AS (PARTITION BY chapter ORDER BY pos))"""


def scalars(chapter: DataFrame) -> DataFrame:
    """(corpus, glyph, n, books): characters, digits pooled as 0-9."""
    pooled = F.when(F.col("glyph").rlike(r"^\p{Nd}$"), "0-9").otherwise(F.col("glyph"))
    # a text's distinct pieces are nearly as many as its pieces; its characters are few and are counted where it is read
    seen = chapter.select("corpus", "book", F.explode(F.split("text", "")).alias("glyph")).filter("glyph <> ''")
    by = seen.groupBy("corpus", "book", "glyph").agg(F.count("*").alias("n"))
    return by.withColumn("glyph", pooled).groupBy("corpus", "glyph").agg(F.sum("n").alias("n"), F.countDistinct("book").alias("books"))


SCALARS_SQL = f"""WITH {TRIPLES_SQL}
SELECT corpus, CASE WHEN regexp_matches(glyph, '^\\p{{Nd}}$') THEN '0-9' ELSE glyph END AS glyph, count(*) AS n, count(DISTINCT book) AS books FROM triples GROUP BY 1, 2"""


def pairs(chapter: DataFrame) -> DataFrame:
    """(corpus, glyph, before, after, n): nonletters by the classes of their neighbours."""
    t = marks(chapter)
    return t.groupBy("corpus", "glyph", char_class(F.col("before")).alias("before"), char_class(F.col("after")).alias("after")).agg(F.sum("n").alias("n"))


PAIRS_SQL = f"""WITH {TRIPLES_SQL}
SELECT corpus, glyph, {char_class_sql('before')} AS before, {char_class_sql('after')} AS after, count(*) AS n FROM triples WHERE {char_class_sql('glyph')} = 'Nonletter' GROUP BY 1, 2, 3, 4"""


def runs(chapter: DataFrame) -> DataFrame:
    """(corpus, book, run, n): maximal runs of marks."""
    found = chapter.select("corpus", "book", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    return found.groupBy("corpus", "book", "run").agg(F.count("*").alias("n"))


RUNS_SQL = f"runs AS (SELECT corpus, book, unnest(regexp_extract_all(text, '{RUN}')) AS run FROM ({CHAPTERS_SQL}))"


def _neighbours(df: DataFrame, column: str, pattern: str, *keep: str) -> DataFrame:
    """(keep.., run, before, after): maximal runs of a pattern (a class of characters) in a text and what stands outside."""
    outside = f"[^{pattern[1:-1]}]" if not pattern.startswith("[^") else f"[{pattern[2:-1]}]"
    u = F.col("units")
    split = df.select(*keep, F.regexp_extract_all(column, F.lit(f"{pattern}+|{outside}+"), F.lit(0)).alias("units"))
    each = F.transform(u, lambda x, i: F.struct(x.alias("run"), F.when(i > 0, F.right(F.get(u, i - 1), F.lit(1))).alias("before"), F.left(F.get(u, i + 1), F.lit(1)).alias("after")))
    return split.select(*keep, F.inline(each)).filter(F.col("run").rlike(f"^{pattern}"))


def faced_runs(chapter: DataFrame) -> DataFrame:
    """(corpus, book, run, facing, n): maximal runs of marks; facing only of runs with a quotation mark without direction."""
    r = _neighbours(stretches(chapter), "held", RUN[:-1], "corpus", "book", "times")
    r = r.groupBy("corpus", "book", "run", "before", "after").agg(F.sum("times").alias("n"))
    way = F.when(F.col("run").rlike(DIRECTIONLESS), facing(char_class(F.col("before")), char_class(F.col("after"))))
    return r.groupBy("corpus", "book", "run", way.alias("facing")).agg(F.sum("n").alias("n"))


def _units_sql(texts: str, column: str, pattern: str, keep: str) -> str:
    outside = f"[^{pattern[1:-1]}]" if not pattern.startswith("[^") else f"[{pattern[2:-1]}]"
    return f"""SELECT {keep}, u[i] AS run, CASE WHEN i > 1 THEN right(u[i - 1], 1) END AS before, CASE WHEN i < len(u) THEN left(u[i + 1], 1) END AS after FROM (SELECT {keep}, u, unnest(range(1, len(u) + 1)) AS i FROM (SELECT {keep}, regexp_extract_all({column}, '{pattern}+|{outside}+') AS u FROM ({texts}))) WHERE regexp_matches(u[i], '^{pattern}')"""


FACED_RUNS_SQL = f"""SELECT corpus, book, run, CASE WHEN regexp_matches(run, '{DIRECTIONLESS.replace("'", "''")}') THEN {facing_sql(char_class_sql('before'), char_class_sql('after'))} END AS facing, count(*) AS n FROM ({_units_sql(CHAPTERS_SQL, 'text', RUN[:-1], 'corpus, book')}) GROUP BY ALL"""


def follow_contexts(chapter: DataFrame) -> DataFrame:
    """(corpus, book, terminal, quoted, bracketed, upper, lower): the case of the letter after a mark, white space, and the
    quotation marks and brackets that ride along on either side of it: a quote marks the handoff quoted, a closing bracket
    bracketed."""
    hit = chapter.select("corpus", "book", F.explode(F.regexp_extract_all("text", F.lit(_HANDOFF), F.lit(0))).alias("hit")).groupBy("corpus", "book", "hit").agg(F.count("*").alias("n"))
    letter, n = F.right("hit", F.lit(1)), F.col("n")
    keys = [F.left("hit", F.lit(1)).alias("terminal"), F.col("hit").rlike(QUOTE).alias("quoted"), F.col("hit").rlike(CLOSER).alias("bracketed")]
    return hit.groupBy("corpus", "book", *keys).agg(F.sum(F.when(letter.rlike(r"\p{Lu}"), n).otherwise(0)).alias("upper"), F.sum(F.when(letter.rlike(r"\p{Ll}"), n).otherwise(0)).alias("lower"))


_RIDE = f"[{QUOTE[1:-1]}{BRACKET[1:-1]}]*"
_HANDOFF = f"[.!?,;:]{_RIDE}\\s+{_RIDE}\\p{{L}}"
FOLLOW_CONTEXTS_SQL = f"""SELECT corpus, book, left(hit, 1) AS terminal, regexp_matches(hit, '{QUOTE.replace("'", "''")}') AS quoted, regexp_matches(hit, '{CLOSER}') AS bracketed, count(*) FILTER (regexp_matches(right(hit, 1), '\\p{{Lu}}')) AS upper, count(*) FILTER (regexp_matches(right(hit, 1), '\\p{{Ll}}')) AS lower
FROM (SELECT corpus, book, unnest(regexp_extract_all(text, '{_HANDOFF.replace("'", "''")}')) AS hit FROM ({CHAPTERS_SQL})) GROUP BY 1, 2, 3, 4, 5"""


def lookalikes(chapter: DataFrame) -> DataFrame:
    """(corpus, a, b, a_n, b_n): pairs of different characters of one corpus that are drawn alike, the more frequent first."""
    spark = chapter.sparkSession
    table = spark.createDataFrame([(c, g) for g, cs in enumerate(LOOKALIKES) for c in cs], "glyph string, alike int")
    s = scalars(chapter).select("corpus", "glyph", "n").join(F.broadcast(table), "glyph")
    a, b = (s.select("corpus", "alike", F.col("glyph").alias(x), F.col("n").alias(f"{x}_n")) for x in ("a", "b"))
    return a.join(b, ["corpus", "alike"]).filter("a_n > b_n OR (a_n = b_n AND a < b)").select("corpus", "a", "b", "a_n", "b_n")


def _lookalikes_sql() -> str:
    rows = ", ".join("('" + c.replace("'", "''") + f"', {g})" for g, cs in enumerate(LOOKALIKES) for c in cs)
    return f"""WITH t(glyph, alike) AS (VALUES {rows}), s AS (SELECT corpus, glyph, n, alike FROM ({SCALARS_SQL}) JOIN t USING (glyph))
SELECT a.corpus, a.glyph AS a, b.glyph AS b, a.n AS a_n, b.n AS b_n FROM s a JOIN s b ON a.corpus = b.corpus AND a.alike = b.alike AND (a.n > b.n OR (a.n = b.n AND a.glyph < b.glyph))"""


def run_lengths(chapter: DataFrame) -> DataFrame:
    """(corpus, bucket, n, kinds): lengths of the runs, six and more together."""
    r = runs(chapter).withColumn("bucket", F.least(F.char_length("run"), F.lit(6)))
    return r.groupBy("corpus", "bucket").agg(F.sum("n").alias("n"), F.countDistinct("run").alias("kinds"))


RUN_LENGTHS_SQL = f"WITH {RUNS_SQL} SELECT corpus, least(length(run), 6)::int AS bucket, count(*) AS n, count(DISTINCT run) AS kinds FROM runs GROUP BY 1, 2"


def follows(chapter: DataFrame) -> DataFrame:
    """(corpus, book, terminal, upper, lower): the case of the letter after a mark and white space, bare context."""
    pat = r"([.!?,;:])\s+(\p{L})"
    t = chapter.select("corpus", "book", F.explode(F.regexp_extract_all("text", F.lit(pat), F.lit(0))).alias("hit"))
    t = t.select("corpus", "book", F.substring("hit", 1, 1).alias("terminal"), F.expr("right(hit, 1)").alias("letter"))
    return t.groupBy("corpus", "book", "terminal").agg(F.count_if(F.col("letter").rlike(r"\p{Lu}")).alias("upper"), F.count_if(F.col("letter").rlike(r"\p{Ll}")).alias("lower"))


FOLLOWS_SQL = f"""
hits AS (SELECT corpus, book, unnest(regexp_extract_all(text, '[.!?,;:]\\s+\\p{{L}}')) AS hit FROM ({CHAPTERS_SQL})),
follows AS (SELECT corpus, book, left(hit, 1) AS terminal, count(*) FILTER (regexp_matches(right(hit, 1), '\\p{{Lu}}')) AS upper, count(*) FILTER (regexp_matches(right(hit, 1), '\\p{{Ll}}')) AS lower FROM hits GROUP BY 1, 2, 3)"""


def word_forms(chapter: DataFrame) -> DataFrame:
    """(corpus, book, word, lower, title, upper, mixed, n): how each folded word is cased."""
    w = chunks(chapter).select("corpus", "book", "n", F.explode(words_of_chunk(F.col("chunk"))).alias("raw")).groupBy("corpus", "book", "raw").agg(F.sum("n").alias("n"))
    raw, n = F.col("raw"), F.col("n")
    low, up = raw == fold(raw), raw == F.upper(raw)
    title = F.concat(F.upper(F.substring("raw", 1, 1)), F.expr("substring(raw, 2)")) == raw
    form = F.when(low, "lower").when(title & (F.expr("substring(raw, 2)") == fold(F.expr("substring(raw, 2)"))), "title").when(up, "upper").otherwise("mixed")
    each = w.select("corpus", "book", n, once(word=fold(raw), form=form))
    return each.groupBy("corpus", "book", "word").agg(*[F.sum(F.when(F.col("form") == f, F.col("n")).otherwise(0)).alias(f) for f in ("lower", "title", "upper", "mixed")], F.sum("n").alias("n"))


WORD_FORMS_SQL = f"""
raws AS (SELECT corpus, book, unnest({words_sql('text')}) AS raw FROM ({CHAPTERS_SQL})),
forms AS (SELECT corpus, book, lower(raw) AS word, CASE WHEN raw = lower(raw) THEN 'lower' WHEN upper(left(raw, 1)) || substring(raw, 2) = raw AND substring(raw, 2) = lower(substring(raw, 2)) THEN 'title' WHEN raw = upper(raw) THEN 'upper' ELSE 'mixed' END AS form FROM raws),
word_forms AS (SELECT corpus, book, word, count(*) FILTER (form = 'lower') AS lower, count(*) FILTER (form = 'title') AS title, count(*) FILTER (form = 'upper') AS upper, count(*) FILTER (form = 'mixed') AS mixed, count(*) AS n FROM forms GROUP BY 1, 2, 3)"""


def doubles(chapter: DataFrame) -> DataFrame:
    """(corpus, book, word, doubled): a word said twice with nothing but spaces between, within a line."""
    line = chapter.select("corpus", "book", F.explode(F.split("text", "\n")).alias("line"))
    w = F.col("words")
    parts = line.select("corpus", "book", F.split("line", " +").alias("words"))
    hit = F.filter(F.transform(w, lambda x, i: F.when((fold(x) == fold(F.get(w, i + 1))) & x.rlike(r"^\p{L}+$"), fold(x))), lambda x: x.isNotNull())
    return parts.select("corpus", "book", F.explode(hit).alias("word")).groupBy("corpus", "book", "word").agg(F.count("*").alias("doubled"))


DOUBLES_SQL = f"""
lines AS (SELECT corpus, book, row_number() OVER () AS line_id, line FROM (SELECT corpus, book, unnest(string_split(text, chr(10))) AS line FROM ({CHAPTERS_SQL}))),
parts AS (SELECT corpus, book, line_id, unnest(string_split_regex(line, ' +')) AS w, generate_subscripts(string_split_regex(line, ' +'), 1) AS pos FROM lines),
doubles AS (SELECT corpus, book, lower(w) AS word, count(*) AS doubled FROM (SELECT *, lead(w) OVER (PARTITION BY line_id ORDER BY pos) AS next FROM parts) WHERE lower(w) = lower(next) AND regexp_matches(w, '^\\p{{L}}+$') GROUP BY 1, 2, 3)"""


def separated_doubles(chapter: DataFrame) -> DataFrame:
    """(corpus, book, word, separated): a word said twice with marks, and nothing but marks and spaces, between, within a line."""
    line = chapter.select("corpus", "book", F.explode(F.split("text", "\n")).alias("line"))
    u = F.col("units")
    cut = line.select("corpus", "book", F.regexp_extract_all("line", F.lit(f"{WORD_ONCE}|[^{CORE[1:-1]}]+"), F.lit(0)).alias("units"))
    hit = F.filter(F.transform(u, lambda x, i: F.when((fold(x) == fold(F.get(u, i + 2))) & x.rlike(r"^\p{L}+$") & F.get(u, i + 1).rlike(r"^\s*[^\s\p{L}\p{Nd}]"), fold(x))), lambda x: x.isNotNull())
    return cut.select("corpus", "book", F.explode(hit).alias("word")).groupBy("corpus", "book", "word").agg(F.count("*").alias("separated"))


_APART = (WORD + "|[^" + CORE[1:-1] + "]+").replace("'", "''")
SEPARATED_SQL = f"""WITH l AS (SELECT corpus, book, unnest(string_split(text, chr(10))) AS line FROM ({CHAPTERS_SQL})), u AS (SELECT corpus, book, regexp_extract_all(line, '{_APART}') AS u FROM l),
t AS (SELECT corpus, book, u[i] AS a, u[i + 1] AS m, u[i + 2] AS b FROM (SELECT corpus, book, u, unnest(range(1, len(u) - 1)) AS i FROM u WHERE len(u) > 2))
SELECT corpus, book, lower(a) AS word, count(*) AS separated FROM t WHERE lower(a) = lower(b) AND regexp_matches(a, '^\\p{{L}}+$') AND regexp_matches(m, '^\\s*[^\\s\\p{{L}}\\p{{Nd}}]') GROUP BY 1, 2, 3"""


def letter_runs(chapter: DataFrame) -> DataFrame:
    """(corpus, letter, length, n): maximal runs of one letter, lengths 2 to 8 (8 and more together)."""
    found = chapter.select("corpus", F.explode(F.regexp_extract_all(fold(F.col("text")), F.lit(r"(\p{L})\1+"), F.lit(0))).alias("run"))
    return found.groupBy("corpus", F.substring("run", 1, 1).alias("letter"), F.least(F.char_length("run"), F.lit(8)).alias("length")).agg(F.count("*").alias("n"))


LETTER_RUNS_SQL = f"""
folded AS (SELECT corpus, chapter, unnest(string_split(lower(text), '')) AS c, generate_subscripts(string_split(lower(text), ''), 1) AS pos FROM ({CHAPTERS_SQL}) WHERE text <> ''),
marked AS (SELECT *, pos - row_number() OVER (PARTITION BY chapter, c ORDER BY pos) AS island FROM folded),
letter_runs AS (SELECT corpus, letter, least(len, 8)::int AS length, count(*) AS n FROM (SELECT corpus, c AS letter, count(*) AS len FROM marked WHERE regexp_matches(c, '\\p{{L}}') GROUP BY corpus, chapter, c, island HAVING count(*) > 1) GROUP BY 1, 2, 3)"""


def verse_lengths(verse: DataFrame) -> DataFrame:
    """(corpus, book, verses, graphemes, longest): lengths in display characters (grapheme clusters)."""
    n = F.regexp_count("text", F.lit(r"\X")).cast("int")
    return verse.groupBy("corpus", "book").agg(F.count("*").alias("verses"), F.sum(n).alias("graphemes"), F.max(n).cast("long").alias("longest"))


#: What stands before a word and the word: everything since the word before, on one line.
_UNIT = f"[^{CORE[1:-1]}]*(?:{WORD})"
_UNIT_ONCE = f"[^{CORE[1:-1]}]*+{WORD_ONCE}"


def word_contexts(chapter: DataFrame) -> DataFrame:
    """(corpus, book, word, before, form, n): folded words by what hands over to them and how they are cased.

    before: '' for a word after a word, 'start' for the first of a line, else the mark (of . ! ? , ; :) that white space
    follows; other marks hand over nothing. form: lower, title, upper, mixed; words without case are left out.
    """
    line = chapter.select("corpus", "book", F.explode(F.split("text", "\n")).alias("line"))
    found = line.select("corpus", "book", F.posexplode(F.regexp_extract_all("line", F.lit(_UNIT_ONCE), F.lit(0))).alias("at", "unit"))
    found = found.groupBy("corpus", "book", "unit", (F.col("at") == 0).alias("start")).agg(F.count("*").alias("n"))
    raw = F.regexp_replace("unit", f"^[^{CORE[1:-1]}]*", "")
    mark = F.regexp_extract("unit", r"^[^\p{L}\p{N}]*?([.!?,;:])\s+[^\p{L}\p{N}\s.!?,;:]*[\p{L}\p{N}]", 1)
    parts = found.select("corpus", "book", "n", once(raw=raw, before=F.when(F.col("start"), "start").otherwise(mark)))
    w = parts.filter(F.col("raw").rlike(HAS_LETTER)).groupBy("corpus", "book", "raw", "before").agg(F.sum("n").alias("n"))
    return w.select("corpus", "book", "before", "n", once(word=fold(F.col("raw")), form=_form(F.col("raw")))).filter("form IS NOT NULL").groupBy("corpus", "book", "word", "before", "form").agg(F.sum("n").alias("n"))


def _form(raw):
    low, up, rest = fold(raw), F.upper(raw), F.expr("substring(raw, 2)")
    title = (F.concat(F.upper(F.substring(raw, 1, 1)), rest) == raw) & (rest == fold(rest))
    return F.when(low == up, None).when(raw == low, "lower").when(title, "title").when(raw == up, "upper").otherwise("mixed")


_LEAD = f"^[^{CORE[1:-1]}]*".replace("'", "''")
WORD_CONTEXTS_SQL = rf"""
lines2 AS (SELECT corpus, book, unnest(string_split(text, chr(10))) AS line FROM ({CHAPTERS_SQL})),
units2 AS (SELECT corpus, book, unnest(regexp_extract_all(line, '{_UNIT.replace("'", "''")}')) AS x, unnest(range(0, len(regexp_extract_all(line, '{_UNIT.replace("'", "''")}')))) AS i FROM lines2),
split2 AS (SELECT corpus, book, regexp_replace(x, '{_LEAD}', '') AS raw, CASE WHEN i = 0 THEN 'start' ELSE regexp_extract(x, '^[^\p{{L}}\p{{N}}]*?([.!?,;:])\s+[^\p{{L}}\p{{N}}\s.!?,;:]*[\p{{L}}\p{{N}}]', 1) END AS before FROM units2),
word_contexts AS (SELECT corpus, book, lower(raw) AS word, before, CASE WHEN raw = lower(raw) THEN 'lower' WHEN upper(left(raw, 1)) || substring(raw, 2) = raw AND substring(raw, 2) = lower(substring(raw, 2)) THEN 'title' WHEN raw = upper(raw) THEN 'upper' ELSE 'mixed' END AS form, count(*) AS n
 FROM split2 WHERE regexp_matches(raw, '{HAS_LETTER}') AND lower(raw) <> upper(raw) GROUP BY ALL)"""
