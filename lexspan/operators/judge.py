"""Judged channels: what a corpus rarely does, as rows that carry numerator, denominator, share and ceiling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ladders import GLYPH, WORD, ceiling_sql, firing
from ..functions.text import char_class
from . import census as C

_FIRE = "share_bp < ceiling_bp AND ceiling_bp IS NOT NULL"


def _judged_sql(inner: str, columns: str, ladder) -> str:
    return f"SELECT {columns}, numerator, denominator, ceiling_bp::int AS ceiling_bp, share_bp FROM (SELECT *, {ceiling_sql('denominator', ladder)} AS ceiling_bp, least(10000, numerator * 10000 // denominator)::bigint AS share_bp FROM ({inner})) WHERE {_FIRE}"


def placement(chapter: DataFrame) -> DataFrame:
    """Marks that stand beside a class of character they rarely stand beside (an edge counts, but never departs)."""
    t = C.marks(chapter)
    sides = F.array(*[F.struct(F.lit(s).alias("side"), char_class(F.col(s)).alias("class")) for s in ("before", "after")])
    each = t.select("corpus", "book", "glyph", "n", F.inline(sides))
    counted = each.groupBy("corpus", "glyph", "side", "class").agg(F.sum("n").alias("numerator"), F.countDistinct("book").alias("books"))
    total = F.sum("numerator").over(Window.partitionBy("corpus", "glyph", "side"))  # at most five rows each
    return firing(counted.withColumn("denominator", total).filter("class <> 'Edge'"), GLYPH).select("corpus", "glyph", "side", "class", "books", "numerator", "denominator", "ceiling_bp", "share_bp")


def placement_sql() -> str:
    from ..functions.text import char_class_sql as k

    inner = f"""SELECT *, sum(numerator) OVER (PARTITION BY corpus, glyph, side)::bigint AS denominator FROM (
SELECT corpus, glyph, side, class, count(*) AS numerator, count(DISTINCT book) AS books FROM (
SELECT corpus, book, glyph, 'before' AS side, {k('before')} AS class FROM triples WHERE {k('glyph')} = 'Nonletter'
UNION ALL SELECT corpus, book, glyph, 'after', {k('after')} FROM triples WHERE {k('glyph')} = 'Nonletter') GROUP BY 1, 2, 3, 4)"""
    return f"WITH {C.TRIPLES_SQL} " + _judged_sql(f"SELECT * FROM ({inner}) WHERE class <> 'Edge'", "corpus, glyph, side, class, books", GLYPH)


def rarity(chapter: DataFrame, floor: int = 5, most_letters: int = 500, least_letters: int = 5_000) -> DataFrame:
    """Characters of fewer than `floor` occurrences; letters only where the alphabet is small and well attested."""
    s = C.scalars(chapter).withColumn("letter", F.col("glyph").rlike(r"^[\p{L}\p{M}\p{Nl}]$"))
    w = Window.partitionBy("corpus")  # as many rows as the corpus has kinds of characters
    s = s.withColumns({"denominator": F.sum("n").over(w), "kinds": F.count_if("letter").over(w), "letters": F.sum(F.when(F.col("letter"), F.col("n")).otherwise(0)).over(w)})
    out = s.filter((F.col("n") < floor) & C.after(F.col("glyph") != "0-9") & (~F.col("letter") | ((F.col("kinds") <= most_letters) & (F.col("letters") >= least_letters))))
    return out.select("corpus", "glyph", F.col("n").alias("numerator"), "denominator", "books")


def rarity_sql(floor: int = 5, most_letters: int = 500, least_letters: int = 5_000) -> str:
    return f"""WITH s AS (SELECT *, regexp_matches(glyph, '^[\\p{{L}}\\p{{M}}\\p{{Nl}}]$') AS letter FROM ({C.SCALARS_SQL})),
b AS (SELECT corpus, sum(n)::bigint AS denominator, count(*) FILTER (letter) AS kinds, coalesce(sum(n) FILTER (letter), 0) AS letters FROM s GROUP BY 1)
SELECT corpus, glyph, n AS numerator, denominator, books FROM s JOIN b USING (corpus) WHERE n < {floor} AND glyph <> '0-9' AND (NOT letter OR (kinds <= {most_letters} AND letters >= {least_letters}))"""


def exact_neighbor(chapter: DataFrame) -> DataFrame:
    """Pairs of neighbouring marks in a run, against all that the first is followed by in runs."""
    counted = in_run_pairs(chapter).groupBy("corpus", "glyph", "next").agg(F.sum("n").alias("numerator"), F.countDistinct("book").alias("books"))
    total = F.sum("numerator").over(Window.partitionBy("corpus", "glyph"))
    return firing(counted.withColumn("denominator", total), GLYPH).select("corpus", "glyph", "next", "books", "numerator", "denominator", "ceiling_bp", "share_bp")


def exact_neighbor_sql() -> str:
    inner = "SELECT *, sum(numerator) OVER (PARTITION BY corpus, glyph)::bigint AS denominator FROM (SELECT corpus, glyph, next, count(*) AS numerator, count(DISTINCT book) AS books FROM (SELECT corpus, book, run[i] AS glyph, run[i + 1] AS next FROM (SELECT corpus, book, run, unnest(range(1, length(run))) AS i FROM runs WHERE length(run) > 1)) GROUP BY 1, 2, 3)"
    return f"WITH {C.RUNS_SQL} " + _judged_sql(inner, "corpus, glyph, next, books", GLYPH)


def leaders(chapter: DataFrame) -> DataFrame:
    """(corpus, glyph, pairs): marks with enough pairs inside runs for exact_neighbor() to judge what follows them."""
    by = in_run_pairs(chapter).groupBy("corpus", "glyph").agg(F.sum("n").alias("pairs"))
    return by.filter(F.col("pairs") >= GLYPH[0])


def recurring_runs(chapter: DataFrame, recurs: int = 5) -> DataFrame:
    """(corpus, run, n, pooled): runs that are a convention by recurrence: the run itself, or with all sentence-ending marks
    read as one, occurs at least `recurs` times."""
    r = C.runs(chapter).filter("char_length(run) > 1").groupBy("corpus", "run").agg(F.sum("n").alias("n"))
    r = r.withColumn("shape", F.regexp_replace("run", dict(POOLS)["Terminal"], "T"))
    r = r.withColumn("pooled", F.sum("n").over(Window.partitionBy("corpus", "shape")))  # few distinct runs a shape
    return r.filter((F.col("n") >= recurs) | (F.col("pooled") >= recurs)).select("corpus", "run", "n", "pooled")


def unexplained_placement(chapter: DataFrame) -> DataFrame:
    """placement() without what exact_neighbor() already judges: a pair inside a run whose first mark is a leader counts in the
    denominator alone. leaders() is a few marks a corpus and is broadcast."""
    t = C.marks(chapter)
    known = F.broadcast(leaders(chapter).select("corpus", F.col("glyph").alias("leader"), F.lit(True).alias("leads")))
    sides = F.array(F.struct(F.lit("before").alias("side"), char_class(F.col("before")).alias("class"), F.col("before").alias("leader")), F.struct(F.lit("after").alias("side"), char_class(F.col("after")).alias("class"), F.col("glyph").alias("leader")))
    each = t.select("corpus", "book", "glyph", "n", F.inline(sides)).join(known, ["corpus", "leader"], "left")
    own = ~(F.coalesce("leads", F.lit(False)) & (F.col("class") == "Nonletter"))
    by = each.groupBy("corpus", "glyph", "side", "class").agg(F.sum("n").alias("all_n"), F.sum(F.when(own, F.col("n")).otherwise(0)).alias("numerator"), F.countDistinct(F.when(own, F.col("book"))).alias("books"))
    total = F.sum("all_n").over(Window.partitionBy("corpus", "glyph", "side"))
    return firing(by.withColumn("denominator", total).filter("class <> 'Edge' AND numerator > 0"), GLYPH).select("corpus", "glyph", "side", "class", "books", "numerator", "denominator", "ceiling_bp", "share_bp")


def unexplained_placement_sql() -> str:
    from ..functions.text import char_class_sql as k

    led = "SELECT corpus, glyph AS leader FROM (SELECT corpus, before AS glyph, count(*) AS n FROM marks WHERE bc = 'Nonletter' GROUP BY 1, 2) WHERE n >= 5"
    inner = f"""SELECT corpus, glyph, side, class, books, numerator, denominator FROM (SELECT *, sum(all_n) OVER (PARTITION BY corpus, glyph, side)::bigint AS denominator FROM (
SELECT corpus, glyph, side, class, count(*) AS all_n, count(*) FILTER (own) AS numerator, count(DISTINCT book) FILTER (own) AS books FROM (
SELECT s.*, NOT (class = 'Nonletter' AND l.leader IS NOT NULL) AS own FROM (SELECT corpus, book, glyph, 'before' AS side, bc AS class, before AS leader FROM marks UNION ALL SELECT corpus, book, glyph, 'after', ac, glyph FROM marks) s LEFT JOIN led l ON l.corpus = s.corpus AND l.leader = s.leader) GROUP BY 1, 2, 3, 4)) WHERE class <> 'Edge' AND numerator > 0"""
    return f"WITH {C.TRIPLES_SQL}, marks AS (SELECT *, {k('before')} AS bc, {k('after')} AS ac FROM triples WHERE {k('glyph')} = 'Nonletter'), led AS ({led}) " + _judged_sql(inner, "corpus, glyph, side, class, books", GLYPH)


#: pool -> what belongs to it, the first that matches counting: Unicode classes, and properties' members (fixed values).
POOLS = (
    ("Quote", "[\\p{Pi}\\p{Pf}\"'‚„「」『』〝〞〟]"),
    ("Bracket", "[\\p{Ps}\\p{Pe}]"),
    ("Dash", "[\\p{Pd}−~]"),
    ("Terminal", "[.!?։؟۔।॥።。！？…‼⁇⁈⁉]"),
    ("Separator", "[,:;،؛፣፤፥、，：；·]"),
    ("Symbol", "\\p{S}"),
)


def pool(c):
    """The kind of a mark."""
    out = None
    for name, pattern in POOLS:
        out = (F if out is None else out).when(c.rlike(f"^{pattern}$"), name)
    return out.otherwise("Other")


def pool_sql(c: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_full_match({c}, '{p.replace(chr(39), chr(39) * 2)}') THEN '{n}'" for n, p in POOLS) + " ELSE 'Other' END"


def in_run_pairs(chapter: DataFrame) -> DataFrame:
    """(corpus, book, glyph, next, n): marks and what follows them inside runs."""
    c = F.col("chars")
    r = C.runs(chapter).filter("char_length(run) > 1").withColumn("chars", F.array_remove(F.split("run", ""), ""))
    each = F.arrays_zip(F.slice(c, F.lit(1), F.size(c) - 1).alias("glyph"), F.slice(c, F.lit(2), F.size(c) - 1).alias("next"))
    return r.select("corpus", "book", "n", F.inline(each)).toDF("corpus", "book", "n", "glyph", "next")


def pooled_neighbor(chapter: DataFrame) -> DataFrame:
    """Kinds of marks that rarely follow a mark inside runs (off in a default judgement)."""
    p = in_run_pairs(chapter).withColumn("pool", pool(F.col("next")))
    counted = p.groupBy("corpus", "glyph", "pool").agg(F.sum("n").alias("numerator"), F.countDistinct("book").alias("books"))
    total = F.sum("numerator").over(Window.partitionBy("corpus", "glyph"))  # at most eight rows
    return firing(counted.withColumn("denominator", total), GLYPH).select("corpus", "glyph", "pool", "books", "numerator", "denominator", "ceiling_bp", "share_bp")


def pooled_neighbor_sql() -> str:
    inner = f"SELECT *, sum(numerator) OVER (PARTITION BY corpus, glyph)::bigint AS denominator FROM (SELECT corpus, glyph, {pool_sql('next')} AS pool, count(*) AS numerator, count(DISTINCT book) AS books FROM (SELECT corpus, book, run[i] AS glyph, run[i + 1] AS next FROM (SELECT corpus, book, run, unnest(range(1, length(run))) AS i FROM runs WHERE length(run) > 1)) GROUP BY 1, 2, 3)"
    return f"WITH {C.RUNS_SQL} " + _judged_sql(inner, "corpus, glyph, pool, books", GLYPH)


def inside_words(chapter: DataFrame) -> DataFrame:
    """Marks rarely between two letters, where neither side's letters depart by themselves: the joint placement claim."""
    t = C.marks(chapter)
    letter = lambda c: char_class(F.col(c)) == "Letter"
    by = t.groupBy("corpus", "glyph").agg(
        F.sum("n").alias("denominator"),
        F.sum(F.when(letter("before") & letter("after"), F.col("n")).otherwise(0)).alias("numerator"),
        F.sum(F.when(letter("before"), F.col("n")).otherwise(0)).alias("before_n"),
        F.sum(F.when(letter("after"), F.col("n")).otherwise(0)).alias("after_n"),
        F.countDistinct(F.when(letter("before") & letter("after"), F.col("book"))).alias("books"),
    )
    often = F.least(F.expr("(before_n * 10000) div denominator"), F.expr("(after_n * 10000) div denominator"))
    return firing(by.filter("numerator > 0"), GLYPH).filter(often >= F.col("ceiling_bp")).select("corpus", "glyph", "books", "numerator", "denominator", "ceiling_bp", "share_bp")


def inside_words_sql() -> str:
    from ..functions.text import char_class_sql as k

    inner = f"SELECT corpus, glyph, count(*) AS denominator, count(*) FILTER (b AND a) AS numerator, count(*) FILTER (b) AS bn, count(*) FILTER (a) AS an, count(DISTINCT book) FILTER (b AND a) AS books FROM (SELECT *, {k('before')} = 'Letter' AS b, {k('after')} = 'Letter' AS a FROM triples WHERE {k('glyph')} = 'Nonletter') GROUP BY 1, 2 HAVING count(*) FILTER (b AND a) > 0"
    judged = _judged_sql(inner, "corpus, glyph, books, bn, an", GLYPH)
    return f"WITH {C.TRIPLES_SQL} SELECT corpus, glyph, books, numerator, denominator, ceiling_bp, share_bp FROM ({judged}) WHERE least(bn * 10000 // denominator, an * 10000 // denominator) >= ceiling_bp"


def run_shape(chapter: DataFrame, recurs: int = 5) -> DataFrame:
    """Shapes of runs (pure or mixed, by length) rare among a mark's runs; only runs that do not recur are counted."""
    total = C.runs(chapter).groupBy("corpus", "run").agg(F.sum("n").alias("n"))
    each = total.withColumn("glyph", F.explode(F.array_distinct(F.array_remove(F.split("run", ""), ""))))
    pure = F.replace("run", F.col("glyph"), F.lit("")) == ""
    shaped = each.groupBy("corpus", "glyph", pure.alias("pure"), F.least(F.char_length("run"), F.lit(6)).alias("bucket")).agg(F.sum("n").alias("all_runs"), F.sum(F.when(F.col("n") < recurs, F.col("n")).otherwise(0)).alias("novel"))
    shaped = shaped.withColumn("denominator", F.sum("all_runs").over(Window.partitionBy("corpus", "glyph"))).withColumn("numerator", F.col("all_runs"))
    return firing(shaped, GLYPH).filter("novel > 0").select("corpus", "glyph", "pure", "bucket", F.col("novel").alias("numerator"), "denominator", "ceiling_bp", "share_bp")


def run_shape_sql(recurs: int = 5) -> str:
    inner = f"""SELECT corpus, glyph, pure, bucket, novel, all_runs AS numerator, sum(all_runs) OVER (PARTITION BY corpus, glyph)::bigint AS denominator FROM (
SELECT corpus, glyph, replace(run, glyph, '') = '' AS pure, least(length(run), 6)::int AS bucket, sum(n)::bigint AS all_runs, sum(CASE WHEN n < {recurs} THEN n ELSE 0 END)::bigint AS novel
FROM (SELECT corpus, run, n, unnest(list_distinct(string_split(run, ''))) AS glyph FROM (SELECT corpus, run, count(*) AS n FROM runs GROUP BY 1, 2)) GROUP BY 1, 2, 3, 4)"""
    judged = _judged_sql(inner, "corpus, glyph, pure, bucket, novel", GLYPH)
    return f"WITH {C.RUNS_SQL}, judged AS ({judged}) SELECT corpus, glyph, pure, bucket, novel AS numerator, denominator, ceiling_bp, share_bp FROM judged WHERE novel > 0"


def terminals(chapter: DataFrame) -> DataFrame:
    """What follows each mark: forcing (80 % upper case or more), mixed (over 20 %) or free."""
    t = C.follows(chapter).groupBy("corpus", "terminal").agg(F.sum("upper").alias("upper"), F.sum("lower").alias("lower")).withColumn("cased", F.col("upper") + F.col("lower")).filter("cased > 0")
    bp = F.expr("(upper * 10000) div cased")
    return t.select("corpus", "terminal", "upper", "cased", bp.alias("upper_bp"), F.when(bp >= 8000, "forcing").when(bp > 2000, "mixed").otherwise("free").alias("kind"))


TERMINALS_SQL = f"""WITH {C.FOLLOWS_SQL}
SELECT corpus, terminal, upper, cased, upper_bp, CASE WHEN upper_bp >= 8000 THEN 'forcing' WHEN upper_bp > 2000 THEN 'mixed' ELSE 'free' END AS kind FROM (
SELECT corpus, terminal, sum(upper)::bigint AS upper, sum(upper + lower)::bigint AS cased, (sum(upper) * 10000 // sum(upper + lower))::bigint AS upper_bp FROM follows GROUP BY 1, 2 HAVING sum(upper + lower) > 0)"""


def sentence_start(chapter: DataFrame) -> DataFrame:
    """Marks after which a lower-case letter is an exception: 98 % upper case or more of at least five."""
    return terminals(chapter).filter("cased >= 5 AND upper < cased AND upper_bp >= 9800").select("corpus", "terminal", (F.col("cased") - F.col("upper")).alias("numerator"), F.col("cased").alias("denominator"))


SENTENCE_START_SQL = f"SELECT corpus, terminal, cased - upper AS numerator, cased AS denominator FROM ({TERMINALS_SQL}) WHERE cased >= 5 AND upper < cased AND upper_bp >= 9800"


def book_rate(chapter: DataFrame) -> DataFrame:
    """Books in which a mark stands beside a class far more often than in the other books.

    The median of the others' rates needs no self-join: with the book's rank r among n sorted rates, the others' middle
    values are the sorted ones at m, or at m + 1 where m is at or past r.
    """
    t = C.marks(chapter)
    sides = F.array(*[F.struct(F.lit(s).alias("side"), char_class(F.col(s)).alias("class")) for s in ("before", "after")])
    each = t.select("corpus", "book", "glyph", "n", F.inline(sides)).groupBy("corpus", "book", "glyph", "side", "class").agg(F.sum("n").alias("numerator"))
    held = t.groupBy("corpus", "book", "glyph").agg(F.sum("n").alias("denominator")).filter("denominator >= 5")
    keys = each.select("corpus", "glyph", "side", "class").distinct()
    rates = keys.join(held, ["corpus", "glyph"]).join(each, ["corpus", "book", "glyph", "side", "class"], "left").withColumn("numerator", F.coalesce("numerator", F.lit(0)))
    rates = rates.withColumn("rate", F.expr("(numerator * 10000) div denominator"))
    w = Window.partitionBy("corpus", "glyph", "side", "class")  # one row a book
    rates = rates.withColumn("sorted", F.array_sort(F.collect_list("rate").over(w))).withColumn("n", F.size("sorted")).filter("n >= 4")
    others = F.expr("array_sort(concat(slice(sorted, 1, array_position(sorted, rate) - 1), slice(sorted, array_position(sorted, rate) + 1, n)))")
    rates = rates.withColumn("others", others)
    median = F.expr("CASE WHEN (n - 1) % 2 = 1 THEN others[(n - 2) div 2] ELSE (others[(n - 1) div 2 - 1] + others[(n - 1) div 2]) div 2 END")
    out = rates.withColumn("median", median).filter("class <> 'Edge' AND denominator >= 100 AND numerator >= 5 AND rate >= 4000 AND rate >= 10 * greatest(1, median)")
    return out.select("corpus", "book", "glyph", "side", "class", "numerator", "denominator", "rate", "median")


def book_rate_sql() -> str:
    from ..functions.text import char_class_sql as k

    return f"""WITH {C.TRIPLES_SQL},
t AS (SELECT * FROM triples WHERE {k('glyph')} = 'Nonletter'),
e AS (SELECT corpus, book, glyph, side, class, count(*) AS numerator FROM (SELECT corpus, book, glyph, 'before' AS side, {k('before')} AS class FROM t UNION ALL SELECT corpus, book, glyph, 'after', {k('after')} FROM t) GROUP BY 1, 2, 3, 4, 5),
h AS (SELECT corpus, book, glyph, count(*) AS denominator FROM t GROUP BY 1, 2, 3 HAVING count(*) >= 5),
r AS (SELECT *, (numerator * 10000 // denominator)::bigint AS rate FROM (SELECT k.*, h.book, h.denominator, coalesce(e.numerator, 0) AS numerator FROM (SELECT DISTINCT corpus, glyph, side, class FROM e) k JOIN h USING (corpus, glyph) LEFT JOIN e USING (corpus, book, glyph, side, class))),
m AS (SELECT a.*, floor(quantile_cont(b.rate, 0.5))::bigint AS median, count(*) AS others FROM r a JOIN r b ON a.corpus = b.corpus AND a.glyph = b.glyph AND a.side = b.side AND a.class = b.class AND a.book <> b.book GROUP BY ALL)
SELECT corpus, book, glyph, side, class, numerator, denominator, rate, median FROM m WHERE others >= 3 AND class <> 'Edge' AND denominator >= 100 AND numerator >= 5 AND rate >= 4000 AND rate >= 10 * greatest(1, median)"""


FORMS = ("lower", "title", "upper", "mixed")


def casing(chapter: DataFrame, ladder=WORD) -> DataFrame:
    """Forms in which a word is rarely cased where it chose its case itself.

    Free are places after another word, and after marks that the terminal table calls neither forcing nor mixed; starts
    of lines never are. The table is a handful of rows a corpus and is broadcast.
    """
    bound = terminals(chapter).filter("kind <> 'free'").select("corpus", F.col("terminal").alias("before"), F.lit(True).alias("bound"))
    w = C.word_contexts(chapter).filter("before <> 'start'").join(F.broadcast(bound), ["corpus", "before"], "left").filter("bound IS NULL")
    by = w.groupBy("corpus", "word", "form").agg(F.sum("n").alias("numerator"), F.countDistinct("book").alias("books"))
    total = F.sum("numerator").over(Window.partitionBy("corpus", "word"))  # at most four rows each
    return firing(by.withColumn("denominator", total), ladder).select("corpus", "word", "form", "books", "numerator", "denominator", "ceiling_bp", "share_bp")


def casing_sql(ladder=WORD) -> str:
    inner = "SELECT *, sum(numerator) OVER (PARTITION BY corpus, word)::bigint AS denominator FROM (SELECT c.corpus, c.word, c.form, sum(c.n)::bigint AS numerator, count(DISTINCT c.book) AS books FROM word_contexts c LEFT JOIN terms t ON t.corpus = c.corpus AND t.terminal = c.before AND t.kind <> 'free' WHERE c.before <> 'start' AND t.kind IS NULL GROUP BY 1, 2, 3)"
    return f"WITH {C.WORD_CONTEXTS_SQL}, terms AS ({TERMINALS_SQL}) " + _judged_sql(inner, "corpus, word, form, books", ladder)


def doubled(chapter: DataFrame, usual: int = 5, vocabulary_bp: int = 300) -> DataFrame:
    """Words doubled fewer than `usual` times; silent where doubling is common in the corpus' vocabulary."""
    words = C.word_forms(chapter).groupBy("corpus", "word").agg(F.sum("n").alias("n"))
    d = C.doubles(chapter).groupBy("corpus", "word").agg(F.sum("doubled").alias("doubled"), F.countDistinct("book").alias("books"))
    both = words.join(d, ["corpus", "word"], "left")
    by = both.groupBy("corpus").agg(F.expr("(count_if(doubled >= 2) * 10000) div count(*)").alias("doubling_bp"))
    return both.filter("doubled IS NOT NULL").join(by, "corpus").filter((F.col("doubling_bp") <= vocabulary_bp) & (F.col("doubled") < usual)).select("corpus", "word", F.col("doubled").alias("numerator"), F.col("n").alias("denominator"), "books")


def doubled_sql(usual: int = 5, vocabulary_bp: int = 300) -> str:
    return f"""WITH {C.WORD_FORMS_SQL}, {C.DOUBLES_SQL},
b AS (SELECT w.corpus, w.word, w.n, d.doubled, d.books FROM (SELECT corpus, word, sum(n)::bigint AS n FROM word_forms GROUP BY 1, 2) w LEFT JOIN (SELECT corpus, word, sum(doubled)::bigint AS doubled, count(DISTINCT book) AS books FROM doubles GROUP BY 1, 2) d USING (corpus, word)),
v AS (SELECT corpus, count(*) FILTER (doubled >= 2) * 10000 // count(*) AS bp FROM b GROUP BY 1)
SELECT corpus, word, doubled AS numerator, n AS denominator, books FROM b JOIN v USING (corpus) WHERE doubled IS NOT NULL AND bp <= {vocabulary_bp} AND doubled < {usual}"""


def letter_run(chapter: DataFrame, usual: int = 20) -> DataFrame:
    """Runs of a letter longer than any length the corpus uses at least `usual` times (a pair never departs)."""
    r = C.letter_runs(chapter)
    w = Window.partitionBy("corpus", "letter")  # at most seven rows
    longest = F.coalesce(F.max(F.when(F.col("n") >= usual, F.col("length"))).over(w), F.lit(2))
    out = r.withColumn("longest", longest).withColumn("denominator", F.sum("n").over(w))
    return out.filter("length > longest AND length > 2").select("corpus", "letter", "length", F.col("n").alias("numerator"), "denominator")


LETTER_RUN_SQL = f"""WITH {C.LETTER_RUNS_SQL}
SELECT corpus, letter, length, n AS numerator, denominator FROM (SELECT *, coalesce(max(CASE WHEN n >= 20 THEN length END) OVER w, 2) AS longest, sum(n) OVER w::bigint AS denominator FROM letter_runs WINDOW w AS (PARTITION BY corpus, letter)) WHERE length > longest AND length > 2"""


def word_length(chapter: DataFrame, sigmas: float = 4.0, least: int = 20) -> DataFrame:
    """Frequent words that are longer than the mean by `sigmas` standard deviations (by occurrence)."""
    w = C.word_forms(chapter).groupBy("corpus", "word").agg(F.sum("n").alias("n")).withColumn("length", F.char_length("word").cast("long"))
    # integer moments add up exactly in any order
    by = w.groupBy("corpus").agg(F.sum("n").alias("all_n"), F.sum(F.expr("n * length")).alias("s1"), F.sum(F.expr("n * length * length")).alias("s2"))
    by = by.withColumn("mean", F.expr("s1 / all_n")).withColumn("sd", F.sqrt(F.expr("s2 / all_n") - F.col("mean") * F.col("mean")))
    return w.join(by, "corpus").filter((F.col("n") >= least) & (F.col("length") >= F.col("mean") + sigmas * F.col("sd"))).select("corpus", "word", "length", F.col("n").alias("numerator"), F.col("all_n").alias("denominator"))


WORD_LENGTH_SQL = f"""WITH {C.WORD_FORMS_SQL}, w AS (SELECT corpus, word, sum(n)::bigint AS n, length(word)::bigint AS len FROM word_forms GROUP BY 1, 2),
b AS (SELECT corpus, sum(n)::bigint AS all_n, sum(n * len)::bigint AS s1, sum(n * len * len)::bigint AS s2 FROM w GROUP BY 1)
SELECT corpus, word, len AS length, n AS numerator, all_n AS denominator FROM w JOIN b USING (corpus) WHERE n >= 20 AND len >= s1 / all_n + 4.0 * sqrt(s2 / all_n - (s1 / all_n) * (s1 / all_n))"""


def clusters(chapter: DataFrame, slots: int = 8, reserved: int = 3, recurs: int = 5) -> DataFrame:
    """Example runs of each mark: up to `slots`, novel ones first, `reserved` slots kept for recurring ones."""
    total = C.runs(chapter).groupBy("corpus", "run").agg(F.sum("n").alias("n")).filter("char_length(run) > 1")
    each = total.withColumn("glyph", F.explode(F.array_distinct(F.array_remove(F.split("run", ""), "")))).withColumn("novel", F.col("n") < recurs)
    w = Window.partitionBy("corpus", "glyph", "novel")
    each = each.withColumn("at", F.row_number().over(w.orderBy(F.desc("n"), "run"))).filter(F.col("at") <= slots)
    have = each.groupBy("corpus", "glyph").agg(F.count_if(~F.col("novel")).alias("recurring"), F.count_if("novel").alias("fresh"))
    kept = F.when(F.col("novel"), F.col("at") <= slots - F.least(F.lit(reserved), F.col("recurring"))).otherwise(F.col("at") <= slots - F.least(F.col("fresh"), F.lit(slots) - F.least(F.lit(reserved), F.col("recurring"))))
    return each.join(have, ["corpus", "glyph"]).filter(kept).select("corpus", "glyph", "run", "n", "novel")


CLUSTERS_SQL = f"""WITH {C.RUNS_SQL}, e AS (SELECT corpus, run, n, n < 5 AS novel, unnest(list_distinct(string_split(run, ''))) AS glyph FROM (SELECT corpus, run, count(*) AS n FROM runs WHERE length(run) > 1 GROUP BY 1, 2)),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY corpus, glyph, novel ORDER BY n DESC, run) AS at_ FROM e) WHERE at_ <= 8),
h AS (SELECT corpus, glyph, count(*) FILTER (NOT novel) AS recurring, count(*) FILTER (novel) AS fresh FROM r GROUP BY 1, 2)
SELECT corpus, glyph, run, n, novel FROM r JOIN h USING (corpus, glyph) WHERE CASE WHEN novel THEN at_ <= 8 - least(3, recurring) ELSE at_ <= 8 - least(fresh, 8 - least(3, recurring)) END"""
