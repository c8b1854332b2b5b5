"""A text against a declared source: pairing by key, lengths, presence, copied runs; and likely typing errors.

A unit is (book, chapter, first, last, text): a verse, or a bridge of verses first..last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold, words

KEY = ["book", "chapter", "first", "last"]


def _numbered(units: DataFrame) -> DataFrame:
    """Occurrence ordinals of equal keys, and how many there are."""
    w = Window.partitionBy(*KEY)
    return units.withColumn("ordinal", F.row_number().over(w.orderBy("at"))).withColumn("times", F.count("*").over(w))


def paired(target: DataFrame, source: DataFrame) -> DataFrame:
    """Units of equal keys, occurrence by occurrence; keys whose counts differ are blocked on both sides.

    (book, chapter, first, last, ordinal, kind, target_text, source_text), kind being exact, bridge, overlap, ambiguous,
    target_only or source_only. A bridge meets the run of single verses it covers, if that run is whole and unclaimed.
    """
    t = _numbered(target).select(*KEY, "ordinal", F.col("times").alias("t_times"), F.col("text").alias("target_text"))
    s = _numbered(source).select(*KEY, "ordinal", F.col("times").alias("s_times"), F.col("text").alias("source_text"))
    both = t.join(s, [*KEY, "ordinal"], "full")
    tk = t.groupBy(*KEY).agg(F.max("t_times").alias("tn"))
    sk = s.groupBy(*KEY).agg(F.max("s_times").alias("sn"))
    both = both.join(tk, KEY, "left").join(sk, KEY, "left").persist()  # read by every kind below
    exact = both.filter("tn = sn").withColumn("kind", F.lit("exact"))
    blocked = both.filter("tn <> sn").withColumn("kind", F.lit("ambiguous"))
    left, right = both.filter("sn IS NULL"), both.filter("tn IS NULL")
    spans = _covered(left, right, "source_text").withColumnRenamed("joined", "source_text")
    back = _covered(right, left, "target_text").withColumnRenamed("joined", "target_text")
    columns = [*KEY, "ordinal", "kind", "target_text", "source_text"]
    bridged = left.drop("source_text").join(spans, KEY).withColumn("kind", F.lit("bridge")).select(columns)
    bridged = bridged.unionByName(right.drop("target_text").join(back, KEY).withColumn("kind", F.lit("bridge")).select(columns))
    used_t = bridged.filter("target_text IS NOT NULL").select("book", "chapter", F.col("first").alias("f"), F.col("last").alias("l"))

    def rest(side: DataFrame, other: DataFrame, kind: str) -> DataFrame:
        free = side.join(used_t, (side["book"] == used_t["book"]) & (side["chapter"] == used_t["chapter"]) & (side["first"] >= used_t["f"]) & (side["last"] <= used_t["l"]), "left_anti")
        o = other.select("book", "chapter", F.col("first").alias("f"), F.col("last").alias("l")).distinct()
        near = free.join(o, (free["book"] == o["book"]) & (free["chapter"] == o["chapter"]) & (free["first"] <= o["l"]) & (o["f"] <= free["last"]), "left_semi").select(*KEY, "ordinal").withColumn("near", F.lit(True))
        return free.join(near, [*KEY, "ordinal"], "left").withColumn("kind", F.when(F.col("near"), "overlap").otherwise(kind)).select(columns)

    return exact.select(columns).unionByName(blocked.select(columns)).unionByName(bridged).unionByName(rest(left, right, "target_only")).unionByName(rest(right, left, "source_only"))


def _covered(bridges: DataFrame, singles: DataFrame, text: str) -> DataFrame:
    """Bridges (by key) whose verses all stand alone, once, on the other side; joined: those verses' text."""
    b = bridges.filter("first < last").select(*KEY).distinct().withColumn("verse", F.explode(F.sequence("first", "last")))
    one = singles.filter("first = last").select("book", "chapter", F.col("first").alias("verse"), F.col(text).alias("part"))
    got = b.join(one, ["book", "chapter", "verse"]).groupBy(*KEY).agg(F.count("*").alias("n"), F.countDistinct("verse").alias("k"), F.sort_array(F.collect_list(F.struct("verse", "part"))).alias("parts"))
    return got.filter("n = last - first + 1 AND k = n").select(*KEY, F.array_join(F.col("parts.part"), " ").alias("joined"))


def length_outliers(pairs: DataFrame, limit: float = 3.5, least: int = 50) -> DataFrame:
    """Pairs whose length ratio lies far outside its side's spread, in their book or in the whole project.

    pairs(book, chapter, first, target_n, source_n). z = 0.6745 (ratio - median) / MAD of the ratio's side; a side of
    under three deviations, or of no spread, borrows the pooled MAD; no spread at all, or under `least` pairs: no z.
    """
    r = pairs.filter("source_n > 0 AND target_n > 0").withColumn("ratio", F.col("target_n") / F.col("source_n"))
    out = r
    for name, keys in (("book", ["book"]), ("project", [])):
        med = r.groupBy(*keys).agg(F.median("ratio").alias("med"), F.count("*").alias("n"))
        dev = (r.join(med, keys) if keys else r.crossJoin(F.broadcast(med))).withColumn("d", F.col("ratio") - F.col("med"))  # one row beside all
        mad = dev.groupBy(*keys).agg(
            F.first("med").alias(f"{name}_med"), F.first("n").alias(f"{name}_n"),
            F.median(F.when(F.col("d") > 0, F.col("d"))).alias("up"), F.count_if(F.col("d") > 0).alias("up_n"),
            F.median(F.when(F.col("d") < 0, -F.col("d"))).alias("down"), F.count_if(F.col("d") < 0).alias("down_n"),
            F.median(F.abs("d")).alias("pool"),
        )
        mad = mad.select(*keys, f"{name}_med", f"{name}_n", F.when((F.col("up_n") >= 3) & (F.col("up") > 0), F.col("up")).otherwise(F.col("pool")).alias(f"{name}_up"), F.when((F.col("down_n") >= 3) & (F.col("down") > 0), F.col("down")).otherwise(F.col("pool")).alias(f"{name}_down"))
        out = out.join(mad, keys) if keys else out.crossJoin(F.broadcast(mad))
        side = F.when(F.col("ratio") >= F.col(f"{name}_med"), F.col(f"{name}_up")).otherwise(F.col(f"{name}_down"))
        out = out.withColumn(f"{name}_z", F.when((F.col(f"{name}_n") >= least) & (side > 0), F.round(0.6745 * (F.col("ratio") - F.col(f"{name}_med")) / side, 6)))
    return out.filter((F.abs("book_z") > limit) | (F.abs("project_z") > limit)).select("book", "chapter", "first", "target_n", "source_n", "book_z", "project_z")


def presence(target: DataFrame, source: DataFrame) -> DataFrame:
    """(book, chapter, kind, first, last, keys): runs of verses missing from, extra in or empty in the target."""
    t = target.select("book", "chapter", "verse", F.char_length("text").alias("tn"))
    s = source.select("book", "chapter", "verse", F.char_length("text").alias("sn"))
    both = t.join(s, ["book", "chapter", "verse"], "full").withColumn("kind", F.when(F.col("tn").isNull(), "Missing").when(F.col("sn").isNull(), "Extra").when((F.col("tn") == 0) & (F.col("sn") > 0), "Empty")).filter("kind IS NOT NULL")
    w = Window.partitionBy("book", "chapter", "kind").orderBy("verse")
    runs = both.withColumn("run", F.col("verse") - F.row_number().over(w))
    return runs.groupBy("book", "chapter", "kind", "run").agg(F.min("verse").alias("first"), F.max("verse").alias("last"), F.count("*").alias("keys")).drop("run")


def insertion_points(target: DataFrame, source: DataFrame) -> DataFrame:
    """(book, chapter, verse, at): where the source's verses that the target lacks would go.

    Both sides are (book, chapter, verse, begin, end). The place is the end of the chapter's last verse before, else the
    begin of its first verse, else the end of the book's last verse (0 of an empty book): an as-of join by one window over
    a chapter's verses of both sides.
    """
    key = ["book", "chapter", "verse"]
    missing = source.select(*key).distinct().join(target.select(*key), key, "left_anti")
    both = target.select(*key, "begin", "end").unionByName(missing, allowMissingColumns=True)
    w = Window.partitionBy("book", "chapter").orderBy("verse")
    both = both.withColumn("before", F.last("end", True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("first", F.first("begin", True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    last = target.groupBy("book").agg(F.max(F.struct("chapter", "verse", "end"))["end"].alias("book_end"))
    out = both.filter("end IS NULL").join(last, "book", "left")
    return out.select(*key, F.coalesce("before", "first", "book_end", F.lit(0)).cast("long").alias("at"))


def copied_runs(pairs: DataFrame, least: int = 3) -> DataFrame:
    """(unit, run, eligible): the longest run of target words that the source holds too, at least `least`.

    pairs(unit, target, source). Runs are found inside the row: joined marks of held and other words, split at the others.
    """
    # made by a generator, so that the words are found once a row and not once in every place that names them
    w = pairs.select("unit", F.inline(F.array(F.struct(words(F.col("target")).alias("t"), F.array_distinct(words(F.col("source"))).alias("s")))))
    marks = F.array_join(F.transform("t", lambda x: F.when(F.array_contains(F.col("s"), x), "1").otherwise("0")), "")
    run = F.array_max(F.transform(F.split(marks, "0+"), lambda x: F.char_length(x))).cast("long")
    out = w.select("unit", F.inline(F.array(F.struct(F.size("t").cast("long").alias("eligible"), run.alias("run")))))
    return out.filter(F.col("run") >= least)


def typos(forms: DataFrame, rare: int = 5, frequent: int = 200, least: int = 4) -> DataFrame:
    """(corpus, word, n, target, target_n): rare words one edit (or one swap of neighbours) from a frequent one.

    forms(corpus, word, n, title). Candidates meet through deletion variants: two words within one edit share a variant
    of at most one deleted character each, so nothing but equal strings is joined.
    """
    ok = forms.filter(F.char_length("word") >= least)
    r = ok.filter((F.col("n") < rare) & (F.col("title") == 0)).select("corpus", "word", "n")
    f = ok.filter(F.col("n") >= frequent).select("corpus", F.col("word").alias("target"), F.col("n").alias("target_n"))

    def variants(df: DataFrame, c: str) -> DataFrame:
        cut = F.transform(F.sequence(F.lit(1), F.char_length(c)), lambda i: F.concat(F.substring(F.col(c), F.lit(1), i - 1), F.substring(F.col(c), i + 1, F.char_length(c))))
        return df.withColumn("variant", F.explode(F.array_distinct(F.concat(F.array(c), cut))))

    both = variants(r, "word").join(variants(f, "target"), ["corpus", "variant"]).drop("variant").distinct()
    i = F.expr("array_min(filter(sequence(1, char_length(word)), i -> substring(word, i, 1) <> substring(target, i, 1)))")
    swapped = (F.char_length("word") == F.char_length("target")) & (F.concat(F.expr("substring(word, 1, at - 1)"), F.expr("substring(word, at + 1, 1)"), F.expr("substring(word, at, 1)"), F.expr("substring(word, at + 2)")) == F.col("target"))
    both = both.withColumn("at", i).filter((F.levenshtein("word", "target") == 1) | swapped)
    return both.filter("word <> target AND substring(word, 1, 1) = substring(target, 1, 1)").select("corpus", "word", "n", "target", "target_n")
