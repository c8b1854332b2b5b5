"""Numbering schemes: counts, renumbering through a hub scheme, inventories, and votes on which scheme a text follows.

Tables: counts(scheme, book, chapter, last) and rows(scheme, from_book, from_chapter, from_verse, to_book, to_chapter,
to_verse, to_part, len, shape), shape being Parallel, Merge or Split and `to` the hub's numbering. Both are dimensions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .folded import folded

PLACE = ["book", "chapter", "verse"]


def stated_pairs(rows: DataFrame) -> DataFrame:
    """(scheme, book, chapter, verse, hub_book, hub_chapter, hub_verse, part): every pair the rows state."""
    i = F.explode(F.sequence(F.lit(0), F.col("len") - 1)).alias("i")
    r = rows.select("*", i)
    here = F.col("from_verse") + F.when(F.col("shape") == "Split", 0).otherwise(F.col("i"))
    hub = F.col("to_verse") + F.when(F.col("shape") == "Merge", 0).otherwise(F.col("i"))
    return r.select("scheme", F.col("from_book").alias("book"), F.col("from_chapter").alias("chapter"), here.alias("verse"), F.col("to_book").alias("hub_book"), F.col("to_chapter").alias("hub_chapter"), hub.alias("hub_verse"), F.col("to_part").alias("part"))


def numbered(counts: DataFrame) -> DataFrame:
    """(scheme, book, chapter, verse) of every verse a scheme numbers, the title's place 0 included."""
    return counts.select("scheme", "book", "chapter", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("verse"))


def hub_places(counts: DataFrame, rows: DataFrame) -> DataFrame:
    """(scheme, book, chapter, verse, hub_book, hub_chapter, hub_verse, part): where every verse sits in the hub; unstated verses keep their number."""
    said = stated_pairs(rows)
    every = numbered(counts).join(said, ["scheme", *PLACE], "left")
    return every.select("scheme", *PLACE, *[F.coalesce(f"hub_{c}", c).alias(f"hub_{c}") for c in PLACE], "part")


def _parts_meet(a, b):
    return a.isNull() | b.isNull() | (a == b)


def renumbered(verses: DataFrame, counts: DataFrame, rows: DataFrame, source: str, target: str) -> DataFrame:
    """(book, chapter, verse, verdict, there): each verse of `source`'s numbering under `target`'s.

    verdict: Same, Moved, Merged (other verses sit there too), Split (there are several) or Absent; there: the places as
    sorted 'BOOK c:v' texts. Both sides go to the hub and meet there in one equi-join.
    """
    hub = [f"hub_{c}" for c in PLACE]
    places = hub_places(counts, rows)
    a = places.filter(F.col("scheme") == source).select(*PLACE, *hub, F.col("part").alias("part_a"))
    b = places.filter(F.col("scheme") == target).select(*[F.col(c).alias(f"t_{c}") for c in PLACE], *hub, F.col("part").alias("part_b"))
    met = a.join(b, hub).filter(_parts_meet(F.col("part_a"), F.col("part_b"))).select(*PLACE, *[f"t_{c}" for c in PLACE]).distinct()
    sharing = met.groupBy(*[f"t_{c}" for c in PLACE]).agg(F.count("*").alias("sharing"))
    there = F.struct("t_book", "t_chapter", "t_verse")
    known = a.select(*PLACE).distinct()
    got = met.join(sharing, [f"t_{c}" for c in PLACE]).groupBy(*PLACE).agg(F.sort_array(F.collect_list(there)).alias("at"), F.max("sharing").alias("sharing"))
    same = (F.col("at")[0]["t_book"] == F.col("book")) & (F.col("at")[0]["t_chapter"] == F.col("chapter")) & (F.col("at")[0]["t_verse"] == F.col("verse"))
    n = F.coalesce(F.size("at"), F.lit(0))
    verdict = F.when(n == 0, "Absent").when(n > 1, "Split").when(F.col("sharing") > 1, "Merged").when(same, "Same").otherwise("Moved")
    out = verses.select(*PLACE).join(known.withColumn("known", F.lit(True)), PLACE, "left").join(got, PLACE, "left")
    spelled = F.transform(F.coalesce("at", F.array().cast("array<struct<t_book:string,t_chapter:int,t_verse:int>>")), lambda x: F.format_string("%s %d:%d", x["t_book"], x["t_chapter"], x["t_verse"]))
    return out.select(*PLACE, verdict.alias("verdict"), F.array_join(spelled, "; ").alias("there"))


def inventory(units: DataFrame) -> DataFrame:
    """(book, chapter, verses, last, gap, duplicate, out_of_order, defective) of units(book, chapter, at, first, last).

    A gap is a number missing below the last; a duplicate a number that stands twice, alone or in a bridge.
    """
    u = units.filter("first > 0 AND chapter > 0")
    w = Window.partitionBy("book", "chapter").orderBy("at")
    back = u.withColumn("back", F.col("first") < F.lag("first").over(w)).groupBy("book", "chapter").agg(F.coalesce(F.max("back"), F.lit(False)).alias("out_of_order"))
    each = u.select("book", "chapter", F.explode(F.sequence("first", F.greatest("first", "last"))).alias("verse")).groupBy("book", "chapter", "verse").agg(F.count("*").alias("times"))
    c = each.groupBy("book", "chapter").agg(F.count("*").alias("verses"), F.max("verse").alias("last"), F.max(F.col("times") > 1).alias("duplicate"))
    c = c.join(back, ["book", "chapter"]).withColumn("gap", F.col("verses") != F.col("last"))
    return c.select("book", "chapter", "verses", "last", "gap", "duplicate", "out_of_order", (F.col("gap") | F.col("duplicate") | F.col("out_of_order")).alias("defective"))


def votes(inventories: DataFrame, units: DataFrame, rules: DataFrame, fits: DataFrame) -> DataFrame:
    """(scheme, agree, disagree, voted, confidence), best first: how well each scheme fits the text.

    rules(rule, column, kind Last or Exist or NotExist, book, chapter, verse): a text passes a column if it passes all its
    tests. A rule abstains where it needs a defective or missing chapter. fits(rule, column, scheme): the columns a
    scheme agrees with. Rules whose schemes all fit, or that no column passes, do not vote.
    """
    have = units.filter("first > 0").select("book", "chapter", F.explode(F.sequence("first", F.greatest("first", "last"))).alias("verse")).distinct().withColumn("has", F.lit(True))
    t = rules.join(inventories.select("book", "chapter", F.col("last").alias("final"), "defective"), ["book", "chapter"], "left").join(have, ["book", "chapter", "verse"], "left")
    has = F.coalesce("has", F.lit(False))
    passes = F.when(F.col("final").isNull() | (F.col("defective") & (F.col("kind") != "Exist")), None).when(F.col("kind") == "Last", F.col("final") == F.col("verse")).when(F.col("kind") == "Exist", has).otherwise(~has)
    by = t.withColumn("passes", passes).groupBy("rule", "column").agg(F.min("passes").alias("all_pass"), F.max(F.col("passes").isNull()).alias("silent"))
    ok = by.withColumn("abstains", F.max("silent").over(Window.partitionBy("rule"))).filter("NOT abstains").filter("all_pass").select("rule", "column")
    passed = ok.select("rule").distinct()
    s = fits.join(passed, "rule").join(ok.withColumn("hit", F.lit(1)), ["rule", "column"], "left").groupBy("rule", "scheme").agg(F.max(F.coalesce("hit", F.lit(0))).alias("fit"))
    telling = s.groupBy("rule").agg(F.min("fit").alias("least")).filter("least = 0").select("rule")
    v = s.join(telling, "rule").groupBy("scheme").agg(F.sum("fit").alias("agree"), F.sum(1 - F.col("fit")).alias("disagree"))
    n = telling.agg(F.count("*").alias("voted"))
    every = fits.select("scheme").distinct().join(v, "scheme", "left").select("scheme", F.coalesce("agree", F.lit(0)).alias("agree"), F.coalesce("disagree", F.lit(0)).alias("disagree")).crossJoin(F.broadcast(n))  # one row beside a handful of schemes
    standing = Window.orderBy("disagree", F.desc("agree"))  # over the schemes, a handful
    ranked = every.withColumn("place", F.rank().over(standing)).withColumn("tied", F.count("*").over(Window.partitionBy("place"))).withColumn("lead_disagree", F.first("disagree").over(standing))
    top_tied = F.max(F.when(F.col("place") == 1, F.col("tied"))).over(Window.partitionBy())
    sure = F.when((F.col("voted") == 0) | (top_tied > 1), "Undetermined").when((F.col("voted") >= 20) & (F.col("lead_disagree") * 10 <= F.col("voted")), "Decided").otherwise("Leaning")
    return ranked.select("scheme", "agree", "disagree", "voted", sure.alias("confidence"))


def beyond_scheme(units: DataFrame, counts: DataFrame, scheme: str) -> DataFrame:
    """(book, chapter, code, verse): verses past the scheme's count, and chapters that end before it."""
    c = counts.filter(F.col("scheme") == scheme).select("book", "chapter", F.col("last").alias("count"))
    top = units.filter("first > 0").select("book", "chapter", F.greatest("first", "last").alias("end"), "first").join(c, ["book", "chapter"])
    over = top.filter("end > count").select("book", "chapter", F.lit("verse-beyond-scheme").alias("code"), F.col("end").alias("verse")).distinct()
    short = top.groupBy("book", "chapter", "count").agg(F.max("end").alias("end")).filter("end < count").select("book", "chapter", F.lit("chapter-ends-early").alias("code"), F.col("end").alias("verse"))
    return over.union(short)


def scheme_problems(counts: DataFrame, rows: DataFrame, excluded: DataFrame, books: list[str], built_in: tuple[str, ...] = ()) -> DataFrame:
    """(scheme, entry, problem): what keeps the schemes of these tables from being used, entry by entry.

    excluded(scheme, book, chapter, verse). A scheme needs a name that is no built-in one's; a book stands in the table of
    codes, with its chapters from 1 on and verses in each; rows pair ranges of one length, or one verse with several,
    inside the scheme's own counts, and give a part to a single verse of the hub only.
    """
    place = lambda b, c, v: F.concat(b, F.lit(" "), c, F.lit(":"), v)
    none = F.lit(None).cast("string")
    named = counts.select("scheme").distinct().select("scheme", F.lit("").alias("entry"), F.when(F.trim("scheme") == "", "a scheme needs a name").when(F.col("scheme").isin(*built_in), "a built-in scheme's name").otherwise(none).alias("problem"))
    by = counts.groupBy("scheme", "book").agg(F.count("*").alias("n"), F.countDistinct("chapter").alias("k"), F.min("chapter").alias("low"), F.max("chapter").alias("high"), F.min("last").alias("least"))
    book = F.when(~F.col("book").isin(*books), "not a book code").when(F.col("n") != F.col("k"), "given twice").when((F.col("low") != 1) | (F.col("high") != F.col("k")), "chapters are missing").when(F.col("least") < 1, "a chapter without verses")
    of_books = by.select("scheme", F.col("book").alias("entry"), book.alias("problem"))
    last = counts.groupBy("scheme", "book", "chapter").agg(F.max("last").alias("last"))
    end = F.col("from_verse") + F.when(F.col("shape") == "Split", 0).otherwise(F.col("len") - 1)
    r = rows.join(last.select("scheme", F.col("book").alias("from_book"), F.col("chapter").alias("from_chapter"), "last"), ["scheme", "from_book", "from_chapter"], "left")
    row = F.when(~F.col("shape").isin("Parallel", "Merge", "Split") | (F.col("len") < 1), "ranges of unlike lengths").when(F.col("last").isNull(), "no such chapter").when(end > F.col("last"), "past the scheme's counts").when(F.col("to_part").isNotNull() & (F.col("len") > 1), "a part on a range")
    of_rows = r.select("scheme", place("from_book", "from_chapter", "from_verse").alias("entry"), row.alias("problem"))
    x = excluded.join(last, ["scheme", "book", "chapter"], "left")
    of_excluded = x.select("scheme", place("book", "chapter", "verse").alias("entry"), F.when(F.col("last").isNull(), "no such chapter").when((F.col("verse") < 1) | (F.col("verse") > F.col("last")), "past the scheme's counts").alias("problem"))
    return named.unionByName(of_books).unionByName(of_rows).unionByName(of_excluded).filter("problem IS NOT NULL")


def accepted(numbers: DataFrame, gap: int = 3, restart: bool = True) -> DataFrame:
    """(unit, at, number, step, verse): numbers(unit, at, number) read in order as verse numbers.

    A number is the next verse if it is ahead of the last one by at most `gap`, a restart if it is 1 again, and no verse
    otherwise (step null); verse is the last one accepted up to here. A unit's numbers are folded one by one, as each
    decision hangs on the one before.
    """

    def fold(unit, rows):
        verse = 0
        for _, at, n in rows:
            step = None
            if n is not None:
                step = "next" if verse < n <= verse + gap else "restart" if restart and n == 1 and verse >= 1 else None
            verse = verse if step is None else n
            yield unit, at, n, step, verse

    kind = numbers.schema["unit"].dataType.simpleString()
    rows = numbers.select("unit", F.col("at").cast("long").alias("at"), F.col("number").cast("int").alias("number"))
    return folded(rows, "unit", ["at", "number"], fold, f"unit {kind}, at long, number int, step string, verse int")


def linked(edges: DataFrame) -> DataFrame:
    """(book, node, group): nodes of edges(book, a, b) by the smallest node that they hang together with, book by book.

    A book's correspondences are one group of rows of two short names (at most some thousands).
    """
    import pandas as pd

    def groups(key, rows: pd.DataFrame) -> pd.DataFrame:
        up: dict = {}

        def top(x):
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for a, b in zip(rows["a"], rows["b"], strict=True):
            x, y = sorted((top(a), top(b)))
            up[y] = x
        return pd.DataFrame({"book": [key[0]] * len(up), "node": list(up), "group": [top(x) for x in up]})

    return edges.groupBy("book").applyInPandas(groups, "book string, node string, group string")
