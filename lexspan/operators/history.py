"""Ordered logs of saves: clocks that cannot be right, one merged line of several histories, progress.

A save is (book, seq, author_at, committer_at, ..). Windows run over one history; the merged line is a range sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: 2015-01-01, before which no save was made.
FIRST_POSSIBLE = 1_420_070_400
MOST_LAG = 60


def repaired_clocks(saves: DataFrame, latest: int) -> DataFrame:
    """saves with estimate_at, estimate_committer_at and device_at (null where the device's clock stands).

    A run of impossible times keeps its own spacing and ends a second before the next good save; where that does not fit
    after the good save before it, it is spread evenly between the two. A run at either end sits a second apart beside
    the only good neighbour; a history without any good save is left alone.
    """
    order = Window.partitionBy("book").orderBy("seq")
    bad = ~F.col("author_at").between(FIRST_POSSIBLE, latest)
    good_at = F.when(~F.col("bad"), F.col("author_at"))
    s = saves.withColumn("bad", bad)
    s = s.withColumn("run", F.sum(F.when(F.col("bad"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    s = s.withColumn("b", F.last(good_at, True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # the next good save, read backwards: a frame that ends with the history is walked again for every row
    back = Window.partitionBy("book").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("a", F.last(good_at, True).over(back))
    of_run = Window.partitionBy("book", "run", "bad")
    s = s.withColumn("k", F.row_number().over(of_run.orderBy("seq"))).withColumn("n", F.count("*").over(of_run))
    s = s.withColumn("step", F.col("author_at") - F.lag("author_at").over(of_run.orderBy("seq")))
    whole = of_run.orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("least_step", F.min("step").over(of_run)).withColumn("first_at", F.first("author_at").over(whole)).withColumn("last_at", F.last("author_at").over(whole))
    kept = (F.coalesce("least_step", F.lit(0)) >= 0) & (F.col("first_at") + F.col("a") - 1 - F.col("last_at") > F.col("b"))
    at = (
        F.when(~F.col("bad") | (F.col("a").isNull() & F.col("b").isNull()), F.col("author_at"))
        .when(F.col("a").isNull(), F.col("b") + F.col("k"))
        .when(F.col("b").isNull(), F.col("a") - (F.col("n") - F.col("k") + 1))
        .when(kept, F.col("author_at") + F.col("a") - 1 - F.col("last_at"))
        .otherwise(F.col("b") + F.expr("(greatest(a - b, 0) * k) div (n + 1)"))
    )
    moved = F.col("bad") & (F.col("a").isNotNull() | F.col("b").isNotNull())
    lag = F.least(F.lit(MOST_LAG), F.greatest(F.lit(0), F.col("committer_at") - F.col("author_at")))
    s = s.withColumn("estimate_at", at.cast("long"))
    s = s.withColumn("estimate_committer_at", F.when(moved, F.col("estimate_at") + lag).otherwise(F.col("committer_at")).cast("long")).withColumn("device_at", F.when(moved, F.col("author_at")))
    return s.select(*saves.columns, "estimate_at", "estimate_committer_at", "device_at")


def repaired_clocks_sql(saves: str, latest: int) -> str:
    return f"""SELECT book, seq, author_at, committer_at, chunk, verses, CASE WHEN NOT bad OR (a IS NULL AND b IS NULL) THEN author_at WHEN a IS NULL THEN b + k WHEN b IS NULL THEN a - (n - k + 1)
 WHEN coalesce(least_step, 0) >= 0 AND first_at + a - 1 - last_at > b THEN author_at + a - 1 - last_at ELSE b + greatest(a - b, 0) * k // (n + 1) END::bigint AS estimate_at,
 (CASE WHEN bad AND (a IS NOT NULL OR b IS NOT NULL) THEN estimate_at + least({MOST_LAG}, greatest(0, committer_at - author_at)) ELSE committer_at END)::bigint AS estimate_committer_at,
 CASE WHEN bad AND (a IS NOT NULL OR b IS NOT NULL) THEN author_at END AS device_at
FROM (SELECT *, min(step) OVER r AS least_step, first_value(author_at) OVER o AS first_at, last_value(author_at) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_at
 FROM (SELECT *, row_number() OVER o AS k, count(*) OVER r AS n, author_at - lag(author_at) OVER o AS step
  FROM (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (w ROWS UNBOUNDED PRECEDING) AS run, last_value(CASE WHEN NOT bad THEN author_at END IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS b, first_value(CASE WHEN NOT bad THEN author_at END IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a
   FROM (SELECT *, NOT (author_at BETWEEN {FIRST_POSSIBLE} AND {latest}) AS bad FROM ({saves})) WINDOW w AS (PARTITION BY book ORDER BY seq))
  WINDOW r AS (PARTITION BY book, run, bad), o AS (PARTITION BY book, run, bad ORDER BY seq))
 WINDOW r AS (PARTITION BY book, run, bad), o AS (PARTITION BY book, run, bad ORDER BY seq))"""


def merged_line(saves: DataFrame, at: str = "estimate_at") -> DataFrame:
    """Saves of all histories as one line: merge_at never runs back within a book; saves that change nothing are dropped.

    The order is (merge_at, book, seq), ties going to the earlier book, then to the earlier save.
    """
    order = Window.partitionBy("book").orderBy("seq")
    state = Window.partitionBy("book", "chunk").orderBy("seq")
    s = saves.withColumn("merge_at", F.max(at).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    s = s.withColumn("changed", ~F.col("verses").eqNullSafe(F.lag("verses").over(state)))
    return s.filter("changed").select("merge_at", "book", "seq", "chunk").orderBy("merge_at", "book", "seq")


def progress(saves: DataFrame) -> DataFrame:
    """(book, seq, verses_present): after each save, over the latest state of every chunk of its book."""
    delta = F.col("verses") - F.coalesce(F.lag("verses").over(Window.partitionBy("book", "chunk").orderBy("seq")), F.lit(0))
    running = Window.partitionBy("book").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return saves.withColumn("delta", delta).select("book", "seq", F.sum("delta").over(running).cast("long").alias("verses_present"))


def day_of(unix: Column) -> Column:
    """The UTC day of a Unix time, as text."""
    return F.date_format(F.timestamp_seconds(unix), "yyyy-MM-dd")
