"""The tree of a marked-up book as a table of nodes, and what its structure gets wrong.

A stack machine per book is outside SQL: tokens of one book (numbers and markers, no texts) go to Python in order, a
book at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .folded import folded
from .markers import MARKERS
from .markup import tokens

#: how deep each kind stands: a marker closes everything open that stands as deep or deeper, notes apart
_DEPTH = {"book": 1, "head": 1, "title": 1, "chapter": 1, "heading": 1, "paragraph": 1, "intro": 1, "row": 1, "sidebar": 1, "periph": 1, "cell": 2, "verse": 2, "note": 3, "notechar": 4, "char": 4}
NODE = "book string, node int, parent int, marker string, kind string, first_pos int, last_pos int, closed string"


def _tree(book, rows):
    out, stack, last = [], [], 0
    out.append([book, 0, None, None, "root", 0, 0, "end"])
    stack.append((0, 0))

    def close(how: str, pos: int) -> None:
        node, _ = stack.pop()
        out[node][6], out[node][7] = pos, how

    for _, pos, kind, marker in rows:
        if kind == "Marker":
            what = MARKERS.get(marker, "unknown")
            depth = _DEPTH.get(what, 4)
            in_note = any(out[n][4] == "note" for n, _ in stack)
            while len(stack) > 1 and stack[-1][1] >= depth and not (in_note and what == "char" and out[stack[-1][0]][4] == "note"):
                close("implied", last)
            out.append([book, len(out), stack[-1][0], marker, what, pos, pos, "end"])
            stack.append((len(out) - 1, depth))
        elif kind == "ClosingMarker":
            open_at = next((i for i in range(len(stack) - 1, 0, -1) if out[stack[i][0]][3] == marker), None)
            if open_at is None:
                out.append([book, len(out), stack[-1][0], marker, "orphan", pos, pos, "orphan"])
            else:
                while len(stack) - 1 > open_at:
                    close("implied", last)
                close("explicit", pos)
        last = pos
    while stack:
        close("end", last)
    return out


def nodes(books: DataFrame) -> DataFrame:
    """(book, node, parent, marker, kind, first_pos, last_pos, closed): nodes in order of their opening; the root is 0.

    closed: explicit, implied (by what came after), end (of the book) or orphan (a closing marker without an opening one).
    """
    return folded(tokens(books).select("book", "pos", "kind", "marker"), "book", ["pos"], _tree, NODE)


def structure_lint(tree: DataFrame) -> DataFrame:
    """(book, code, n) of nodes(): unclosed notes and character spans, spans open at the end, orphaned closing markers."""
    code = (
        F.when(F.col("closed") == "orphan", "orphan-closer")
        .when((F.col("kind") == "note") & (F.col("closed") == "implied"), "unclosed-note")
        .when((F.col("kind") == "char") & (F.col("closed") == "implied"), "unclosed-char")
        .when(F.col("kind").isin("note", "char") & (F.col("closed") == "end"), "unclosed-at-eof")
    )
    return tree.withColumn("code", code).filter("code IS NOT NULL").groupBy("book", "code").agg(F.count("*").alias("n"))


def owners(tree: DataFrame, tokens_: DataFrame) -> DataFrame:
    """(book, pos, node): the innermost node each token stands in, by one sorted run a book."""
    opens = tree.filter("kind <> 'orphan'").select("book", F.col("first_pos").alias("pos"), F.lit(1).alias("step"), "node")
    shuts = tree.filter("kind NOT IN ('orphan', 'root')").select("book", (F.col("last_pos") + 1).alias("pos"), F.lit(0).alias("step"), F.col("parent").alias("node"))
    # of nodes that end at one place the outermost decides, so its parent is the smallest
    shuts = shuts.groupBy("book", "pos", "step").agg(F.min("node").alias("node"))
    marks = opens.groupBy("book", "pos", "step").agg(F.max("node").alias("node")).unionByName(shuts)
    every = tokens_.select("book", "pos", F.lit(2).alias("step"), F.lit(None).cast("int").alias("node")).unionByName(marks)
    order = Window.partitionBy("book").orderBy("pos", "step").rowsBetween(Window.unboundedPreceding, 0)
    return every.withColumn("node", F.last("node", True).over(order)).filter("step = 2").select("book", "pos", "node")
