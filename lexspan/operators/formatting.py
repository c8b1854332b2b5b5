"""White-space canon of marked-up books, as a chain of replacements; running it again changes nothing.

Patterns are in the dialect that Java's and RE2's engines share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .markers import of_kind

_BLOCK = "|".join(sorted(of_kind("book", "head", "title", "intro", "chapter", "heading", "paragraph", "row"), key=lambda m: (-len(m), m)))
#: rule -> (pattern, replacement), applied in this order
RULES: dict[str, tuple[str, str]] = {
    "normalize-newlines": ("\\r\\n?", "\n"),
    "marker-ws-at-line-start": ("(^|\\n)[ \\t]+\\\\", "$1\\\\"),
    "block-marker-own-line": (f"([^\\n])[ \\t]*\\\\({_BLOCK})([ \\t\\n]|\\z)", "$1\n\\\\$2$3"),
    "delimiter-single": ("(\\\\\\+?[a-z]+[0-9]*)[ \\t][ \\t]+", "$1 "),
    "designator-ws-single": ("(\\\\[cv] [0-9][0-9a-z,-]*)[ \\t][ \\t]+", "$1 "),
    "trim-text-edges": ("[ \\t]+(\\n|\\z)", "$1"),
    "collapse-blank-lines": ("\\n\\n+", "\n"),
}


def formatted(books: DataFrame, remove: tuple[str, ...] = (), rules: tuple[str, ...] = tuple(RULES)) -> DataFrame:
    """(book, src): books(book, src) with every marker of `remove` taken out and the rules applied."""
    src = F.col("src")
    for m in remove:
        src = F.regexp_replace(src, f"\\\\{m}(?:[ ]|(\\n)|\\z)", "$1")
    for r in RULES:
        if r in rules:
            pattern, put = RULES[r]
            src = F.regexp_replace(src, pattern, put)
    return books.select("book", src.alias("src"))


def formatted_sql(books: str) -> str:
    src = "src"
    for pattern, put in RULES.values():
        lit = lambda s: "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
        src = f"regexp_replace({src}, {lit(pattern)}, {lit(put.replace('$1', chr(92) + '1').replace('$2', chr(92) + '2').replace('$3', chr(92) + '3'))}, 'g')"
    return f"SELECT book, {src} AS src FROM ({books})"


def rules_broken_sql(books: str) -> str:
    lit = lambda s: "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    each = " UNION ALL ".join(f"SELECT book, '{r}' AS rule, len(regexp_extract_all(src, {lit(p)}))::bigint AS places FROM b" for r, (p, _) in RULES.items())
    return f"WITH b AS ({books}) SELECT * FROM ({each}) WHERE places > 0"


def rules_broken(books: DataFrame) -> DataFrame:
    """(book, rule, places): how often each rule would change a book as it stands."""
    each = F.array(*[F.struct(F.lit(r).alias("rule"), F.size(F.regexp_extract_all("src", F.lit(p), F.lit(0))).cast("long").alias("places")) for r, (p, _) in RULES.items()])
    return books.select("book", F.inline(F.filter(each, lambda x: x["places"] > 0)))
