"""Character classes, the word rule and the fold, as Spark columns and as the same SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_L = "\\p{L}\\p{Nl}\\p{M}Ⓐ-ⓩ\\x{AD}\\x{A789}¹²³⁴⁵₁-₅\\x{200C}\\x{200D}"
LETTER = f"[{_L}]"
CORE = f"[{_L}\\p{{Nd}}]"
JOIN = "['’\\-‐‑־֊᐀·]"
#: A word: letters, glue and digits, single joiners between letters. Neither engine needs look-around for it.
WORD = f"{CORE}*{LETTER}{JOIN}(?:{LETTER}{JOIN}|{LETTER}{CORE}*{LETTER}{JOIN})*{LETTER}{CORE}*|{CORE}+"
#: The same words for an engine with look-around and possessive repeats, which never goes back over a word.
WORD_ONCE = f"{CORE}++(?:(?<={LETTER}){JOIN}(?={LETTER}){CORE}++)*+"
HAS_LETTER = "[\\p{L}\\p{Nl}]"
IS_LETTER = "^[\\p{L}\\p{M}\\p{Nl}]$"
IS_DIGIT = "^\\p{Nd}$"
IS_SPACE = "^[ \\t\\x{A0}\\x{2000}-\\x{200A}\\x{202F}\\x{3000}]$"
#: Maximal runs of marks: no letters, digits or white space.
RUN = "[^\\p{L}\\p{M}\\p{Nl}\\p{Nd}\\s\\x{A0}]+"


def char_class(c: Column) -> Column:
    """Edge (line break or end of text), Space, Digit, Letter or Nonletter."""
    return (
        F.when(c.isNull() | c.isin("\n", "\r"), "Edge")
        .when(c.rlike(IS_SPACE), "Space")
        .when(c.rlike(IS_DIGIT), "Digit")
        .when(c.rlike(IS_LETTER), "Letter")
        .otherwise("Nonletter")
    )


def char_class_sql(c: str) -> str:
    return (
        f"CASE WHEN {c} IS NULL OR {c} IN (chr(10), chr(13)) THEN 'Edge' WHEN regexp_matches({c}, '{IS_SPACE}') THEN 'Space' "
        f"WHEN regexp_matches({c}, '{IS_DIGIT}') THEN 'Digit' WHEN regexp_matches({c}, '{IS_LETTER}') THEN 'Letter' ELSE 'Nonletter' END"
    )


def fold(word: Column) -> Column:
    """Lower case by single characters (the dotted capital I gives a plain i)."""
    return F.lower(F.replace(word, F.lit("İ"), F.lit("i")))


def words(text: Column) -> Column:
    """The words of a text, those without a letter left out."""
    return F.filter(F.regexp_extract_all(text, F.lit(WORD_ONCE), F.lit(0)), lambda w: w.rlike(HAS_LETTER))


def words_of_chunk(chunk: Column) -> Column:
    """words() of a stretch between spaces; most are letters and at most one mark, which needs no search."""
    plain = F.when(chunk.rlike(r"^\p{L}+$"), F.array(chunk)).when(chunk.rlike(r"^\p{L}+[.,;:!?]$"), F.array(F.substring(chunk, F.lit(1), F.char_length(chunk) - 1)))
    return plain.otherwise(words(chunk))


def words_sql(text: str) -> str:
    return f"list_filter(regexp_extract_all({text}, '{WORD.replace(chr(39), chr(39) * 2)}'), lambda w: regexp_matches(w, '{HAS_LETTER}'))"


def share_bp(numerator: Column, denominator: Column) -> Column:
    """Basis points, rounded down, at most 10,000."""
    return F.least(F.lit(10_000), F.floor(numerator * 10_000 / denominator)).cast("long")


#: Quotation marks that don't say whether they open or close, those that do, and brackets by side.
DIRECTIONLESS = "[\"'＂＇]"
QUOTE = "[\\p{Pi}\\p{Pf}\"'‚„「」『』〝〞〟＂＇]"
CLOSER, BRACKET = "\\p{Pe}", "[\\p{Ps}\\p{Pe}]"
#: Characters that are drawn alike, group by group (fixed values).
LOOKALIKES = ("'’‘‛′`´ʹʼʽʾ", "\"“”‟″〃", "-‐‑‒–−﹘", "~˜∼", ".․", ",‚¸", ":։܃ː∶", ";;", "!ǃ", "|∣ǀ", "/∕⁄", "*∗", "<‹˂", ">›˃", "…⋯", "·•‧∙⋅")


def facing(prev: Column, following: Column) -> Column:
    """Which way a run of marks faces, by the classes of what stands outside it."""
    inner, outer = ("Letter", "Digit"), ("Space", "Edge")
    return (
        F.when((prev == "Letter") & (following == "Letter"), "Inside")
        .when(prev.isin(*inner) & following.isin(*outer), "Closing")
        .when(prev.isin(*outer) & following.isin(*inner), "Opening")
        .otherwise("Unknown")
    )


def facing_sql(prev: str, following: str) -> str:
    return f"CASE WHEN {prev} = 'Letter' AND {following} = 'Letter' THEN 'Inside' WHEN {prev} IN ('Letter', 'Digit') AND {following} IN ('Space', 'Edge') THEN 'Closing' WHEN {prev} IN ('Space', 'Edge') AND {following} IN ('Letter', 'Digit') THEN 'Opening' ELSE 'Unknown' END"
