"""Attribute lists of markers: |name="value" pairs or one bare default value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAIR = '[A-Za-z0-9_-]+=(?:"[^"]*"|[^ \\t"][^ \\t]*)'
_PAIRS = f"^(?:{PAIR})(?:[ \\t]+{PAIR})*[ \\t]*\\z"


def interior(span: Column) -> Column:
    """An attribute list without its pipes; white space before the end stays unless a closing pipe follows it."""
    return F.regexp_replace(F.regexp_replace(span, r"^\|", ""), r"[ \t]*\|[ \t]*\z", "")


def attributes(lists: DataFrame) -> DataFrame:
    """(id, at, name, value, malformed) of lists(id, span): a row a pair, or one row of the bare value (name '').

    Nothing after the first flaw is read; the flaw is the last row: empty-name, bare-junk, missing-value or
    unterminated-quote.
    """
    body = F.regexp_replace(interior(F.col("span")), r"^[ \t]+", "")
    r = lists.select("id", body.alias("body")).filter("body <> ''")
    r = r.withColumn("bare", ~F.col("body").rlike(r"^[A-Za-z0-9_-]*="))
    good = F.regexp_extract("body", f"^((?:{PAIR}(?:[ \\t]+|\\z))*)", 1)
    r = r.withColumn("good", good).withColumn("rest", F.expr("substring(body, char_length(good) + 1)"))
    flaw = (
        F.when(F.col("rest") == "", None)
        .when(F.col("rest").rlike("^="), "empty-name")
        .when(F.col("rest").rlike(r"^[A-Za-z0-9_-]+=(?:[ \t]|\z)"), "missing-value")
        .when(F.col("rest").rlike(r'^[A-Za-z0-9_-]+="[^"]*\z'), "unterminated-quote")
        .otherwise("bare-junk")
    )
    # a quoted pair with no white space after it still counts; what follows is junk
    stuck = F.regexp_extract("rest", f"^({PAIR})", 1)
    found = F.regexp_extract_all("good", F.lit(PAIR), F.lit(0))
    found = F.when((F.col("rest") != "") & (stuck != ""), F.concat(found, F.array(stuck))).otherwise(found)
    pair = F.transform(found, lambda x: F.struct(F.regexp_extract(x, "^([^=]*)=", 1).alias("name"), F.regexp_replace(F.regexp_replace(x, "^[^=]*=", ""), '^"|"\\z', "").alias("value"), F.lit(None).cast("string").alias("malformed")))
    bad = F.when(flaw.isNotNull(), F.array(F.struct(F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("value"), flaw.alias("malformed")))).otherwise(F.array().cast("array<struct<name:string,value:string,malformed:string>>"))
    one = F.array(F.struct(F.lit("").alias("name"), F.col("body").alias("value"), F.lit(None).cast("string").alias("malformed")))
    return r.select("id", F.posexplode(F.when(F.col("bare"), one).otherwise(F.concat(pair, bad))).alias("at", "x")).select("id", "at", "x.name", "x.value", "x.malformed")


def checked(found: DataFrame, known: DataFrame) -> DataFrame:
    """found(id, at, name, value, malformed, marker) with status: defined, wildcard, user, unknown or malformed.

    known(marker, attribute, is_default): a dimension; an attribute ending in * stands for its prefix.
    """
    k = known.select("marker", F.col("attribute"), "is_default")
    exact = k.filter("attribute NOT LIKE '%*'").select("marker", F.col("attribute").alias("name"), F.lit(True).alias("exact"))
    default = k.filter("is_default").select("marker", F.lit("").alias("name"), F.lit(True).alias("by_default"))
    wild = k.filter("attribute LIKE '%*'").groupBy("marker").agg(F.collect_set(F.expr("substring(attribute, 1, char_length(attribute) - 1)")).alias("prefixes"))
    j = found.join(F.broadcast(exact), ["marker", "name"], "left").join(F.broadcast(default), ["marker", "name"], "left").join(F.broadcast(wild), "marker", "left")  # dimensions of the markup
    status = F.when(F.col("malformed").isNotNull(), "malformed").when(F.col("exact") | F.col("by_default"), "defined").when(F.exists("prefixes", lambda p: F.col("name").startswith(p)), "wildcard").when(F.col("name").rlike("^[xz]-"), "user").otherwise("unknown")
    return j.select(*found.columns, status.alias("status"))
