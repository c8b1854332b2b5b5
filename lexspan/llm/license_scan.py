"""License scans by diagonal voting, in DataFrame functions only.

Every rolling hash of GRAM words of a text is joined to the places where the templates hold it (a fixed list in this
module, so the broadcast side has a proven bound); the words themselves are then compared. A hit votes for its diagonal
(word in the text less word in the template). A template's votes on one diagonal are an exact copy; diagonals that lie
within SHIFT words are merged, which bridges inserted and dropped words. A merged span is verified: it must hold at
least COVERAGE of the template's grams in at most STRETCH times the template's words.

The base phrases are templates of their own and need all their grams on one diagonal; they label as given. The templates
of the method label by verified spans.

Defined cases: null texts count as empty, texts without words have 0 words and null places; every input row gives one
row (rows are told apart by doc_id, null as well, and text); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import row_key, text_of, written

GRAM = 3
SHIFT = 3
COVERAGE = 0.6
STRETCH = 1.5
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))

TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)


def template_rows() -> list[tuple]:
    """(template, base, label, grams, words, at, w0, w1, w2) of every gram of every template."""
    out = []
    for number, (base, (label, text)) in enumerate([*((True, x) for x in BASE), *((False, x) for x in TEMPLATES)]):
        w = text.split(" ")
        out += [(number, base, label, len(w) - GRAM + 1, len(w), i, *w[i : i + GRAM]) for i in range(len(w) - GRAM + 1)]
    return out


def templates(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(template_rows(), "template int, base boolean, label string, grams int, size int, at int, w0 string, w1 string, w2 string")
    return rows.withColumn("gram", F.xxhash64("w0", "w1", "w2"))


def _lowered(text: Column) -> Column:
    """lower() is the same as lowering A-Z here: the two other letters that it takes into ASCII are replaced beforehand by
    ones that stay outside (no template holds either), and nothing else outside ASCII can equal a template's word."""
    return F.lower(F.replace(F.replace(text, F.lit("\u212a"), F.lit("\u0138")), F.lit("\u0130"), F.lit("\u0131")))


def _words(docs: DataFrame) -> DataFrame:
    text = text_of(docs)
    return docs.select("doc_id", row_key(docs["doc_id"], text).alias("key"), F.array_remove(F.split(_lowered(text), SEPARATORS), "").alias("words"))


def votes(docs: DataFrame) -> DataFrame:
    """(doc_id, key, template.., diagonal, places): the template places that hit on each diagonal."""
    known = templates(docs.sparkSession)
    w = F.col("words")
    # a row a gram, of its own three words only: the text's array of words does not travel with it
    grams = F.transform(w, lambda x, i: F.struct(i.alias("pos"), x.alias("x0"), F.get(w, i + 1).alias("x1"), F.get(w, i + 2).alias("x2")))
    every = _words(docs).select("doc_id", "key", F.explode(grams).alias("g")).select("doc_id", "key", "g.*")
    every = every.withColumn("gram", F.xxhash64("x0", "x1", "x2"))
    hits = every.join(F.broadcast(known), "gram").filter("x0 = w0 AND x1 = w1 AND x2 = w2")
    return hits.groupBy("doc_id", "key", "template", "base", "label", "grams", "size", (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.collect_set("at").alias("places"))


def spans(voted: DataFrame) -> DataFrame:
    """(doc_id, key, label, first, last, coverage): verified spans of the method's templates."""
    one = Window.partitionBy("doc_id", "key", "template").orderBy("diagonal")
    runs = voted.filter("not base").withColumn("new", (F.col("diagonal") - F.lag("diagonal").over(one) <= SHIFT).cast("int"))
    runs = runs.withColumn("run", F.sum(1 - F.coalesce("new", F.lit(0))).over(one.rowsBetween(Window.unboundedPreceding, 0)))
    merged = runs.groupBy("doc_id", "key", "template", "label", "grams", "size", "run").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("held"),
        F.min(F.col("diagonal") + F.array_min("places")).alias("first"),
        F.max(F.col("diagonal") + F.array_max("places") + GRAM - 1).alias("last"),
    )
    merged = merged.withColumn("coverage", F.col("held") / F.col("grams"))
    return merged.filter((F.col("coverage") >= COVERAGE) & (F.col("last") - F.col("first") + 1 <= STRETCH * F.col("size"))).select("doc_id", "key", "label", "first", "last", "coverage")


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row of docs(doc_id, text)."""
    voted, _ = written(docs.sparkSession, votes(docs), "votes")  # a row a template and diagonal that hits: short, and read twice
    base = voted.filter(F.col("base") & (F.size("places") == F.col("grams"))).select("doc_id", "key", "label", F.col("diagonal").cast("long").alias("at"), F.lit(1.0).alias("coverage"))
    found = base.unionByName(spans(voted).select("doc_id", "key", "label", F.lit(None).cast("long").alias("at"), "coverage"))
    each = found.groupBy("doc_id", "key").agg(
        F.count("at").alias("n_base"),
        F.min("at").alias("first_word"),
        F.max("at").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("at").isNotNull(), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("coverage").alias("score"),
    )
    rows = _words(docs).select("doc_id", "key", F.size("words").cast("long").alias("n_words"))
    same = rows["doc_id"].eqNullSafe(each["doc_id"]) & (rows["key"] == each["key"])
    return rows.join(each, same, "left").select(
        rows["doc_id"],
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def oracle() -> str:
    """The same in DuckDB, by words instead of hashes."""
    values = ", ".join(f"({t}, {str(b).lower()}, '{label}', {g}, {n}, {at}, '{w0}', '{w1}', '{w2}')" for t, b, label, g, n, at, w0, w1, w2 in template_rows())
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH known(template, base, label, grams, size, tpos, w0, w1, w2) AS (VALUES {values}),
tokens AS (SELECT row_number() OVER () AS row_id, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS words FROM documents),
every AS (SELECT row_id, words, unnest(range(len(words) - {GRAM - 1})) AS pos FROM tokens WHERE len(words) >= {GRAM}),
grams AS (SELECT row_id, pos, words[pos + 1] AS w0, words[pos + 2] AS w1, words[pos + 3] AS w2 FROM every),
voted AS (SELECT row_id, template, base, label, grams, size, pos - tpos AS diagonal, list(DISTINCT tpos) AS places FROM grams JOIN known USING (w0, w1, w2) GROUP BY ALL),
steps AS (SELECT *, coalesce((diagonal - lag(diagonal) OVER (PARTITION BY row_id, template ORDER BY diagonal) <= {SHIFT})::int, 0) AS near FROM voted WHERE NOT base),
runs AS (SELECT *, sum(1 - near) OVER (PARTITION BY row_id, template ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS run FROM steps),
merged AS (SELECT row_id, label, grams, size, len(list_distinct(flatten(list(places)))) / grams AS coverage, min(diagonal + list_min(places)) AS a, max(diagonal + list_max(places) + {GRAM - 1}) AS b FROM runs GROUP BY row_id, template, label, grams, size, run),
found AS (
  SELECT row_id, label, diagonal AS place, 1.0::double AS coverage FROM voted WHERE base AND len(places) = grams
  UNION ALL SELECT row_id, label, NULL, coverage FROM merged WHERE coverage >= {COVERAGE} AND b - a + 1 <= {STRETCH} * size),
total AS (SELECT row_id, count(place) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT CASE WHEN place IS NOT NULL THEN label END, ',' ORDER BY CASE WHEN place IS NOT NULL THEN label END) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(coverage) AS score FROM found GROUP BY row_id)
SELECT doc_id, len(words)::bigint AS n_words, coalesce(n_base, 0)::bigint AS n_base, first_word::bigint AS first_word, last_word::bigint AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::double AS score
FROM tokens LEFT JOIN total USING (row_id)"""
