"""License scan by diagonal voting, with DataFrame functions only.

Every rolling word 2-gram of every text is hashed and joined to the positions of the templates'
2-grams; a hit's two words are compared as well. Each hit votes for a diagonal, its place in the text less its
place in the template. A phrase stands at a place exactly if all its 2-grams vote for that diagonal. For
the longer notices, diagonals at most ``SLACK`` apart are merged (words put in or left out), and a span
counts if it holds enough of the template's 2-grams. The template table is fixed and small, so it is broadcast.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SLACK = 2
# Phrases whose every place counts, with their labels.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
# Wordings of common public notices, with their labels.
NOTICES = [
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license", "apache"),
    ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "bsd"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
]
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def template_grams(spark) -> DataFrame:
    rows = []
    for t, (text, label, base) in enumerate([(*p, True) for p in PHRASES] + [(*n, False) for n in NOTICES]):
        words = text.split()
        rows += [(t, label, base, i, len(words) - 1, a, b) for i, (a, b) in enumerate(zip(words, words[1:]))]
    grams = spark.createDataFrame(rows, "template int, label string, base boolean, tpos int, grams int, t0 string, t1 string")
    return grams.withColumn("h", F.xxhash64("t0", "t1"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = 0.75) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null texts count as empty. Without a place, first_word and last_word are null; without a label, the labels are
    empty strings. score is 1 with a base label, else the largest share of a notice's 2-grams found in a
    span (0 if none reaches ``share``). Repeated rows get a row each; an empty table gives none. Other columns are ignored, whatever
    their names. Very long texts are read whole; only A-Z are lower-cased.
    """
    spark = docs.sparkSession
    words = F.array_remove(F.split(F.translate(F.coalesce(F.col(text_col), F.lit("")), ascii_uppercase, ascii_lowercase), _SEPARATORS, -1), "")
    split = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("uid"), words.alias("w"))
    n = F.size("w")
    grams = split.select("doc_id", "uid", n.cast("long").alias("n_words"), F.posexplode_outer(F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.greatest(n, F.lit(1))).alias("b"))).alias("pos", "g"))
    grams = grams.select("doc_id", "uid", "n_words", "pos", F.col("g.a").alias("a"), F.col("g.b").alias("b")).withColumn("h", F.xxhash64("a", "b"))
    rows = _vote(grams, template_grams(spark)).repartition("uid")
    diagonals = rows.groupBy("uid", "doc_id", "n_words", "template", "label", "base", "grams", "diagonal").agg(F.collect_set("tpos").alias("found"))
    near = W.partitionBy("uid", "template").orderBy("diagonal")
    apart = F.col("base") | (F.col("diagonal") - F.lag("diagonal").over(near) > SLACK)
    runs = diagonals.withColumn("new", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(near.rowsBetween(W.unboundedPreceding, 0)))
    spans = runs.groupBy("uid", "doc_id", "n_words", "template", "label", "base", "grams", "run").agg(F.size(F.array_distinct(F.flatten(F.collect_list("found")))).alias("votes"), F.min("diagonal").alias("start"))
    place = F.col("base") & (F.col("votes") == F.col("grams"))
    notice = ~F.col("base") & (F.col("votes") >= share * F.col("grams"))
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return spans.groupBy("uid", "doc_id", "n_words").agg(
        F.count(F.when(place, 1)).alias("n_base"),
        F.min(F.when(place, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(place, F.col("start"))).cast("long").alias("last_word"),
        names(F.when(place, F.col("label"))).alias("base_labels"),
        names(F.when(place | notice, F.col("label"))).alias("labels"),
        F.coalesce(F.max(F.when(place, F.lit(1.0)).when(notice, F.col("votes") / F.col("grams"))), F.lit(0.0)).alias("score"),
    ).drop("uid")


def _vote(grams: DataFrame, templates: DataFrame) -> DataFrame:
    """Hits with their diagonal, and each document's first 2-gram, so that documents without a hit stay."""
    same = (grams["h"] == templates["h"]) & (F.col("a") == F.col("t0")) & (F.col("b") == F.col("t1"))
    joined = grams.join(F.broadcast(templates), same, "left").where("template IS NOT NULL OR coalesce(pos, 0) = 0")
    return joined.select("uid", "doc_id", "n_words", "template", "label", "base", "grams", "tpos", (F.col("pos") - F.col("tpos")).alias("diagonal"))
