"""Licence notices by diagonal voting, in DataFrame operations alone.

Every rolling word k-gram of a document is hashed and joined with the k-grams of the licence
templates.  A hit votes for its diagonal (its place in the document less its place in the
template); neighbouring diagonals, which small edits cause, merge; a merged span counts when
enough of the template stands in it and it is not much longer than the template.

The documents are read once: a marker before the first word of each joins the one marker of the
templates, so that documents without a hit stay in the same stream.  Hits are counted before they
are shuffled, and rows meet by document only.  The templates are fixed text: the broadcast side
has a few hundred rows whatever the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K = 4
#: Diagonals this near merge: insertions or deletions of so many words between two hits.
NEAR = 8
#: Share of a template's k-grams that a span needs, and how much longer than the template it may be.
COVERAGE, STRETCH = 0.6, 1.5
#: Splits words; A-Z are lower-cased before.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrase, label: in the order of the labels.
PHRASES = (("apache license", "apache"), ("cc by", "cc-by"), ("gnu general public license", "gpl"), ("mit license", "mit"))

#: Label → notices as licensors publish them.
TEMPLATES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ),
    "cc-by-4.0": (
        "This work is licensed under the Creative Commons Attribution 4.0 International License.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this license, visit",
    ),
    "gpl-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    ),
    "mit-notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",),
}
#: Hash of the marker that every document and the templates share.
MARK = -1


def words(text: Column) -> Column:
    """Lower-cased words.  lower() also maps letters beyond ASCII, which neither moves a word's bounds nor makes one of a phrase."""
    return F.array_remove(F.split(F.lower(text), NOT_WORD), "")


def _grams(spelled: Column, k: int) -> Column:
    """Structs of k neighbouring words, for every place; nulls beyond the end."""
    return F.arrays_zip(*(spelled if i == 0 else F.slice(spelled, i + 1, F.greatest(F.size(spelled) - i, F.lit(0))) for i in range(k)))


def _hash(gram: Column, k: int) -> Column:
    return F.xxhash64(*(gram[str(i)] for i in range(k)))


def _exploded(df: DataFrame, spelled: str, k: int) -> DataFrame:
    df = df.withColumn("_grams", _grams(F.col(spelled), k))
    inner = df.schema["_grams"].dataType.elementType
    names = [f.name for f in inner.fields]
    df = df.withColumn("_grams", F.col("_grams").cast("array<struct<" + ",".join(f"`{i}`:string" for i in range(k)) + ">>")) if names != [str(i) for i in range(k)] else df
    return df.drop(spelled)


def template_grams(spark: SparkSession, templates: dict[str, tuple[str, ...]] = TEMPLATES, k: int = K) -> DataFrame:
    """(h, template, label, at, grams, n): k-gram hashes of the templates with their places, and the marker."""
    rows = [(t, label, text) for t, (label, text) in enumerate((label, text) for label, own in sorted(templates.items()) for text in own)]
    df = spark.createDataFrame(rows, "template int, label string, text string").withColumn("w", words(F.col("text")))
    df = df.where(F.size("w") >= k).withColumn("n", F.size("w"))
    df = _exploded(df.select("template", "label", "n", "w"), "w", k)
    hits = df.select("template", "label", "n", F.posexplode("_grams").alias("at", "g")).where(F.col("at") <= F.col("n") - k)
    mark = spark.createDataFrame([(-1, None, 0, 0, MARK)], "template int, label string, n int, at int, h long")
    return hits.select("template", "label", "n", "at", _hash(F.col("g"), k).alias("h")).unionByName(mark)


def _phrase_columns(joined: Column, n_words: Column, phrase: str) -> tuple[Column, Column, Column]:
    """How often a phrase stands in " w1  w2  w3 ", and the word that its first and last place start at."""
    own = phrase.split()
    p = "".join(f" {w} " for w in own)
    count = ((F.length(joined) - F.length(F.replace(joined, F.lit(p), F.lit("")))) / len(p)).cast("long")
    spaces = lambda c: ((F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))) / 2).cast("long")
    has = F.contains(joined, F.lit(p))
    return F.when(has, count).otherwise(F.lit(0).cast("long")), F.when(has, spaces(F.substring_index(joined, p, 1))), F.when(has, n_words - spaces(F.substring_index(joined, p, -1)) - len(own))


def scan(docs: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, k: int = K) -> DataFrame:
    """Per row of docs (doc_id, text): n_words, n_base, first_word, last_word, base_labels, labels, score.

    `score` is the largest share of a template's k-grams in a verified span, 0.5 at least with a
    base phrase, else 0.  A null or empty text has no words and no labels; repeated rows and null
    doc_ids stay rows of their own; other columns are left out; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("w"))
    base = base.withColumn("row", F.monotonically_increasing_id()).withColumn("n_words", F.size("w").cast("long")).withColumn("joined", F.concat(F.lit(" "), F.array_join("w", "  "), F.lit(" ")))
    for phrase, label in PHRASES:
        count, first, last = _phrase_columns(F.col("joined"), F.col("n_words"), phrase)
        base = base.withColumns({f"c_{label}": count, f"f_{label}": first, f"l_{label}": last})
    labels = [label for _, label in PHRASES]
    # The marker takes place 0; words stand one place later.
    found = base.select(
        "row",
        "doc_id",
        "n_words",
        sum((F.col(f"c_{x}") for x in labels), F.lit(0)).cast("long").alias("n_base"),
        F.least(*(f"f_{x}" for x in labels)).alias("first_word"),
        F.greatest(*(f"l_{x}" for x in labels)).alias("last_word"),
        F.concat_ws(",", *(F.when(F.col(f"c_{x}") > 0, F.lit(x)) for x in labels)).alias("base_labels"),
        F.concat(F.array(F.lit("")), F.col("w")).alias("w"),
    )
    keep = ["row", "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]
    hits = _exploded(found, "w", k).select(*keep, F.posexplode("_grams").alias("pos", "g"))
    hits = hits.select(*keep, "pos", F.when(F.col("pos") == 0, F.lit(MARK).cast("long")).otherwise(_hash(F.col("g"), k)).alias("h"))
    hits = hits.join(F.broadcast(template_grams(spark, templates, k)), "h")
    diagonals = hits.groupBy(*keep, "template", "label", "n", (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.min("pos").alias("low"), F.max("pos").alias("high"), F.collect_set("at").alias("at"))
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.when(F.col("diagonal") - F.lag("diagonal").over(order) <= NEAR, 0).otherwise(1)
    merged = diagonals.withColumn("apart", apart).withColumn("span", F.sum("apart").over(order)).groupBy(*keep, "template", "label", "n", "span")
    spans = merged.agg(F.min("low").alias("low"), F.max("high").alias("high"), F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"))
    coverage = F.size("at") / F.greatest(F.col("n") - k + 1, F.lit(1))
    good = (F.col("template") >= 0) & (coverage >= COVERAGE) & (F.col("high") - F.col("low") + k <= STRETCH * F.col("n"))
    out = spans.withColumn("coverage", F.when(good, coverage)).groupBy(*keep).agg(F.collect_set(F.when(good, F.col("label"))).alias("own"), F.max("coverage").alias("score"))
    every = F.array_distinct(F.concat(F.filter(F.split("base_labels", ","), lambda x: x != ""), "own"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", F.array_join(F.array_sort(every), ",").alias("labels"), F.greatest(F.coalesce("score", F.lit(0.0)), F.when(F.col("n_base") > 0, 0.5).otherwise(0.0)).alias("score"))
