"""Licence scan: TF-IDF cosine of header sentences and licence files to templates, inherited down directories.

Every sentence or line of every text that holds a licence word, and every run of two to ``WRAP`` lines that begins
at such a line or the one before it (headers are wrapped), becomes a sparse TF-IDF vector and is compared with the
templates by cosine; the statistics are over all such sentences and lines of the corpus and the templates. A document whose
licence sentences, or one of whose runs, make up most of its words, or whose file name is that of a licence file, is a
licence file and speaks for its directory. A document without a licence of its own inherits that of the nearest
ancestor directory that has one.

Shape of the plan: words are counted first; then sentences and runs whose cosine cannot reach the threshold, by a bound from
the words they share with templates, are dropped where they are read; equal ones are collapsed before they are compared, so a header that a third of
all rows carry is one vector; templates are a fixed list and the only thing that is broadcast; directories
are resolved once for each distinct directory; all joins back to rows read both sides from files.

Defined results: null or empty texts have no licence of their own and inherit; a null path has no directory
and inherits nothing; of equal scores the licence first in the alphabet wins, of several licences in one
document the best score; of several licence files in a directory the best score; rows that repeat an id and a path
are one document, which has the best licence of its rows and is a licence file if one of them is; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm._base import table

# Licence identifiers and phrases of their headers and titles.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("LGPL-3.0", "licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "licensed under the GNU Affero General Public License, version 3"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright; CC0 1.0 Universal"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("Proprietary", "Copyright, all rights reserved"),
]
# Words of which a line must hold one to be looked at; names of licence files without extension.
MARKS = ["licen", "copyright", "spdx", "hereby", "redistribution", "reserved", "unencumbered", "public domain", "source code form", "cc0"]
FILE_NAMES = ["license", "licence", "copying", "unlicense", "notice"]

THRESHOLD = 0.75
FILE_SHARE = 0.5
#: Lines that a wrapped header takes at most.
WRAP = 6


def _marked(text: Column) -> Column:
    lowered = F.lower(text)
    found = F.lit(False)
    for mark in MARKS:
        found = found | F.contains(lowered, F.lit(mark))
    return found


def _terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^a-z0-9.]+|\.(?![0-9])"), lambda t: t != "")


def weigh(spark, lone: DataFrame) -> tuple[DataFrame, int]:
    """(term, idf) over all lone sentences (column piece, one row per occurrence) and the templates, and the number of both."""
    nothing = F.array(F.lit(None).cast("string"))  # a sentence as such: rows of the null term count them
    terms = lone.select(F.explode(F.concat(F.array_distinct(_terms(F.col("piece"))), nothing)).alias("term"))
    templates = spark.createDataFrame([(text,) for _, text in TEMPLATES], "body string").select(F.explode(F.concat(F.array_distinct(_terms(F.col("body"))), nothing)).alias("term"))
    seen = table(terms.unionByName(templates).groupBy("term").agg(F.count(F.lit(1)).alias("n")), "licence-terms")
    total = seen.where("term is null").first()["n"]
    return seen.where("term is not null").select("term", _idf(F.col("n"), total).alias("idf")), total


def _idf(n: Column, total: int) -> Column:
    return F.log(F.lit(float(total) + 1) / (n + 1)) + 1


def known_terms(spark, idf: DataFrame) -> DataFrame:
    """(term, license, template, idf, tw): the templates as vectors of length 1. Its size is that of the fixed template list."""
    templates = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(TEMPLATES)], "template int, license string, body string")
    tmpl = templates.select("template", "license", F.explode(_terms(F.col("body"))).alias("term")).groupBy("template", "license", "term").agg(F.count(F.lit(1)).alias("tf"))
    known = idf.join(F.broadcast(tmpl), "term").withColumn("tw", F.col("tf") * F.col("idf"))
    norms = known.groupBy("template").agg(F.sqrt(F.sum(F.col("tw") * F.col("tw"))).alias("norm"))
    known = known.join(F.broadcast(norms), "template")
    return table(known.select("term", "license", "template", "idf", (F.col("tw") / F.col("norm")).alias("tw")).coalesce(1), "licence-templates")


def may_reach(pieces: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """The pieces whose cosine with some template may reach the threshold; none that reaches it is left out.

    The dot product with a template is a sum over those words of a piece that templates have. The norm is at least the root of the sum of
    their squared weights and of 1 for each other word: no weight is below 1, and a word that repeats adds more.
    """
    vectors: dict[str, list[float]] = {}
    for r in known.collect():  # one row per word of a template
        vectors.setdefault(r["term"], [r["idf"] ** 2] + [0.0] * len(TEMPLATES))[1 + r["template"]] = r["idf"] * r["tw"]
    weights = F.create_map(*[c for term, v in vectors.items() for c in (F.lit(term), F.array(*[F.lit(x) for x in v]))])
    part = lambda name, c: F.inline(F.array(F.struct(c.alias(name))))
    keep = pieces.columns
    split = pieces.select("*", part("_terms", _terms(F.col("piece"))))
    split = split.select("*", part("_hits", F.filter("_terms", lambda t: t.isin(list(vectors)))))
    nothing = F.array(*[F.lit(0.0)] * (len(TEMPLATES) + 1))
    sums = split.where(F.size("_hits") > 0).select("*", part("_sums", F.aggregate("_hits", nothing, lambda acc, t: F.zip_with(acc, F.element_at(weights, t), lambda x, y: x + y))))
    best = F.array_max(F.slice("_sums", 2, len(TEMPLATES)))
    least = F.sqrt(F.get("_sums", F.lit(0)) + F.size("_terms") - F.size("_hits"))
    return sums.where(best >= F.lit(threshold - 1e-5) * least).select(*keep)


def score_sentences(sentences: DataFrame, idf: DataFrame, total: int, known: DataFrame) -> DataFrame:
    """Best template of each distinct sentence: (key, license, score). Input: key, sentence."""
    words = table(sentences.select("key", F.explode(_terms(F.col("sentence"))).alias("term")).groupBy("key", "term").agg(F.count(F.lit(1)).alias("tf")), "licence-words")
    # Words of runs alone are in no lone sentence.
    weighed = words.join(idf, "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", _idf(F.lit(0), total))).select("key", "term", "w")
    # The size of `known` is that of the fixed template list.
    vectors = weighed.join(F.broadcast(known.groupBy("term").agg(F.collect_list(F.struct("template", "license", "tw")).alias("hits"))), "term", "left")
    # Per sentence: its norm from all terms, and one dot product for each template that shares a term.
    norm = weighed.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = vectors.where(F.col("hits").isNotNull()).select("key", "w", F.inline("hits")).groupBy("key", "license", "template").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    scored = dots.join(norm, "key").withColumn("score", F.round(F.col("dot") / F.col("norm"), 6))
    best = scored.groupBy("key").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b"))
    return best.select("key", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: Column | None = None, *, threshold: float = THRESHOLD, file_share: float = FILE_SHARE) -> DataFrame:
    """One row per input row: doc_id, path, license, origin ('file', 'header', 'inherited' or 'none'), score, from_dir."""
    spark = docs.sparkSession
    path = F.col("path") if path is None else path
    base = docs.select(F.col(id_col).alias("id"), path.cast("string").alias("path"), F.col(text_col).alias("body"))
    rows = base.select("id", "path", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("dir"))
    sentence = F.lower(F.trim(F.regexp_replace("piece", r"\s+", " ")))
    marked = base.where(_marked(F.col("body"))).select(
        "id",
        "path",
        F.monotonically_increasing_id().alias("row"),
        F.size(F.filter(F.split("body", r"\s+"), lambda w: w != "")).alias("n_words"),
        F.filter(F.split("body", r"\n|(?<=[.!?])\s+"), _marked).alias("sentences"),
        F.split("body", r"\n").alias("lines"),
    )
    # `inline` keeps the arrays from being computed anew for each of their elements.
    step = lambda df, **named: df.select(*df.columns, F.inline(F.array(F.struct(*[c.alias(k) for k, c in named.items()]))))
    lined = step(marked.select("id", "path", "row", "n_words", F.inline(F.array(F.struct("sentences", "lines")))), flags=F.transform("lines", _marked))
    starts = step(lined, starts=F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda k: F.get("flags", k) | F.coalesce(F.get("flags", k + 1), F.lit(False))))
    run = lambda k: F.transform(F.sequence(F.lit(2), F.lit(WRAP)), lambda n: F.struct(F.array_join(F.slice("lines", k + 1, n), " ").alias("piece"), F.lit(0).alias("alone"), ((k + n) <= F.size("lines")).alias("whole")))
    runs = F.filter(F.flatten(F.transform("starts", run)), lambda p: p["whole"])
    alone = F.transform("sentences", lambda p: F.struct(p.alias("piece"), F.lit(1).alias("alone"), F.lit(True).alias("whole")))
    pieces = starts.select("id", "path", "row", "n_words", F.inline_outer(F.concat(alone, runs))).where(F.col("piece").isNotNull())
    idf, total = weigh(spark, marked.select(F.explode("sentences").alias("piece")))
    known = known_terms(spark, idf)
    # Most runs are prose beside a licence word: they are dropped before anything of them is written.
    pieces = may_reach(pieces, known, threshold)
    found = table(pieces.select("id", "path", "row", "n_words", "alone", sentence.alias("sentence"), F.size(F.split(F.trim("piece"), r"\s+")).alias("words")), "licence-sentences")
    distinct = table(found.select("sentence").distinct().withColumn("key", F.monotonically_increasing_id()), "licence-distinct")
    best = score_sentences(distinct, idf, total, known).where(F.col("score") >= threshold)
    scores = table(best.join(distinct, "key").select("sentence", "license", "score"), "licence-scores")
    each = found.join(scores, "sentence").groupBy("id", "path", "row").agg(
        F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b"),
        (F.greatest(F.sum(F.col("words") * F.col("alone")), F.max(F.col("words") * (1 - F.col("alone")))) / F.max("n_words")).alias("share"),
    )
    own = each.groupBy("id", "path").agg(F.min("b").alias("b"), F.max("share").alias("share"))
    name = F.lower(F.regexp_extract("path", r"([^/.]*)[^/]*$", 1))
    is_file = (F.col("share") >= file_share) | F.coalesce(name.isin(FILE_NAMES), F.lit(False))
    own = table(own.select("id", "path", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"), is_file.alias("is_file")), "licence-own")

    speaks = own.where(F.col("is_file") & F.col("path").isNotNull()).select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("at"), "license", "score")
    of_dir = speaks.groupBy("at").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b")).select("at", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"))
    dirs = table(rows.where(F.col("path").isNotNull()).select("dir").distinct(), "licence-dirs")
    parts = F.split("dir", "/")
    above = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("at")).distinct()
    nearest = above.join(of_dir, "at").groupBy("dir").agg(F.max_by(F.struct("at", "license", "score"), F.length("at")).alias("d"))
    nearest = table(nearest.select("dir", F.col("d.at").alias("from_dir"), F.col("d.license").alias("dir_license"), F.col("d.score").alias("dir_score")), "licence-nearest")
    own = own.select(F.col("id").alias("own_id"), F.col("path").alias("own_path"), "license", "score", "is_file")
    out = rows.join(own, F.col("id").eqNullSafe(F.col("own_id")) & F.col("path").eqNullSafe(F.col("own_path")), "left").join(nearest, "dir", "left")
    has = F.col("license").isNotNull()
    inherits = ~has & F.col("path").isNotNull() & F.col("dir_license").isNotNull()
    return out.select(
        F.col("id").alias("doc_id"),
        "path",
        F.coalesce("license", F.when(inherits, F.col("dir_license"))).alias("license"),
        F.when(has & F.col("is_file"), "file").when(has, "header").when(inherits, "inherited").otherwise("none").alias("origin"),
        F.coalesce("score", F.when(inherits, F.col("dir_score"))).alias("score"),
        F.when(inherits, F.col("from_dir")).alias("from_dir"),
    )
