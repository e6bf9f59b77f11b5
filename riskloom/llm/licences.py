"""Operator 4: licence scans by sparse TF-IDF cosine, SQL functions only.

A file's notice units are its lines and, for a licence file, its whole text.  Template and
unit are sparse TF-IDF vectors over the templates' words (``df`` counts over all files);
words outside them add to a unit's length with the greatest weight, so a notice inside
other prose scores lower.  A unit with cosine ``THRESHOLD`` or more to a template carries
that licence; a file has the licence of its best unit.  To reach the threshold, unit and
template must share one of the template's rarest words, those that its other words can't
make up for; only units with such a word are compared, which loses none.

A file is a licence file of its directory if its base name says so or if a licence unit
makes up ``LICENCE_FILE`` of its words.  A file without a licence of its own takes the
nearest ancestor directory's (its own directory first), found by joining the directory's
ancestors with the directories that have a licence file.  Directories are resolved once,
whatever number of files they hold.

Null texts count as empty, null paths as files at the root; repeated rows each give a row.
Ties go to the greater cosine, then the licence that comes first by name.  Whole texts are
read; only path and text are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import materialise

THRESHOLD = 0.6
LICENCE_FILE = 0.5

# Notices as they are commonly given in headers.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."],
    "BSD-3-Clause": ["Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
                     "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.",
                "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License, version 2."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3."],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3."],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}
LICENCE_NAMES = r"(?i)^(licen[cs]e|copying|notice|unlicense)(\.[a-z]+)?$"


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def template_words(spark: SparkSession, templates: dict[str, list[str]]) -> DataFrame:
    """licence, template, word, tf: bounded by the templates given."""
    rows = [(name, f"{name}#{i}", text) for name, texts in templates.items() for i, text in enumerate(texts)]
    t = spark.createDataFrame(rows, "licence string, template string, notice string")
    return t.select("licence", "template", F.explode(words(F.col("notice"))).alias("word")).groupBy("licence", "template", "word").agg(F.count("*").alias("tf"))


def scan(files: DataFrame, templates: dict[str, list[str]] | None = None, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """One row per file row: path, licence, cosine, found (own, inherited or null), source (directory)."""
    spark = files.sparkSession
    files = files.select(F.coalesce(F.col(path_col), F.lit("")).alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known = materialise(template_words(spark, templates or TEMPLATES), "licence_words")
    vocabulary = sorted(r["word"] for r in known.select("word").distinct().collect())  # of the templates given

    # Document frequencies of the templates' words, over all files.
    listed = F.array(*[F.lit(w) for w in vocabulary])
    seen = files.select(F.explode(F.array_intersect(words(F.col("text")), listed)).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    n = files.count()
    df = {r["word"]: r["df"] for r in seen.collect()}
    w = {word: math.log((1 + n) / (1 + df.get(word, 0))) + 1 for word in vocabulary}
    top = math.log(1 + n) + 1
    vectors: dict[tuple[str, str], dict[str, float]] = {}
    for r in known.collect():
        vectors.setdefault((r["licence"], r["template"]), {})[r["word"]] = r["tf"] * w[r["word"]]
    unit, probes = [], set()
    for (licence, template), v in sorted(vectors.items()):
        norm = sum(x * x for x in v.values()) ** 0.5
        unit += [(licence, template, word, x / norm) for word, x in v.items()]
        left = 1.0
        for word, x in sorted(v.items(), key=lambda p: (-w[p[0]], p[0])):
            if left < THRESHOLD * THRESHOLD:
                break  # what remains can't reach the threshold
            probes.add(word)
            left -= (x / norm) ** 2
    template = F.broadcast(spark.createDataFrame(unit, "licence string, template string, word string, t double"))

    # Units that may match, weighed.  A unit's own length counts all its words.
    probe = r"(?iu)(?<![\p{L}\p{N}])(?:" + "|".join(sorted(probes)) + r")(?![\p{L}\p{N}])"
    files = files.withColumn("file", F.xxhash64("path")).withColumn("h", F.xxhash64("text"))
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    lines = F.split("text", r"\r?\n")
    may = files.where(F.col("text").rlike(probe)).select("path", "h", name.rlike(LICENCE_NAMES).alias("named"), F.size(words(F.col("text"))).alias("n_words"), lines.alias("lines"), "text").dropDuplicates(["path", "h"])
    may = may.withColumn("units", F.filter(F.when(F.col("named"), F.concat("lines", F.array("text"))).otherwise(F.col("lines")), lambda x: x.rlike(probe)))
    one = may.select("path", "h", "named", "n_words", F.posexplode("units").alias("unit", "u"))
    bags = one.select("path", "h", "named", "n_words", "unit", F.size(words(F.col("u"))).alias("n"), F.explode(words(F.col("u"))).alias("word"))
    tf = bags.groupBy("path", "h", "named", "n_words", "unit", "n", "word").agg(F.count("*").alias("tf"))
    idf = F.broadcast(spark.createDataFrame(sorted(w.items()), "word string, idf double"))
    weighed = materialise(tf.join(idf, "word", "left").withColumn("x", F.col("tf") * F.coalesce("idf", F.lit(top))), "licence_units")
    key = ["path", "h", "unit"]
    norms = weighed.groupBy(*key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = (weighed.join(template, "word").groupBy(*key, "named", "n_words", "n", "licence", "template").agg(F.sum(F.col("x") * F.col("t")).alias("dot")))
    hit = dots.join(norms, key).withColumn("cosine", F.col("dot") / F.col("norm")).where(F.col("cosine") >= THRESHOLD)
    best = F.min(F.struct((-F.col("cosine")).alias("c"), "licence", "unit"))
    own = (hit.groupBy("path", "h").agg(best.alias("best"), F.max((F.col("named") | (F.col("n") >= LICENCE_FILE * F.col("n_words"))).cast("int")).alias("whole"))
           .select("path", "h", F.col("best.licence").alias("licence"), F.round(-F.col("best.c"), 6).alias("cosine"), (F.col("whole") == 1).alias("whole")))
    own = materialise(own, "licence_own")

    # Directories: the licence of each that has a licence file, then the nearest ancestor's.
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    given = (own.where("whole").groupBy(folder.alias("dir")).agg(F.min(F.struct((-F.col("cosine")).alias("c"), "licence")).alias("b"))
             .select("dir", F.col("b.licence").alias("licence")))
    parts = F.split("dir", "/")
    dirs = files.select(folder.alias("dir")).distinct()
    ancestors = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("up")).distinct()
    nearest = (ancestors.join(given.withColumnRenamed("dir", "up"), "up").groupBy("dir")
               .agg(F.max_by(F.struct("licence", "up"), F.length("up")).alias("b")).select("dir", F.col("b.licence").alias("inherited"), F.col("b.up").alias("source")))
    nearest = materialise(nearest, "licence_dirs")
    rows = files.select("path", "h", folder.alias("dir"))
    got = rows.join(own.select("path", "h", "licence", "cosine"), ["path", "h"], "left").join(nearest, "dir", "left")
    found = F.when(F.col("licence").isNotNull(), "own").when(F.col("inherited").isNotNull(), "inherited")
    return got.select("path", F.coalesce("licence", "inherited").alias("licence"), "cosine", found.alias("found"), F.when(F.col("licence").isNull(), F.col("source")).alias("source"))
