"""License scans: sparse TF-IDF cosine of notices and licence files to templates, then inheritance by directory.

Passages of a file that name a licence (sentences, lines and all such lines
together; whole paragraphs and runs of comment lines, however they are
wrapped; the whole text of a licence file) become sparse TF-IDF vectors;
document frequencies are those of the template words over all files.  A join
on words with the templates, a fixed small table, gives the cosines.  A file without
a licence of its own takes the one of the nearest directory above it that has
a recognised licence file, found by joins on directory paths.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.common import documents, materialise

#: Notices and opening words of public licences, several per licence.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
                   "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless "
                   "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
                   "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
            "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
                     "following conditions are met: Redistributions of source code must retain the above copyright notice, this list "
                     "of conditions and the following disclaimer. Neither the name of the copyright holder nor the names of its "
                     "contributors may be used to endorse or promote products derived from this software."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
                     "following conditions are met: Redistributions of source code must retain the above copyright notice, this list "
                     "of conditions and the following disclaimer."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
                "License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
                "License as published by the Free Software Foundation; either version 2 of the License, or any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
                "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "Released under the ISC License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "Released under CC0 1.0 Universal, public domain dedication."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "Copyright. All rights reserved."),
)
CUE = "(?i)licen[cs]e|copyright|copyleft|spdx|redistribut|public\\W+domain|permission|all\\W+rights\\W+reserved" \
      "|source\\W+code\\W+form|free\\W+software"
LICENCE_FILE = "(?i)^(?:licen[cs]e|copying|unlicense|notice)(?:[._-].*)?$"
SENTENCE = "(?<=[.!?;|])\\s+"
#: Lines that are no comments; between paragraphs: lines without letters and digits; between runs of comment lines; within a block.
NO_COMMENT = "(?md)^(?![ \\t]*(?:#|//|/\\*|\\*|;|--|%|!|'|\"|<!--|\\.\\.|(?i:rem|dnl)\\b)).*$"
BETWEEN, APART, WRAP = "\n[^\\p{L}\\p{N}]*\n", "\n\\s*\n", "\\s*\n[^\\p{L}\\p{N}\n]*"
NOT_TERM = "[^a-z0-9.+]+|\\.(?![0-9])"
THRESHOLD = 0.6


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), NOT_TERM, -1), lambda t: t != "")


def _terms(text: str) -> list[str]:
    return [t for t in re.split(NOT_TERM, text.lower()) if t]


def _vocabulary() -> list[str]:
    return sorted({t for _, text in TEMPLATES for t in _terms(text)})


def inverse_frequencies(files: DataFrame) -> DataFrame:
    """(term, idf) of the template words, and the idf of a word in no file under the empty term; over all whole texts."""
    vocabulary = F.array(*[F.lit(t) for t in _vocabulary()])
    hits = files.select(F.explode(F.array_append(F.array_intersect(terms(F.coalesce(F.col("text"), F.lit(""))), vocabulary), ""))
                        .alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    hits = materialise(hits, "frequencies")
    total = hits.where("term = ''").select(F.col("n").alias("total"))
    every = files.sparkSession.createDataFrame([("",), *[(t,) for t in _vocabulary()]], "term string").join(
        hits.where("term <> ''"), "term", "left")
    return every.join(F.broadcast(total.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total")))).select(
        "term", (F.log((1 + F.col("total")) / (1 + F.coalesce("n", F.lit(0)))) + 1).alias("idf"))


def templates(spark: SparkSession, idf: DataFrame) -> DataFrame:
    """(term, template, license, weight): unit vectors; a fixed number of rows."""
    rows = [(t, i, name, 1 + c) for i, (name, text) in enumerate(TEMPLATES) for t, c in _log_counts(text)]
    raw = spark.createDataFrame(rows, "term string, template int, license string, tf double").join(idf, "term").withColumn(
        "weight", F.col("tf") * F.col("idf"))
    norm = raw.groupBy("template").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("norm"))
    return raw.join(norm, "template").select("term", "template", "license", (F.col("weight") / F.col("norm")).alias("weight"))


def _log_counts(text: str) -> list[tuple[str, float]]:
    import math
    return [(t, math.log(c)) for t, c in sorted(Counter(_terms(text)).items())]


def _blocks(text: Column) -> Column:
    """Paragraphs, comment paragraphs and whole runs of comment lines that hold a cue, each on one line without comment marks."""
    comments = F.regexp_replace(text, NO_COMMENT, "")
    found = F.concat(F.split(text, BETWEEN, -1), F.split(comments, BETWEEN, -1), F.split(comments, APART, -1))
    flat = F.transform(F.filter(found, lambda x: x.rlike(CUE)), lambda x: F.trim(F.regexp_replace(F.concat(F.lit("\n"), x), WRAP, " ")))
    return F.array_distinct(flat)


def passages(files: DataFrame) -> DataFrame:
    """(row, passage): what may state a licence in each whole text; equal passages of a file once."""
    named = files.where(F.col("text").rlike(CUE)).select("row", "text", "name")
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(CUE))
    cut = named.select("row", "text", "name", lines.alias("lines"), _blocks(F.col("text")).alias("blocks"))
    sentences = F.flatten(F.transform("lines", lambda x: F.filter(F.split(x, SENTENCE, -1), lambda s: s.rlike(CUE))))
    whole = F.when(F.col("name").rlike(LICENCE_FILE), F.array("text")).otherwise(F.array().cast("array<string>"))
    return cut.select("row", F.explode(F.array_distinct(F.concat(
        "lines", sentences, F.array(F.array_join("lines", "\n")), "blocks", whole))).alias("passage"))


def own_licences(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(row, license, score): the best template of the best passage, where its cosine is at least ``threshold``."""
    spark = files.sparkSession
    idf = materialise(inverse_frequencies(files), "idf")
    wanted = materialise(templates(spark, idf), "templates")
    unseen = idf.where("term = ''").select(F.col("idf").alias("unseen"))
    # a passage is scored once, however many files hold it
    found = materialise(passages(files), "passages")
    counts = found.select("passage").distinct().select("passage", F.explode(terms(F.col("passage"))).alias("term")).groupBy(
        F.xxhash64("passage").alias("p"), "term").agg((1 + F.log(F.count("*"))).alias("tf"))
    counts = counts.join(F.broadcast(idf), "term", "left").join(F.broadcast(unseen)).withColumn(
        "weight", F.col("tf") * F.coalesce("idf", "unseen"))
    counts = materialise(counts.select("p", "term", "weight"), "weights")
    norms = counts.groupBy("p").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("norm"))
    dots = counts.join(F.broadcast(wanted.withColumnRenamed("weight", "w")), "term").groupBy("p", "template", "license").agg(
        F.sum(F.col("weight") * F.col("w")).alias("dot"))
    scored = dots.join(norms, "p").select("p", "license", F.round(F.col("dot") / F.col("norm"), 9).alias("score")).where(
        F.col("score") >= threshold)
    best = lambda: F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("best")
    per_passage = materialise(scored.groupBy("p").agg(best()).select(
        F.col("p").alias("of"), F.col("best.license").alias("license"), (-F.col("best.s")).alias("score")), "scored")
    return found.select("row", F.xxhash64("passage").alias("p")).join(per_passage, F.col("p") == F.col("of")) \
        .groupBy("row").agg(best()).select("row", F.col("best.license").alias("license"), (-F.col("best.s")).alias("score"))


def scan(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``files`` rows in a struct ``_row``, with own_license, own_score, license, inherited_from and distance.

    ``files`` has path and text.  A file's own licence comes first; else the
    licence of the nearest directory at or above its own that holds a
    recognised licence file (of several in one directory the one with the
    highest score, then the first name); else null.  Null and empty texts have no
    licence of their own; a null path has no directory and inherits nothing;
    repeated rows get the same result; equal scores go to the first licence by
    name.  distance is 0 for the file's own directory.
    """
    own_row = F.struct(*[F.col(f"`{c}`") for c in files.columns]).alias("_row")
    folder = F.coalesce(F.regexp_extract("path", "^(.*)/[^/]*$", 1), F.lit(""))
    base = files.select(own_row, "path", F.col("text"), F.xxhash64("path", "text").alias("row"),
                        F.when(F.col("path").isNotNull(), folder).alias("folder"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"))
    narrow = materialise(base.select("row", "path", "folder", "name").distinct(), "paths")
    own = materialise(own_licences(base.select("row", "text", "name"), threshold), "own").select(
        F.col("row").alias("of"), F.col("license").alias("own_license"), F.col("score").alias("own_score"))
    placed = narrow.join(own, F.col("row") == F.col("of"), "left").drop("of")
    placed = materialise(placed, "placed")
    stated = materialise(placed.where(F.col("own_license").isNotNull() & F.col("name").rlike(LICENCE_FILE) & F.col("folder").isNotNull())
                         .groupBy(F.col("folder").alias("at")).agg(F.min(F.struct((-F.col("own_score")).alias("s"), "path", "own_license"))
                                                                   .alias("best")).select("at", F.col("best.own_license").alias("granted")), "stated")
    parts = F.when(F.col("folder") == "", F.array().cast("array<string>")).otherwise(F.split("folder", "/", -1))
    above = placed.where("folder is not null").select("folder").distinct().select("folder", parts.alias("parts")).select(
        "folder", F.explode(F.transform(F.sequence(F.lit(0), F.size("parts")), lambda d: F.struct(
            d.alias("distance"), F.array_join(F.slice("parts", F.lit(1), F.size("parts") - d), "/").alias("above")))).alias("a")).select("folder", "a.*")
    nearest = materialise(materialise(above, "above").join(stated, F.col("above") == F.col("at")).groupBy(F.col("folder").alias("in")).agg(
        F.min(F.struct("distance", F.col("above").alias("from"), "granted")).alias("n")), "nearest")
    resolved = placed.join(nearest, F.col("folder") == F.col("in"), "left").select(
        F.col("row").alias("of"), "own_license", "own_score", F.coalesce("own_license", "n.granted").alias("license"),
        F.when(F.col("own_license").isNull(), F.col("n.from")).alias("inherited_from"),
        F.when(F.col("own_license").isNull(), F.col("n.distance")).alias("distance"))
    resolved = materialise(resolved, "resolved")
    return base.select("_row", "row").join(resolved, F.col("row") == F.col("of")).drop("row", "of")


def document_files(docs: DataFrame) -> DataFrame:
    """Stand-in repository tree: each document is a file at source/lang/hundred; its first document is the licence file."""
    name = F.when(F.col("doc_id") % 100 == 0, F.lit("LICENSE")).otherwise(F.concat(F.lit("doc"), F.col("doc_id"), F.lit(".txt")))
    top = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")))
    path = F.when(F.col("doc_id") % 1000 == 1, F.concat(top, F.lit("/LICENSE."), F.col("doc_id"))).otherwise(
        F.concat_ws("/", top, F.floor(F.col("doc_id") / 100).cast("string"), name))
    return docs.select("doc_id", path.alias("path"), "text")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all ``documents``, laid out as files of a repository tree."""
    files = document_files(documents(spark, sf_dir))
    return scan(files.select("path", "text", "doc_id")).select(
        "_row.doc_id", "_row.path", "own_license", "own_score", "license", "inherited_from", "distance")
