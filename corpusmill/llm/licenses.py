"""License scans: MinHash bands over overlapping text windows, exact containment after.
DataFrame functions only.

Words are runs of letters and digits, lower-cased; shingles are five words (a template with
fewer words is one shingle). Templates of (L/2, L] words, L a power of two, form a class;
a class slides windows of 2 L words by L words, so that any stretch of L words lies inside
one window. A window is compared when it holds an anchor word of its class: words are chosen
so that the shingles without any of them are too few to reach the containment, so leaving
out the other windows loses no match.

Each window has at least ``BANDS`` = 64 min-hashes, each a band of one row. A band agrees with
the probability of the Jaccard similarity J of a match and its window, which is smallest for the
template of fewest shingles in a full window: 1/12 for a template of five words in 16. A class
has so many bands that none agrees with (1 - J)^bands <= ``MISS`` = 2e-5 (125 at 1/12). Bands are
joined with those of the templates (a broadcast of ``templates * bands`` rows); candidates are
verified by exact shingle containment, 0.8 or more.

Edge cases: null or empty texts match nothing; texts are scanned whole. Rows with the same
doc_id give one row per license (largest containment, then first window). Extra columns are
ignored; empty tables give empty results.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import materialize, table

SHINGLE, CONTAINMENT, BANDS = 5, 0.8, 64
#: Bound of the probability that no band of a match agrees.
MISS = 2e-5

# License notices as their publishers word them.
TEMPLATES = [
    ("all-rights-reserved", "All rights reserved."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0-header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
     "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
     "required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" "
     "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("bsd-redistribution", "Redistribution and use in source and binary forms, with or without modification, are permitted "
     "provided that the following conditions are met:"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
     "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
     "any later version."),
    ("mit", "Released under the MIT License."),
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
     "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def _shingles(words: list[str], size: int) -> list[str]:
    return [" ".join(words[k:k + size]) for k in range(len(words) - size + 1)]


def anchors(words: list[str], containment: float = CONTAINMENT) -> list[str]:
    """Words such that the shingles without any of them are fewer than a match needs."""
    grams = set(_shingles(words, min(SHINGLE, len(words))))
    chosen: list[str] = []
    left = [set(g.split()) for g in grams]
    while len(left) >= containment * len(grams):
        count = Counter(w for g in left for w in g)
        # long words are rare ones; of equally long ones, the one in more shingles
        chosen.append(max(count, key=lambda w: (len(w) if count[w] * 4 >= len(left) else 0, count[w], w)))
        left = [g for g in left if chosen[-1] not in g]
    return chosen


def _classes(templates) -> dict[tuple[int, int], list[tuple]]:
    """Templates by (shingle size, class length)."""
    out: dict[tuple[int, int], list[tuple]] = {}
    for name, text in templates:
        words = words_of(text)
        if words:
            out.setdefault((min(SHINGLE, len(words)), 1 << (len(words) - 1).bit_length()), []).append((name, words))
    return out


def bands_of(size: int, length: int, own: list[tuple], containment: float = CONTAINMENT) -> int:
    """The bands of a class: enough for its template of the smallest similarity to a full window."""
    least, window = 1.0, 2 * length - size + 1
    for _, words in own:
        grams = len(set(_shingles(words, size)))
        shared = max(1, math.ceil(containment * grams - 1e-9))
        least = min(least, shared / (window + grams - shared))
    return BANDS if least == 1 else max(BANDS, math.ceil(math.log(MISS) / math.log(1 - least)))


def _bands(hashes: Column, bands: int) -> Column:
    low = lambda seed: F.array_min(F.transform(hashes, lambda x: F.xxhash64(F.lit(seed), x)))
    return F.array(*map(low, range(bands)))


def _template_bands(spark: SparkSession, templates, bands: int) -> DataFrame:
    """With the bands of the class of most bands; the windows of a class may have fewer."""
    rows = [(size, length, name, _shingles(words, size)) for (size, length), own in _classes(templates).items() for name, words in own]
    t = spark.createDataFrame(rows, "size int, length int, license_id string, grams array<string>")
    t = t.withColumn("template", F.array_distinct(F.transform("grams", lambda g: F.xxhash64(g))))
    return t.select("size", "length", "license_id", "template", F.posexplode(_bands(F.col("template"), bands)).alias("band", "value"))


def _windows(words: DataFrame, size: int, length: int, anchor: list[str]) -> DataFrame:
    """``(doc_id, size, length, start, held)`` of the class's windows with an anchor word."""
    span = 2 * length
    starts = F.transform(F.filter(F.sequence(F.lit(0), F.floor((F.size("words") - 1) / length).cast("int")),
                                  lambda k: F.arrays_overlap(F.slice("words", k * length + 1, span), F.array(*map(F.lit, anchor)))),
                         lambda k: k * length)
    own = words.where(F.arrays_overlap("words", F.array(*map(F.lit, anchor)))).select("doc_id", "words", F.explode(starts).alias("start"))
    held = F.slice("words", F.col("start") + 1, span)
    own = own.withColumn("held", held).where(F.size("held") >= size)
    gram = lambda k: F.xxhash64(F.array_join(F.slice("held", k, size), " "))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("held") - size + 1), gram))
    return own.select("doc_id", F.lit(size).alias("size"), F.lit(length).alias("length"), "start", grams.alias("held"))


def scan(docs: DataFrame, templates=tuple(TEMPLATES), containment: float = CONTAINMENT) -> DataFrame:
    """``(doc_id, license_id, containment, start)`` for ``docs (doc_id, text)``: ``start`` is the
    first word of the first window with the largest containment."""
    number = {key: bands_of(*key, own, containment) for key, own in _classes(templates).items()}
    bands = F.broadcast(_template_bands(docs.sparkSession, templates, max(number.values())))  # templates * bands rows
    by = {key: sorted({a for _, w in own for a in anchors(w, containment)}) for key, own in _classes(templates).items()}
    any_anchor = "|".join(sorted({a for own in by.values() for a in own}))
    text = docs.where(F.col("text").rlike(rf"(?iu)(?<![\p{{L}}\p{{N}}])(?:{any_anchor})(?![\p{{L}}\p{{N}}])")) \
        .select("doc_id", F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " ")).alias("clean"))
    # the few texts with an anchor word, written once: the classes do not scan the corpus again
    words = materialize(text.select("doc_id", F.split("clean", " ").alias("words")), "license-words")
    found = None
    for (size, length), anchor in by.items():
        w = _windows(words, size, length, anchor)
        banded = w.select("*", F.posexplode(_bands(F.col("held"), number[size, length])).alias("band", "value"))
        hit = banded.join(bands, ["size", "length", "band", "value"])
        found = hit if found is None else found.unionByName(hit)
    share = F.size(F.array_intersect("held", "template")) / F.size("template")
    sure = found.select("doc_id", "license_id", share.alias("containment"), "start").where(F.col("containment") >= containment)
    best = sure.groupBy("doc_id", "license_id").agg(F.max(F.struct("containment", -F.col("start"))).alias("m"))
    return best.select("doc_id", "license_id", F.col("m.containment").alias("containment"),
                       (-F.col("m.col2")).cast("bigint").alias("start"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).withColumn("containment", F.round("containment", 6))


def sql(view: str = "documents") -> str:
    """The same in DuckDB: every shingle of every text against every template shingle."""
    rows = ", ".join(f"({size}, {length}, '{name}', '{g}')" for (size, length), own in _classes(TEMPLATES).items()
                     for name, words in own for g in dict.fromkeys(_shingles(words, size)))
    return rf"""
    WITH t(size, length, license_id, gram) AS (VALUES {rows}),
    m AS (SELECT license_id, count(*) AS m FROM t GROUP BY license_id),
    l AS (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS ws FROM {view} WHERE text IS NOT NULL),
    g AS (SELECT doc_id, k AS pos, size, array_to_string(ws[k + 1:k + size], ' ') AS gram FROM (
            SELECT doc_id, ws, size, unnest(range(len(ws) - size + 1)) AS k FROM l, (SELECT DISTINCT size FROM t))),
    h AS (SELECT g.doc_id, t.license_id, t.length, g.pos, g.gram, g.size FROM g JOIN t ON g.size = t.size AND g.gram = t.gram),
    w AS (SELECT doc_id, license_id, (pos // length) * length AS start, gram FROM h UNION ALL
          SELECT doc_id, license_id, (pos // length - 1) * length, gram FROM h
          WHERE pos >= length AND pos - (pos // length - 1) * length + size <= 2 * length),
    c AS (SELECT w.doc_id, w.license_id, w.start, count(DISTINCT w.gram) / any_value(m.m) AS containment
          FROM w JOIN m ON w.license_id = m.license_id GROUP BY w.doc_id, w.license_id, w.start)
    SELECT doc_id, license_id, round(max(containment), 6) AS containment, arg_max(start, (containment, -start))::BIGINT AS start
    FROM c WHERE containment >= {CONTAINMENT} GROUP BY doc_id, license_id
    """
