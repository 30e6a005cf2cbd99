"""License scans: MinHash bands over overlapping text windows retrieve templates, exact containment verifies them.

DataFrame expressions only. A document's words are cut into windows of ``WINDOW`` words, one every ``STRIDE``; a
window's signature has ``BANDS`` coordinates, each a band of its own, over its two-word shingles. A window whose
band key equals a template's is a candidate, and the template's shingles are then looked for around the window.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.llm.storage import store

# Notices and opening passages of public licenses.
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License",
        "Licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "GPL-3.0": [
        "licensed under the GNU General Public License, version 3",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ],
    "GPL-2.0": [
        "licensed under the GNU General Public License, version 2",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    ],
    "LGPL": ["licensed under the GNU Lesser General Public License"],
    "AGPL-3.0": ["licensed under the GNU Affero General Public License, version 3"],
    "BSD": [
        "Licensed under the BSD License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "Unlicense": ["This is free and unencumbered software released into the public domain"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0"],
    "CC0-1.0": ["Licensed under CC0 1.0"],
}

#: A notice of four shingles fills at least 4 of the 11 of a window that holds it, so its 32 one-row bands all miss
#: with probability (1 - 4/11)**32 = 5e-7, and a notice of up to 9 words lies whole in some window.
WINDOW, STRIDE, BANDS = 12, 4, 32
CONTAINMENT = 0.8


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingle_hashes(tokens: Column) -> Column:
    """Hashes of neighbouring words, in order: one fewer than there are words."""
    n = F.size(tokens)
    return F.when(n < 2, F.array().cast("array<bigint>")).otherwise(F.zip_with(F.slice(tokens, 1, n - 1), F.slice(tokens, 2, n - 1), lambda a, b: F.xxhash64(a, b)))


def _keys(hashes: Column) -> Column:
    """The band keys of one window: each coordinate's minimum, hashed with its number."""
    return F.transform(F.array(*map(F.lit, range(BANDS))), lambda k: F.xxhash64(k, F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, k)))))


def template_chunks(spark: SparkSession, templates: dict[str, list[str]]) -> DataFrame:
    """``license, notice, chunk, tokens, keys, n``: each notice in chunks of at most ``WINDOW`` words."""
    rows = F.explode(F.array(*(F.struct(F.lit(name).alias("license"), F.lit(i).alias("notice"), F.lit(text).alias("text")) for name, texts in templates.items() for i, text in enumerate(texts))))
    notices = spark.range(1).select(rows.alias("t")).select("t.license", "t.notice", words(F.col("t.text")).alias("tokens"))
    # one word is shared between chunks, so that no shingle is lost; a last chunk of a word alone isn't one
    step = WINDOW - 1
    chunks = notices.select("license", "notice", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("tokens") - 2), F.lit(step))).alias("chunk"), "tokens")
    chunks = chunks.withColumn("tokens", F.slice("tokens", F.col("chunk") + 1, WINDOW))
    hashes = shingle_hashes(F.col("tokens"))
    return chunks.select("license", "notice", "chunk", "tokens", _keys(hashes).alias("keys"), hashes.alias("hashes"))


def _grams(tokens: Column) -> Column:
    """Distinct two-word shingles as text."""
    n = F.size(tokens)
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(F.zip_with(F.slice(tokens, 1, n - 1), F.slice(tokens, 2, n - 1), lambda a, b: F.concat(a, F.lit(" "), b))))


def _notices(chunks: DataFrame) -> list:
    """``license, notice, hashes, size`` of each notice: its distinct shingles, and their number summed over its chunks."""
    return chunks.groupBy("license", "notice").agg(F.array_distinct(F.flatten(F.collect_list("hashes"))).alias("hashes"), F.sum(F.size(F.array_distinct("hashes"))).alias("size")).collect()


def _needs(notices: list, containment: float) -> Column:
    """A literal array of ``struct(hashes, need)``: each notice's distinct shingles and how many of them it takes."""
    # a shingle in two chunks counts twice in the containment, once here
    need = lambda r: math.ceil(containment * r["size"] - 1e-9) - (r["size"] - len(r["hashes"]))
    return F.array(*(F.struct(F.lit(r["hashes"]).alias("hashes"), F.lit(need(r)).alias("need")) for r in notices))


def _families(spark: SparkSession, notices: list) -> DataFrame:
    """``license, notice, size, family``: notices that share half of one's shingles can be taken for each other."""
    family = list(range(len(notices)))
    for i, a in enumerate(notices):
        for j, b in enumerate(notices[:i]):
            if 2 * len(set(a["hashes"]) & set(b["hashes"])) >= min(len(a["hashes"]), len(b["hashes"])):
                family = [family[j] if f == family[i] else f for f in family]
    rows = (F.struct(F.lit(r["license"]).alias("license"), F.lit(r["notice"]).alias("notice"), F.lit(r["size"]).alias("size"), F.lit(f).alias("family")) for r, f in zip(notices, family, strict=True))
    return spark.range(1).select(F.explode(F.array(*rows)).alias("t")).select("t.*")


def scan_licenses(docs: DataFrame, *, templates: dict[str, list[str]] | None = None, containment: float = CONTAINMENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, license, containment, first_word, n_places``: each license whose notice a document holds.

    ``containment`` is the largest share, over the license's notices, of the notice's two-word shingles that the
    document has around the windows which retrieved it (each part of a long notice where it fits best); ``first_word``
    is the place of the first such window, ``n_places`` how many there are. Where notices of several licenses that can
    be taken for each other fit one window, the licenses of the notices that fit best around it count (ties: all): a
    notice fits by all its parts that lie in step there, and its own parts never compete. Null, empty and one-word
    texts hold none.
    A row for each row of ``docs`` and license: repeated rows of one id meet in one. Rows without an id are left out.
    Other columns are ignored; no rows in, none out.

    Documents that lack more of each notice's shingles than the containment allows, and windows that share no shingle
    with any template (their signatures can collide with none), are left out before signatures are made; neither
    drops a match. Templates are a parameter of bounded size (a few hundred shingles), so what is
    broadcast doesn't grow with the corpus. Documents aren't shuffled, only candidate windows are.
    """
    spark = docs.sparkSession
    chunks = store(template_chunks(spark, templates or TEMPLATES), "license-templates").frame
    all_hashes, all_keys = (F.lit(x) for x in chunks.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("hashes")))), F.array_sort(F.array_distinct(F.flatten(F.collect_list("keys"))))).first())
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # a document that lacks too many of every notice's shingles anywhere can't hold one around a window. The generator
    # keeps the optimizer from working out the shared shingles anew for each notice.
    shared = rows.select("id", "text", F.explode(F.array(F.array_intersect(shingle_hashes(words(F.col("text"))), all_hashes))).alias("shared"))
    notices = _notices(chunks)
    able = shared.where(F.exists(_needs(notices, containment), lambda n: F.size(F.array_intersect("shared", n["hashes"])) >= n["need"]))
    hashed = able.select("id", words(F.col("text")).alias("tokens")).withColumn("hashes", shingle_hashes(F.col("tokens")))
    hit = F.transform("hashes", lambda h: F.array_contains(all_hashes, h))
    hashed = hashed.withColumn("hit", hit)
    # a window's place is its first word; the last one begins where the text's last shingle is still inside
    starts = F.filter(F.sequence(F.lit(0), F.size("hashes") - 1, F.lit(STRIDE)), lambda i: F.array_contains(F.slice("hit", i + 1, WINDOW - 1), True))
    windows = hashed.select("id", F.explode(F.transform(starts, lambda i: F.struct(i.alias("start"), F.slice("hashes", i + 1, WINDOW - 1).alias("hashes"), F.slice("tokens", F.greatest(F.lit(1), i + 1 - WINDOW), F.lit(3 * WINDOW)).alias("around")))).alias("w"))
    keyed = windows.select("id", "w.start", "w.around", _keys(F.col("w.hashes")).alias("keys")).where(F.arrays_overlap("keys", all_keys))
    found = keyed.select("id", "start", "around", F.explode(F.array_distinct("keys")).alias("key"))
    known = chunks.join(F.broadcast(_families(spark, notices)), ["license", "notice"])
    known = F.broadcast(known.select("license", "notice", "chunk", "size", "family", _grams(F.col("tokens")).alias("grams"), F.explode(F.array_distinct("keys")).alias("key")))
    hits = F.size(F.array_intersect("grams", _grams(F.col("around"))))
    places = found.join(known, "key").groupBy("id", "start", "license", "notice", "chunk", "size", "family").agg(F.max(hits).alias("hits"))
    # each notice's containment in the document, over all its chunks
    notice = W.partitionBy("id", "license", "notice")
    part = W.partitionBy("id", "license", "notice", "chunk").orderBy(F.desc("hits"), "start")
    places = places.withColumn("best", F.when(F.row_number().over(part) == 1, F.col("hits")))
    places = places.withColumn("whole", F.sum("best").over(notice)).where(F.col("whole") / F.col("size") >= containment)
    # chunks whose places agree on where the notice begins make one occurrence
    near = notice.orderBy(F.col("start") - F.col("chunk")).rangeBetween(2 - 2 * WINDOW, 2 * WINDOW - 2)
    places = places.withColumn("near", F.collect_list(F.struct("chunk", "hits")).over(near))
    best_of = lambda c: F.array_max(F.transform(F.filter("near", lambda n: n["chunk"] == c), lambda n: n["hits"]))
    places = places.withColumn("near", F.transform(F.array_distinct("near.chunk"), lambda c: F.struct(c.alias("chunk"), best_of(c).alias("hits"))))
    places = places.withColumn("fit", F.aggregate("near.hits", F.lit(0), lambda a, h: a + h) / F.col("size"))
    # notices that differ by a version or a clause fit the same place: the license that fits it best stands there
    places = places.withColumn("own", F.max("fit").over(W.partitionBy("id", "start", "family", "license"))).withColumn("top", F.max("fit").over(W.partitionBy("id", "start", "family"))).where("own = top")
    best = places.select("id", "license", "notice", "size", "start", F.col("chunk").alias("at"), F.explode("near").alias("n")).groupBy("id", "license", "notice", "size", "n.chunk").agg(F.max("n.hits").alias("hits"), F.min("start").alias("first_word"), F.count_if(F.col("at") == F.col("n.chunk")).alias("n"))
    scored = best.groupBy("id", "license", "notice", "size").agg(F.sum("hits").alias("hits"), F.min("first_word").alias("first_word"), F.sum("n").alias("n"))
    scored = scored.withColumn("containment", F.col("hits") / F.col("size")).where(F.col("containment") >= containment)
    return scored.groupBy(F.col("id").alias(id_col), "license").agg(F.max("containment").alias("containment"), F.min("first_word").alias("first_word"), F.sum("n").alias("n_places"))
