"""License scans with DataFrame functions only.

Templates are sets of shingles of SHINGLE words. Texts that could hold a template
are told by a word that every match must have. Over their shingles run overlapping
windows, of a size for each size of template; each window's MinHash bands, of
several minima for all but the smallest templates, are looked up among the bands of
the templates. A window can share a minimum with a template only if it holds the
very shingle that is the template's minimum, so bands are made for the windows that
hold one; no other could collide. Exact containment of a template's
shingles in a stretch of the window verifies a match and places it.

A text is gone through in segments of bounded length that overlap by a window, and
what is verified is a window, so a text of any length takes time in proportion.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Wordings of public licence notices.
TEMPLATES = {
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "MIT line": "Released under the MIT License.",
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0 line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0 line": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "BSL-1.0 line": "Distributed under the Boost Software License, Version 1.0.",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MIT disclaimer": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "ISC permission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Zlib notice": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "GPL notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0 notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "EPL-2.0 notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
}
SHINGLE, CONTAINMENT = 5, 0.8
#: A template in a text, as far as it must be contained, lies within a stretch of its own size times this, and its windows miss it with at most MISS.
SLACK, MISS = 1.25, 1e-5
#: Shingles of a template from which on a band has two minima; a template smaller than this would need too many bands of two.
TWO_MINIMA = 8
#: Shingles of a text's segment.
SEGMENT = 4_096
LONG = 6
SEPARATORS = "[ \\t\\n\\x0B\\f\\r]+"


def once(name: str, value: Column) -> Column:
    """value as a column that is computed once a row: a generator, unlike a projection, is not written into what uses it."""
    return F.explode(F.array(value)).alias(name)


def words_of(text: Column) -> Column:
    """Lower-cased words without what stands around letters and digits; words of neither are dropped."""
    bare = F.regexp_replace(F.lower(text), r"(?<![\p{L}\p{N}])[^\p{L}\p{N}\s]+|[^\p{L}\p{N}\s]+(?![\p{L}\p{N}])", " ")
    return F.filter(F.split(bare, SEPARATORS), lambda w: w != "")


def shingles_of(words: Column) -> Column:
    """Hashes of SHINGLE words in a row; of fewer words, of all of them."""
    last = F.greatest(F.size(words) - SHINGLE + 1, F.lit(1))
    made = F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.array_join(F.slice(words, i, SHINGLE), " ")))
    return F.when(F.size(words) > 0, made).otherwise(F.array().cast("array<bigint>"))


def template_table(templates: DataFrame) -> DataFrame:
    """(license, shingles, m) of (license, text) rows; templates without words are left out."""
    t = templates.select("license", once("words", words_of(F.col("text")))).select("license", F.array_distinct(shingles_of(F.col("words"))).alias("shingles"))
    return t.select("license", "shingles", F.size("shingles").alias("m")).where("m > 0")


def span_of(m: int) -> int:
    return math.ceil(m * SLACK)


def bands_for(m: int) -> tuple[int, int, int, int]:
    """(window, stride, bands, minima of a band) for templates of m shingles.

    The last window that starts at or before a match covers its whole stretch, so it
    holds CONTAINMENT * m of the template's shingles among window + m in all; that
    similarity is the probability of equal minima, and so many bands are taken that
    none is equal with a probability of at most MISS.
    """
    stride = max(1, m // 8)
    window = span_of(m) + stride
    inside = math.ceil(CONTAINMENT * m)
    similarity = min(0.99, inside / (window + m - inside))
    rows = 2 if m >= TWO_MINIMA else 1
    return window, stride, math.ceil(math.log(MISS) / math.log(1 - similarity**rows)), rows


def hashed_by_seed(shingles: Column, seeds: int) -> Column:
    """For each seed the shingles' hashes, an array of arrays."""
    return F.transform(F.sequence(F.lit(0), F.lit(seeds - 1)), lambda s: F.transform(shingles, lambda h: F.xxhash64(h, s)))


def band_keys(hashed: Column, m: int, start: Column, length: Column | int) -> Column:
    """The band keys of the shingles from start (from 1) on."""
    _, _, bands, rows = bands_for(m)
    least = lambda s: F.array_min(F.slice(hashed[s], start, length))
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.xxhash64(b, *[least(b * rows + r) for r in range(rows)]))


def minimum_shingles(shingles: Column, m: int) -> Column:
    """The shingles of a template of m that are its minima."""
    _, _, bands, rows = bands_for(m)
    return F.transform(F.sequence(F.lit(0), F.lit(bands * rows - 1)), lambda s: F.array_min(F.transform(shingles, lambda h: F.struct(F.xxhash64(h, s).alias("x"), h.alias("h"))))["h"])


def windows_with(m: int, known: list[int], minima: list[int]) -> Column:
    """The windows of a segment that share a band with a template of m shingles: (m, start, key) each."""
    window, stride, _, _ = bands_for(m)
    held, keys = F.array(*map(F.lit, minima)), F.array(*map(F.lit, known))
    places = F.filter(F.transform("part", lambda h, i: F.when(F.array_contains(held, h), i + 1)), lambda p: p.isNotNull())
    # Windows start at 1, 1 + stride, ... within the segment.
    first = lambda p: F.greatest(F.ceil((p - window) / stride).cast("int"), F.lit(0)) * stride + 1
    last = lambda p: F.floor((F.least(p, F.lit(SEGMENT)) - 1) / stride).cast("int") * stride + 1
    starts = F.array_distinct(F.flatten(F.transform(places, lambda p: F.when(first(p) <= last(p), F.sequence(first(p), last(p), F.lit(stride))).otherwise(F.array().cast("array<int>")))))
    return F.flatten(F.transform(starts, lambda i: F.transform(F.array_intersect(band_keys(F.col("hashed"), m, i, window), keys), lambda key: F.struct(F.lit(m).alias("m"), i.alias("start"), key.alias("key")))))


def scan(docs: DataFrame, templates: DataFrame | dict[str, str] | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, license, n_template, n_found, containment, first_word) of each template in each text.

    A template is in a text if a stretch of SLACK times its size holds CONTAINMENT
    of its distinct shingles; n_found is the most that one stretch holds,
    first_word (from 0, of the words compared) where the first such stretch
    starts. Null and empty texts hold none, as does an empty table; rows that
    repeat an id are one; rows with a null id are one; other columns are not looked
    at. templates: a bounded set, whose shingles and bands become part of the plan.
    """
    spark = docs.sparkSession
    if templates is None or isinstance(templates, dict):
        templates = spark.createDataFrame(list((TEMPLATES if templates is None else templates).items()), "license string, text string")
    held = [(r["license"], list(r["shingles"]), r["m"], list(r["words"])) for r in template_table(templates).join(templates.select("license", words_of(F.col("text")).alias("words")), "license").collect()]
    out = "doc_id, license, n_template, n_found, containment, first_word".split(", ")
    if not held:
        return docs.select(F.col(id_col).alias("doc_id"), F.lit("").alias("license"), *[F.lit(0).alias(c) for c in out[2:4]], F.lit(0.0).alias("containment"), F.lit(0).alias("first_word")).where("false")
    # Words such that a text without any of them lacks too many shingles of every template.
    must = sorted({w for _, _, _, words in held for w in needed(words)})
    sizes = sorted({x[2] for x in held})
    overlap = max(bands_for(m)[0] + span_of(m) for m in sizes)
    seeds = max(bands_for(m)[2] * bands_for(m)[3] for m in sizes)
    # The templates' own bands.
    known = spark.createDataFrame([x[:3] for x in held], "license string, wanted array<long>, m int")
    mine, minima = F.array().cast("array<bigint>"), F.array().cast("array<bigint>")
    for m in sizes:
        mine = F.when(F.col("m") == m, band_keys(F.col("hashed"), m, F.lit(1), F.size("wanted"))).otherwise(mine)
        minima = F.when(F.col("m") == m, minimum_shingles(F.col("wanted"), m)).otherwise(minima)
    minima_of: dict[int, set[int]] = {}
    for r in known.select("m", F.array_distinct(minima).alias("minima")).collect():
        minima_of.setdefault(r["m"], set()).update(r["minima"])
    bands = known.select("license", "wanted", "m", once("hashed", hashed_by_seed(F.col("wanted"), seeds))).select("license", "wanted", "m", F.explode(mine).alias("key"))
    bands = spark.createDataFrame(bands.collect(), bands.schema)  # as many rows as the templates have bands
    keys_of: dict[int, list[int]] = {}
    for r in bands.select("m", "key").distinct().collect():
        keys_of.setdefault(r["m"], []).append(r["key"])

    rows = docs.select(F.col(id_col).alias("doc_id"), once("_text", F.lower(F.col(text).cast("string"))))
    likely = rows.where(reduce(lambda a, b: a | b, [F.col("_text").contains(w) for w in must]))
    shingled = likely.select("doc_id", once("words", words_of(F.col("_text")))).select("doc_id", once("shingles", shingles_of(F.col("words")))).where(F.size("shingles") > 0)
    # Each segment with as much behind it as a window and a stretch may reach.
    cut = shingled.select("doc_id", "shingles", F.explode(F.sequence(F.lit(0), F.size("shingles") - 1, F.lit(SEGMENT))).alias("base"))
    parts = cut.select("doc_id", "base", once("part", F.slice("shingles", F.col("base") + 1, SEGMENT + overlap)))
    every = F.array(*map(F.lit, sorted(set().union(*minima_of.values()))))
    parts = parts.where(F.size(F.array_intersect("part", every)) > 0)
    hashed = parts.select("doc_id", "base", "part", once("hashed", hashed_by_seed(F.col("part"), seeds)))
    retrieved = hashed.select("doc_id", "base", "part", F.explode(F.concat(*[windows_with(m, sorted(keys_of[m]), sorted(minima_of[m])) for m in sizes])).alias("hit"))
    seen = retrieved.select("doc_id", "base", "hit.*", once("near", F.slice("part", F.col("hit.start"), F.ceil(F.col("hit.m") * SLACK).cast("int") * 2 + F.floor(F.col("hit.m") / 8).cast("int") + 1)))
    found = seen.join(F.broadcast(bands), ["m", "key"]).dropDuplicates(["doc_id", "license", "base", "start", "near"])
    span = F.ceil(F.col("m") * SLACK).cast("int")
    places = F.filter(F.transform("near", lambda h, i: F.struct(i.alias("at"), h.alias("h"))), lambda x: F.array_contains("wanted", x["h"]))
    placed = found.select("doc_id", "license", "m", (F.col("base") + F.col("start") - 1).alias("offset"), once("places", places))
    counts = F.transform("places", lambda p: F.struct(F.size(F.array_distinct(F.transform(F.filter("places", lambda q: (q["at"] >= p["at"]) & (q["at"] < p["at"] + span)), lambda q: q["h"]))).alias("n"), (-p["at"] - F.col("offset")).alias("back")))
    best = placed.select("doc_id", "license", "m", F.array_max(counts).alias("best"))
    kept = best.where(F.col("best.n") >= CONTAINMENT * F.col("m"))
    return kept.groupBy("doc_id", "license").agg(F.max("m").alias("n_template"), F.max("best").alias("best")).select("doc_id", "license", "n_template", F.col("best.n").alias("n_found"), (F.col("best.n") / F.col("n_template")).alias("containment"), (-F.col("best.back")).cast("int").alias("first_word"))


def needed(words: list[str]) -> set[str]:
    """Words that touch so many of a template's shingles that a match holds at least one of them."""
    shingles = [words[i : i + SHINGLE] for i in range(max(1, len(words) - SHINGLE + 1))]
    left, out = list(range(len(shingles))), set()
    spared = len(shingles) - math.ceil(CONTAINMENT * len(shingles))  # so many a match may lack
    while len(left) > 0 and len(shingles) - len(left) <= spared:
        every = [w for i in left for w in set(shingles[i])]
        every = [w for w in every if len(w) >= LONG] or every  # short words are common in all texts
        pick = max(sorted(set(every)), key=lambda w: (every.count(w), len(w)))
        out.add(pick)
        left = [i for i in left if pick not in shingles[i]]
    return out
