"""License scans: MinHash bands over overlapping text windows retrieve templates, whole shingles verify them.

A text is its words in lower case (letters and digits of ASCII, and all that is not ASCII); shingles are five consecutive
words. It is first cut into chunks of `CHUNK` words that overlap by `OVERLAP`, more than twice the longest template, so
memory is bounded by a chunk and whatever stands around a template is whole in one of them. Templates fall into classes by
their number of shingles, and each class has windows of a size and a step of its own; a template longer than the last
class is retrieved by overlapping parts of it. A window's signature has one minimum for each of `BANDS` hash functions and
every band is one row, so a window with Jaccard similarity j to a template or a part is retrieved with probability
1 - (1 - j)^BANDS: over 0.999 from j = 0.45 on and over 0.99 from j = 0.33 on, which the best window for a text with 0.8
of a template's shingles reaches in every class; the one-shingle windows of the shortest templates miss nothing.

A window's minimum can be a template's only where the text holds the very shingle that gives it. Chunks without any
such shingle, nearly all, thus need no signatures; this drops nothing that a band would retrieve.

A retrieved template is verified in its chunk, once however many windows retrieved it: the share of its distinct shingles
that occur there, compared as word sequences, must reach `CONTAINMENT`.

Everything runs in DataFrame expressions within one scan; templates are literals of fixed size and only their finds are
grouped, by document.

Defined cases: null counts as empty; texts shorter than a shingle match nothing; a template counts once for each document
however often it occurs, with its best chunk's share; repeated rows with one doc_id and text count as one document; a null
doc_id is a document like any other; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHINGLE = 5
CONTAINMENT = 0.8
BANDS = 12
#: (most shingles of a template, shingles of a window, step).
CLASSES = ((2, 1, 1), (12, 8, 4), (28, 24, 8), (80, 64, 16))
#: Shingles from one part of a long template to the next; parts are as long as the last class allows.
PART_STEP = 40
#: Words of a chunk beyond what it shares with the one before, and the least of what it shares.
CHUNK, OVERLAP = 4096, 512

# Public license statements and notices, each under its SPDX name.
TEMPLATES = {
    "Apache-2.0/line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0/notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "BSD-3-Clause/notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "CC-BY-4.0/line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0/line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0/line": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0/line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0/notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD-3-Clause/text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "MIT/line": "Released under the MIT License.",
    "ISC/text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "MIT/notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
    "MIT/text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MPL-2.0/notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}

_NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def template_words(text: str) -> list[str]:
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower) if w]


def template_shingles(text: str) -> list[str]:
    """The distinct shingles of a template, in order."""
    w = template_words(text)
    return list(dict.fromkeys(" ".join(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)))


def seed(band: int) -> int:
    """A band's hash function is XOR with this mask: the minimum is the shingle hash nearest to it."""
    return int.from_bytes(hashlib.blake2b(f"band {band}".encode(), digest_size=8).digest(), "big", signed=True)


def parts(n: int) -> list[tuple[int, int, int]]:
    """(class, first shingle, end) of the parts by which a template of n shingles is retrieved: one, unless it is long."""
    for k, (most, _, _) in enumerate(CLASSES):
        if n <= most:
            return [(k, 0, n)]
    most = CLASSES[-1][0]
    return [(len(CLASSES) - 1, a, a + most) for a in (*range(0, n - most, PART_STEP), n - most)]


def shingle_hashes(words: Column) -> Column:
    """xxHash64 of each shingle of a word array."""
    at = lambda i, k: F.get(words, i + k)
    each = F.transform(F.sequence(F.lit(0), F.size(words) - SHINGLE), lambda i: F.xxhash64(*[at(i, k) for k in range(SHINGLE)]))
    return F.when(F.size(words) >= SHINGLE, each).otherwise(F.array().cast("array<long>"))


def _template_rows(spark: SparkSession, templates: dict[str, str]) -> list[tuple[str, list[str], list[int]]]:
    """(template, shingles, hashes), hashed by the same expression as the texts."""
    rows = [(name, template_words(text)) for name, text in sorted(templates.items())]
    made = spark.createDataFrame(rows, "template string, words array<string>").select("template", F.array_distinct(shingle_hashes(F.col("words"))).alias("h"))
    hashes = {r["template"]: r["h"] for r in made.collect()}
    return [(name, template_shingles(templates[name]), hashes[name]) for name, _ in rows]


def _retrieved(hashes: Column, window: int, step: int, seeds: list[int], minima: list[int]) -> Column:
    """Which of the templates' `minima` are the minimum of some window of `hashes`."""
    wanted = _longs(minima)

    def signature(i: Column) -> Column:
        here = F.slice(hashes, i + 1, window)
        return F.transform(F.array(here), lambda w: F.transform(_longs(seeds), lambda s: F.array_min(F.transform(w, lambda h: h.bitwiseXOR(s)))))

    each = F.transform(F.sequence(F.lit(0), F.size(hashes) - 1, F.lit(step)), lambda i: F.array_intersect(F.get(signature(i), 0), wanted))
    return F.array_distinct(F.flatten(each))


def _chunks(words: Column, overlap: int) -> Column:
    """The chunks of a word array: each goes on where the one before ended, less the overlap."""
    starts = lambda w: F.sequence(F.lit(0), F.greatest(F.size(w) - overlap - 1, F.lit(0)), F.lit(CHUNK))
    return F.flatten(F.transform(F.array(words), lambda w: F.transform(starts(w), lambda i: F.slice(w, i + 1, CHUNK + overlap))))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """(doc_id, template, containment) of every document that holds a template."""
    spark = docs.sparkSession
    known = [t for t in _template_rows(spark, templates) if t[1]]
    if not known:
        return docs.select("doc_id", F.lit("").alias("template"), F.lit(0.0).alias("containment")).limit(0)
    seeds = [seed(band) for band in range(BANDS)]
    # (class, template, its minimum of each band), a long template in several parts.
    bands = [(k, name, [min(_signed(h ^ s) for h in hashes[a:b]) for s in seeds]) for name, _, hashes in known for k, a, b in parts(len(hashes))]
    holders = sorted({_signed(m ^ s) for *_, minima in bands for m, s in zip(minima, seeds, strict=True)})
    overlap = max(OVERLAP, 2 * max(len(s) for _, s, _ in known) + SHINGLE)

    folded = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(folded, _NOT_WORD), lambda w: w != "")
    # One generated row holds both arrays, so no later expression computes them again.
    both = F.transform(_chunks(words, overlap), lambda w: F.struct(w.alias("words"), shingle_hashes(w).alias("hashes")))
    rows = docs.select("doc_id", F.explode(both).alias("both")).where(F.arrays_overlap("both.hashes", _longs(holders)))
    rows = rows.select("doc_id", F.col("both.words").alias("words"), F.col("both.hashes").alias("hashes"))

    # Retrieval: the minima of the windows of each class that are a template's.
    found = []
    for k, (_, window, step) in enumerate(CLASSES):
        mine = sorted({m for c, _, minima in bands if c == k for m in minima})
        if mine:
            found.append(_retrieved(F.col("hashes"), window, step, seeds, mine))
    hits = rows.select("doc_id", "words", F.flatten(F.array(*found)).alias("hits")).where(F.size("hits") > 0)

    # Verification: the chunk's shingles that are a template's, made once, then each retrieved template's share of them.
    every = F.array(*[F.lit(x) for x in sorted({x for _, shingles, _ in known for x in shingles})])
    around = F.transform(F.sequence(F.lit(0), F.size("words") - SHINGLE), lambda i: F.array_join(F.slice("words", i + 1, SHINGLE), " "))
    near = hits.select("doc_id", "hits", F.explode(F.array(F.array_intersect(around, every))).alias("around"))
    owners: dict[int, set[str]] = {}
    for _, name, minima in bands:
        for m in minima:
            owners.setdefault(m, set()).add(name)
    names = F.create_map(*[x for m in sorted(owners) for x in (F.lit(m).cast("long"), F.array(*[F.lit(n) for n in sorted(owners[m])]))])
    # At most one row for each chunk and template that share a minimum.
    near = near.select("doc_id", "around", F.explode(F.array_distinct(F.flatten(F.transform("hits", lambda h: F.element_at(names, h))))).alias("template"))
    table = spark.createDataFrame([(name, shingles) for name, shingles, _ in known], "template string, shingles array<string>")
    joined = near.join(F.broadcast(table), "template")
    share = F.size(F.array_intersect("around", "shingles")) / F.size("shingles")
    return joined.withColumn("containment", share).where(F.col("containment") >= CONTAINMENT).groupBy("doc_id", "template").agg(F.max("containment").alias("containment"))


def _longs(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


def _signed(x: int) -> int:
    x &= 2**64 - 1
    return x - 2**64 if x >= 2**63 else x


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: the license templates that each document holds, with the share of their shingles found."""
    return scan(common.table(spark, sf_dir, "documents"))
