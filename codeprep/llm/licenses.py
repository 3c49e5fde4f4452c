"""Operator 5: licence scans, in DataFrame operations alone.

Each text is normalised (lower case, everything but letters and digits one
space) and read as segments: its lines, its paragraphs, the whole, and runs of
words.  A segment is compared with the licence templates by the Dice
coefficient over distinct word bigrams, 2 |A & B| / (|A| + |B|); it matches a
template from ``THRESHOLD`` on.  As |A & B| is at most the smaller set, a match
has at least t / (2 - t) of the template's bigrams: a text with fewer of them
is left out before any segment is made (exact), which all but texts about
licences are.

Runs of words find notices of several paragraphs, or after other words of
their line, inside a longer text.  They are taken from what no matching line,
paragraph or whole text covers, begin and end on a bigram of the template
(trimming others never lowers the coefficient) and have (2 - t) / t times the
template's bigrams at most, repeats counted.

Null texts, empty texts and texts without a match have no licence.  Rows of
one id are one document; rows without id are left out.  A tie between
templates goes to the first name.  Empty tables give empty results; other
columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAME = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF
THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

#: Fixed values: (licence, text) of public licences and of the notices that refer to them.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("BSD-2-Clause", f"{_BSD_HEAD}\n\n{_BSD_TAIL}"),
    ("BSD-3-Clause", f"{_BSD_HEAD}\n\n{_BSD_NAME}\n\n{_BSD_TAIL}"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
                   "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
                   'law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES '
                   "OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
                   "limitations under the License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
                "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program "
                "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
                "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
                "with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
                  "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial "
                  "or non-commercial, and by any means."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
]


def bigrams(text: str) -> set[tuple[str, str]]:
    """A template's distinct word bigrams, normalised as the texts are."""
    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    return set(zip(words, words[1:]))


def _template_rows(templates: list[tuple[str, str]]) -> list[tuple[int, str, int, str, str]]:
    return [(i, name, len(b), x, y) for i, (name, text) in enumerate(templates) for b in [bigrams(text)] for x, y in sorted(b)]


def _words(segment: Column) -> Column:
    return F.filter(F.split(segment, " "), lambda w: w != "")


def _pairs(words: Column) -> Column:
    """Hashes of the word bigrams, in order."""
    # inside an array of one, so that the words are computed once
    return F.transform(F.array(words), lambda w: F.transform(
        F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1))))[0]


def _once(df: DataFrame, **made: Column) -> DataFrame:
    """``df`` with new columns that later expressions read and don't compute
    again: what a generator returns is not substituted into them."""
    value = F.struct(*[c.alias(name) for name, c in made.items()])
    return df.select("*", F.inline(F.array(value)))


def _dice(segment: Column, template: Column, m: Column) -> Column:
    both = F.size(F.array_intersect(segment, template))
    return F.round(2 * both / (F.size(F.array_distinct(segment)) + m), 6)


def matches(df: DataFrame, threshold: float = THRESHOLD, templates: list[tuple[str, str]] | None = None, key: str = "doc_id",
            text: str = "text") -> DataFrame:
    """id, template, licence and dice of each document's best segment for each
    template that some segment of it matches."""
    rows = _template_rows(templates or TEMPLATES)
    table = df.sparkSession.createDataFrame(rows, "template int, licence string, m int, x string, y string") \
        .groupBy("template", "licence", "m").agg(F.collect_set(F.xxhash64("x", "y")).alias("b")) \
        .withColumn("need", F.ceil(F.col("m") * threshold / (2 - threshold) - 1e-9).cast("int")) \
        .withColumn("most", F.floor(F.col("m") * (2 - threshold) / threshold + 1e-9).cast("int"))
    every = table.agg(F.collect_list(F.struct("template", "licence", "m", "need", "most", "b")).alias("ts")) \
        .withColumn("any", F.array_distinct(F.flatten(F.col("ts.b"))))
    # one space for all but letters and digits; limits of lines stay
    plain = F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}\n]+", " ")
    docs = _once(df.select(F.col(key).alias("id"), F.col(text).alias("text")).where("id is not null and text is not null"), plain=plain).drop("text")
    flat = lambda p: F.translate(p, "\n", " ")

    # texts with enough of some template's bigrams, and those templates
    hits = _once(docs.crossJoin(F.broadcast(every)), hits=F.array_intersect(_pairs(_words(flat(F.col("plain")))), "any"))
    some = _once(hits, near=F.filter("ts", lambda t: F.size(F.array_intersect("hits", t["b"])) >= t["need"])) \
        .where("size(near) > 0").select("id", "plain", "near")

    # lines, paragraphs and the whole
    blocks = F.split("plain", r"\n[ ]?\n[ \n]*")
    segments = F.array_distinct(F.concat(F.split("plain", "\n"), F.transform(blocks, flat), F.array(flat(F.col("plain")))))
    scored = F.transform(F.transform(segments, lambda s: F.struct(s.alias("s"), _pairs(_words(s)).alias("b"))), lambda x: F.struct(
        x["s"].alias("s"), F.filter(F.transform("near", lambda t: F.struct(
            t["template"].alias("template"), t["licence"].alias("licence"), _dice(x["b"], t["b"], t["m"]).alias("dice"))),
            lambda f: f["dice"] >= threshold).alias("found")))
    first = _once(some, good=F.filter(scored, lambda x: F.size(x["found"]) > 0))

    # runs of words in the rest; a mark stands for each matching line or paragraph
    covered = lambda s: F.array_contains(F.col("good.s"), s)
    rest = F.transform(blocks, lambda p: F.when(covered(flat(p)), "\x01").otherwise(
        F.array_join(F.transform(F.split(p, "\n"), lambda s: F.when(covered(s), "\x01").otherwise(s)), " ")))
    rest = F.when(covered(flat(F.col("plain"))), "").otherwise(F.array_join(rest, " "))
    left = _once(first, left=_pairs(_words(rest)))
    each = left.select("id", "left", F.inline("near"))
    each = _once(each, at=F.filter(F.transform("left", lambda h, i: F.when(F.array_contains("b", h), i)), lambda i: i.isNotNull()))
    place = lambda k: F.get("at", k)
    # first places from which enough bigrams of the template follow within its bound
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size("at") - F.col("need"), F.lit(0))),
                      lambda k: F.coalesce(place(k + F.col("need") - 1) - place(k) < F.col("most"), F.lit(False)))
    each = _once(each.where(F.size("at") >= F.col("need")), start=starts)
    lasts = lambda k: F.filter(F.sequence(k + F.col("need") - 1, F.least(F.size("at"), k + F.col("most")) - 1),
                               lambda j: place(j) - place(k) < F.col("most"))
    best = F.array_max(F.transform("start", lambda k: F.array_max(F.transform(lasts(k), lambda j: _dice(
        F.slice("left", place(k) + 1, place(j) - place(k) + 1), F.col("b"), F.col("m"))))))
    runs = _once(each.where(F.size("start") > 0), dice=best).where(F.col("dice") >= threshold).select("id", "template", "licence", "dice")
    found = first.select("id", F.explode("good.found").alias("found")).select("id", F.inline("found"))
    return found.unionByName(runs).groupBy("id", "template", "licence").agg(F.max("dice").alias("dice"))


def scan(df: DataFrame, threshold: float = THRESHOLD, templates: list[tuple[str, str]] | None = None, key: str = "doc_id",
         text: str = "text") -> DataFrame:
    """key, licence (the best match's, null if none), dice and all licences found (sorted, joined by commas)."""
    found = matches(df, threshold, templates, key, text).groupBy("id").agg(
        F.min(F.struct((-F.col("dice")).alias("d"), "licence")).alias("best"), F.array_join(F.array_sort(F.collect_set("licence")), ",").alias("licences"))
    ids = df.select(F.col(key).alias("id")).where("id is not null").distinct()
    return ids.join(found, "id", "left").select(F.col("id").alias(key), F.col("best.licence").alias("licence"),
                                                F.coalesce(-F.col("best.d"), F.lit(0.0)).alias("dice"), F.coalesce("licences", F.lit("")).alias("licences"))
