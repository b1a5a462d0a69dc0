"""Licence scan: texts against licence templates, by Dice coefficient over sets of word bigrams.

A template of w words is compared with the windows of w words of a text that begin with one of its bigrams (a shorter
text, or the rest of one, is a window too), so a notice is found in one line, over several lines or inside a longer line, and a
licence text inside a longer text. With threshold t and b distinct template bigrams, a window has to share
m = t / (2 - t) * b of them at least: a text with fewer distinct bigrams rules the template out by its size alone, and any
b - m + 1 of the template's bigrams hold one that the window has. Those that are longest in characters, and so
tend to be rare, are its anchors; a broadcast join with them finds the candidates. All of it is DataFrame code without a shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

THRESHOLD = 0.8
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial
portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS
BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS
ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE
LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the distribution."""
_BSD_NAME = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT
NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT
HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT
LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or
implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed
in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this
program. If not, see https://www.gnu.org/licenses/."""
#: Public licence texts, notices and one-line statements by name; callers may pass their own.
TEMPLATES = {
    "mit-text": _MIT,
    "isc-text": _ISC,
    "bsd-2-clause-text": f"{_BSD_HEAD} {_BSD_TAIL}",
    "bsd-3-clause-text": f"{_BSD_HEAD} {_BSD_NAME} {_BSD_TAIL}",
    "apache-2.0-notice": _APACHE,
    "gpl-3.0-notice": _GPL,
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "mit": "Released under the MIT License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "bsd-3-clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "all-rights-reserved": "All rights reserved.",
}


def normalised(text: Column) -> Column:
    """Words of a text: lower case, everything but ASCII letters, digits and what is beyond ASCII is a separator."""
    return F.array_remove(F.split(F.lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def bigrams(w: Column) -> Column:
    """Runs of two words of an array."""
    n = F.greatest(F.size(w) - 1, F.lit(0))
    return F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.concat_ws(" ", a, b))


def prepared(spark, templates: dict[str, str], threshold: float) -> DataFrame:
    """(template, words, tb, b, least, ranked): number of words, distinct bigrams and their number, how many a window must share, anchors by rank."""
    rows = [F.struct(F.lit(k).alias("template"), normalised(F.lit(v)).alias("w")) for k, v in sorted(templates.items())]
    empty = F.array().cast("array<struct<template:string,w:array<string>>>")
    t = spark.range(1).select(F.inline(F.array(*rows) if rows else empty)).where("size(w) > 1")
    t = t.select("template", F.size("w").alias("words"), F.array_distinct(bigrams(F.col("w"))).alias("tb")).withColumn("b", F.size("tb"))
    t = t.withColumn("least", F.ceil(F.col("b") * (threshold / (2 - threshold)) - 1e-9).cast("int"))
    by = F.transform(F.sort_array(F.transform("tb", lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x")))), lambda s: s["x"])
    return t.withColumn("ranked", F.slice(by, 1, F.col("b") - F.col("least") + 1))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, template, dice, start, n_words): for each row and template the best window, if its Dice coefficient is threshold or more.

    start is the place of the window's first word, from 0; of equally good windows the first counts. Null and
    empty texts and texts of one word match nothing; a text of any length is read whole; repeated rows give repeated rows; a null doc_id
    is kept; other columns are ignored; an empty table or no templates give no rows. Templates are a parameter, whatever the data, so they may be broadcast.
    """
    t = prepared(docs.sparkSession, templates, threshold)
    anchors = t.select("template", "least", F.posexplode("ranked").alias("rank", "p"))
    # no text is null, so no filter of null bigrams is inferred, which would make them twice
    d = docs.select(F.col(doc_id).alias("doc_id"), normalised(F.coalesce(F.col(text), F.lit(""))).alias("w")).select("doc_id", bigrams(F.col("w")).alias("pairs"))
    d = d.withColumn("distinct", F.array_distinct("pairs"))
    # not explode: for it a filter of texts without bigrams is inferred
    hit = d.select("doc_id", "pairs", "distinct", F.explode_outer("distinct").alias("p")).join(F.broadcast(anchors), "p").where(F.size("distinct") >= F.col("least"))
    # one row for each text and template: that of the best-ranked anchor in the text
    one = hit.join(F.broadcast(t.drop("least")), "template").where(~F.arrays_overlap(F.slice("ranked", 1, F.col("rank")), "distinct"))
    one = one.where(F.size(F.array_intersect("tb", "distinct")) >= F.col("least"))
    begins = F.filter(F.transform("pairs", lambda p, i: F.when(F.array_contains(F.col("tb"), p), i)), lambda i: i.isNotNull())

    def window(i):
        own = F.array_distinct(F.slice("pairs", i + 1, F.col("words") - 1))
        dice = F.lit(2.0) * F.size(F.array_intersect(own, "tb")) / (F.size(own) + F.col("b"))
        return F.struct(dice.alias("dice"), (-i).alias("before"), (F.least(F.col("words") - 1, F.size("pairs") - i) + 1).alias("n_words"))

    best = one.select("doc_id", "template", F.array_max(F.transform(begins, window)).alias("m")).where(F.col("m.dice") >= threshold)
    return best.select("doc_id", "template", F.col("m.dice").alias("dice"), (-F.col("m.before")).alias("start"), F.col("m.n_words").alias("n_words"))


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    """Licence texts and notices found in each document; a null or empty text has none."""
    return scan(shared.read(spark, sf_dir, "documents"))


def _sql() -> str:
    notices = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(TEMPLATES.items()))
    cut = r"list_filter(regexp_split_to_array(lower({}), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    pairs = "list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])"
    low = THRESHOLD / (2 - THRESHOLD)
    return f"""
WITH t AS (SELECT template, n, list_distinct(p) AS tb FROM (SELECT template, len(w) AS n, {pairs} AS p FROM (SELECT template, {cut.format("notice")} AS w FROM (VALUES {notices}) v(template, notice)) x WHERE len(w) > 1) y),
d AS MATERIALIZED (SELECT doc_id, {pairs} AS p FROM (SELECT doc_id, {cut.format("text")} AS w FROM documents WHERE text IS NOT NULL) x WHERE len(w) > 1),
near AS MATERIALIZED (SELECT doc_id, template, n, tb, p FROM d, t WHERE len(list_intersect(list_distinct(p), tb)) >= {low} * len(tb) - 1e-9),
begun AS (SELECT doc_id, template, n, tb, p, unnest(generate_series(1, len(p))) AS i FROM near),
win AS (SELECT doc_id, template, tb, i, list_distinct(p[i:i + n - 2]) AS own, least(n - 1, len(p) - i + 1) + 1 AS n_words FROM begun WHERE list_contains(tb, p[i])),
scored AS (SELECT doc_id, template, i, n_words, 2.0::DOUBLE * len(list_intersect(own, tb)) / (len(own) + len(tb)) AS dice FROM win),
best AS (SELECT doc_id, template, dice, i, n_words, row_number() OVER (PARTITION BY doc_id, template ORDER BY dice DESC, i) AS r FROM scored WHERE dice >= {THRESHOLD})
SELECT doc_id, template, dice, CAST(i - 1 AS INTEGER) AS start, CAST(n_words AS INTEGER) AS n_words FROM best WHERE r = 1
"""


SQL = _sql()
