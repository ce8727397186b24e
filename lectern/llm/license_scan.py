"""License scans (7, native): passages against licence templates by Dice over word bigrams.

A passage (a line, the whole text, or a window of consecutive words across or within lines) and a template
are normalised to lower-case words of letters and digits; their similarity is twice the shared distinct
bigrams over the sum of both counts. Similarity t needs a count between t / (2 - t) and (2 - t) / t of the
template's, so most passages are compared with few templates or none, and t / (2 - t) of the template's
bigrams shared, so a text without any of a few of its words is not looked at. Windows begin and end at a
bigram of the template. All within a row: no join, no shuffle. The templates are a fixed table, not data.
"""

from __future__ import annotations

import functools
import math
import operator
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh, table, text_or_empty

LEAST = 0.8
#: Public licence notices, by SPDX identifier.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    # Whole texts and whole notices.
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
]


def template_bigrams(text: str) -> list[str]:
    words = re.findall(r"[a-z0-9]+", text.lower())
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


#: Words of templates that are common elsewhere, the last choice where any word will do to tell texts apart.
COMMON = set("a an and any are as at be by for from in is it no not of on or other so such the this to under use with without work".split())


def _bounds(size: int, least: float) -> tuple[int, int]:
    """Fewest and most bigrams of a passage that can be similar; the fewest are also those it must share."""
    return math.ceil(size * least / (2 - least) - 1e-9), math.floor(size * (2 - least) / least + 1e-9)


def key_words(grams: list[list[str]], least: float) -> list[str]:
    """Words of which each passage similar to any of the templates has one: too few of its bigrams are without them."""
    keys: dict[str, None] = {}
    for own in grams:
        while True:
            bare = [g.split() for g in own if not keys.keys() & set(g.split())]
            if len(bare) < max(1, _bounds(len(own), least)[0]):
                break
            words = sorted({w for g in bare for w in g})
            keys[max(words, key=lambda w: (w not in COMMON and not w.isdigit(), sum(w in g for g in bare), len(w)))] = None
    return list(keys)


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often a lambda inside refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _windows(word_lists: Column, hits: Column, table_: list[tuple[str, list[str]]], least: float) -> Column:
    """Hits of windows, best first taken, that neither overlap one another nor stand on a line that is a hit."""
    sizes = F.array(*(F.lit(len(g)) for _, g in table_))
    needs, mosts = (F.array(*(F.lit(max(1, _bounds(len(g), least)[k])) for _, g in table_)) for k in range(2))
    grams_of, names = F.array(*(F.array(*map(F.lit, g)) for _, g in table_)), F.array(*(F.lit(n) for n, _ in table_))
    every = sorted({x for _, g in table_ for x in g})

    def places(marks: Column) -> Column:
        return F.array(*(F.transform(F.filter(marks, lambda x: x["gram"].isin(g)), lambda x: x["at"]) for _, g in table_))  # noqa: B023

    def of_template(grams: Column, own: Column, k: Column) -> Column:
        need, most, size = F.get(needs, k), F.get(mosts, k), F.get(sizes, k)
        starts = F.filter(F.transform(own, lambda p, a: F.struct(p.alias("p"), a.alias("a"))), lambda s: F.coalesce(F.get(own, s["a"] + need - 1) < s["p"] + most, F.lit(False)))

        def measured(s: Column) -> Column:
            ends = F.filter(F.slice(own, s["a"] + need, most), lambda q: q < s["p"] + most)
            # The end is chosen by counts of bigrams, the similarity is that of the distinct ones.
            end = F.array_max(F.transform(ends, lambda q, j: F.struct(((need + j) * 2.0 / (q - s["p"] + 1 + size)).alias("by"), q.alias("q"))))["q"]
            return _let(end, lambda q: _let(F.array_distinct(F.slice(grams, s["p"] + 1, q - s["p"] + 1)), lambda g: F.struct((-F.size(F.array_intersect(g, F.get(grams_of, k))) * 2.0 / (F.size(g) + size)).alias("less"), (-size).alias("shorter"), k.alias("k"), s["p"].alias("p"), q.alias("q"))))

        return F.filter(F.transform(starts, measured), lambda c: c["less"] <= -least)

    def chosen(flat: Column, line_of: Column) -> Column:
        grams = F.when(F.size(flat) > 1, F.transform(F.sequence(F.lit(1), F.size(flat) - 1), lambda k: F.concat_ws(" ", F.get(flat, k - 1), F.get(flat, k)))).otherwise(F.expr("cast(array() as array<string>)"))

        def found(g: Column) -> Column:
            marks = F.filter(F.transform(g, lambda x, at: F.struct(x.alias("gram"), at.alias("at"))), lambda x: x["gram"].isin(every))
            return _let(marks, lambda m: F.flatten(F.transform(places(m), lambda own, k: of_template(g, own, k))))

        def free(c: Column) -> Column:
            # A hit on the whole text says its licence for all of it.
            on = lambda h: h["line"].between(F.get(line_of, c["p"]), F.get(line_of, c["q"] + 1)) | ((h["line"] == -1) & (h["license"] == F.get(names, c["k"])))
            return ~F.exists(hits, on)

        start = F.expr("cast(array() as array<struct<less:double,shorter:int,k:int,p:int,q:int>>)")
        taken = F.aggregate(F.array_sort(F.filter(_let(grams, found), free)), start, lambda done, c: F.when(F.exists(done, lambda d: (d["p"] <= c["q"] + 1) & (c["p"] <= d["q"] + 1)), done).otherwise(F.concat(done, F.array(c))))
        ordered = F.array_sort(F.transform(taken, lambda c: F.struct(c["p"].alias("p"), c["k"].alias("k"), c["less"].alias("less"))))
        return F.transform(ordered, lambda c: F.struct(F.get(line_of, c["p"]).alias("line"), F.get(names, c["k"]).alias("license"), F.round(-c["less"], 6).alias("dice")))

    return _let(word_lists, lambda w: _let(F.flatten(w), lambda flat: _let(F.flatten(F.transform(w, lambda x, i: F.array_repeat(i, F.size(x)))), lambda line_of: chosen(flat, line_of))))


def license_scan(docs: DataFrame, text_col: str = "text", least: float = LEAST, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """Rows of ``docs`` with hits, the matches of its passages: (line, license, dice); line -1 is the whole text.

    Each passage gives its best licence: the highest Dice coefficient of ``least`` or more, the first
    template of a tie. A passage of fewer than two words has no bigrams and no match. Letters outside ASCII
    part words. A null or empty text has no hits. The whole text counts as a passage only if it has more
    lines than one. Windows of up to the most words that can be similar follow the lines and the whole text,
    with the line they begin on, in the order of their places: the most similar first, then the longer
    template's, and none that overlaps a better one, stands on a line that is a hit, or repeats the licence
    of the whole text. Repeated rows get the same hits; a column named hits is replaced.
    """
    table_ = [(name, template_bigrams(text)) for name, text in (TEMPLATES if templates is None else templates)]
    table_ = [(name, b) for name, b in table_ if b]
    low = min((_bounds(len(b), least)[0] for _, b in table_), default=1)
    high = max((_bounds(len(b), least)[1] for _, b in table_), default=0)
    keys = key_words([b for _, b in table_], least)
    # Short words stand within many others.
    key = lambda s, w: F.contains(s, F.lit(w)) if len(w) > 4 else F.contains(s, F.lit(w)) & s.rlike(f"(?<![a-z0-9]){w}(?![a-z0-9])")
    has_key = lambda s: functools.reduce(operator.or_, (key(s, w) for w in keys), F.lit(False))
    text = _let(F.lower(text_or_empty(text_col)), lambda s: F.when(has_key(s), s).otherwise(F.lit("")))
    plain = docs.drop("hits")
    lower, held = fresh(plain, "lower_text", "passages")
    split = plain.withColumn(lower, text)
    text = F.col(lower)
    words = lambda s: F.filter(F.split(F.regexp_replace(s, "[^a-z0-9]+", " "), " "), lambda w: w != "")
    lines = F.split(text, "\n", -1)
    # A passage of n bigrams has n + 1 words, and so 2n + 1 characters at least; its distinct bigrams may be fewer.
    passages = F.filter(F.transform(F.concat(lines, F.when(F.size(lines) > 1, F.array(text)).otherwise(F.expr("cast(array() as array<string>)"))), lambda s, i: F.struct(F.when(i < F.size(lines), i).otherwise(-1).alias("line"), s.alias("s"))), lambda p: (F.length(p["s"]) >= 2 * low + 1) & has_key(p["s"]))
    split = split.withColumn(held, F.transform(passages, lambda p: F.struct(p["line"].alias("line"), words(p["s"]).alias("words"))))
    able = F.filter(held, lambda p: F.size(p["words"]) > low)
    grams = lambda w: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda k: F.concat_ws(" ", F.element_at(w, k), F.element_at(w, k + 1))))
    split = split.withColumn(held, F.transform(able, lambda p: F.struct(p["line"].alias("line"), grams(p["words"]).alias("grams"))))

    def best(p: Column) -> Column:
        n = F.size(p["grams"])
        scored = []
        for k, (name, grams_) in enumerate(table_):
            size = len(grams_)
            fits = n.between(*_bounds(size, least))
            dice = F.size(F.array_intersect(p["grams"], F.array(*map(F.lit, grams_)))) * 2.0 / (n + size)
            scored.append(F.struct(F.when(fits, dice).otherwise(0.0).alias("dice"), F.lit(-k).alias("order"), F.lit(name).alias("license")))
        return F.array_max(F.array(*scored))

    none = F.expr("cast(array() as array<struct<line:int,license:string,dice:double>>)")
    if not table_:
        return split.drop(held, lower).withColumn("hits", none)
    in_reach = F.filter(held, lambda p: F.size(p["grams"]).between(low, high))
    found = F.transform(in_reach, lambda p: F.struct(p["line"].alias("line"), best(p).alias("best")))
    split = split.withColumn(held, F.filter(found, lambda x: x["best"]["dice"] >= least))
    hits = F.transform(held, lambda x: F.struct(x["line"].alias("line"), x["best"]["license"].alias("license"), F.round(x["best"]["dice"], 6).alias("dice")))
    split = split.withColumn("hits", F.coalesce(hits, none))
    more = F.when(text != "", F.concat("hits", _windows(F.transform(F.split(text, "\n", -1), words), F.col("hits"), table_, least)))
    return split.withColumn("hits", F.coalesce(more, "hits")).drop(held, lower)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["license"]))), ",")
    lines = F.array_join(F.transform("hits", lambda h: F.concat_ws(":", h["line"].cast("string"), h["license"])), ",")
    return found.select("doc_id", F.size("hits").cast("long").alias("n_hits"), names.alias("licenses"), F.coalesce(F.array_max(F.transform("hits", lambda h: h["dice"])), F.lit(0.0)).alias("best_dice"), lines.alias("hit_lines"))
