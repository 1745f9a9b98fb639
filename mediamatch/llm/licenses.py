"""License scan: MinHash bands over overlapping windows retrieve templates, exact containment verifies them.

A text is read as overlapping windows, of `WINDOW` words every `STRIDE` words for short templates. A window that holds a
template holds all its word shingles, so the two sets have a Jaccard similarity of at least
template shingles / window shingles. With one-row bands the chance that none of `BANDS` bands agrees is
(1 - similarity) ** BANDS; for a template of a single shingle in a full window that is below 1e-4, for
longer templates far less. A retrieved template is kept if the window contains at least `CONTAINMENT` of
its shingles exactly.

Windows follow the templates: one of up to 13 words is looked for in windows of `WINDOW` words, a longer one in
windows of twice, four times ... as many, with a stride that grows alike. So every template lies in one window
wholly and makes up a third of it at least.

A shingle can only match if its longest word occurs, so texts and windows without any of these words are
passed over before MinHash. Of a longer template so many words count that the shingles without them are too
few for `CONTAINMENT`. Both are exact. Windows stay inside one pass over the scan: nothing is shuffled
but verified matches, combined before the shuffle. The template table is fixed and small, so it is
broadcast. Column functions only.

Defined results: words are runs of letters and digits, lower-cased; null and empty texts match nothing; a
text shorter than a window is one window; repeated rows change nothing but the window count; a template
that occurs several times is one row with its first place; an empty table gives no row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from mediamatch.llm.decontamination import words_of

# Public license statements.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
}
_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT,
STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF
ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
#: Further usual statements, file headers and whole texts of the same and of other licenses.
WORDINGS = (
    ("Apache-2.0", "Licensed under the Apache License 2.0"),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License."""),
    ("GPL-3.0", "licensed under the GNU General Public License version 3 or later"),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES
OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("BSD-2-Clause", f"{_BSD_2} {_DISCLAIMER}"),
    ("BSD-3-Clause", f"{_BSD_2} {_BSD_3} {_DISCLAIMER}"),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
)
SHINGLE = 5
WINDOW = 16
STRIDE = 4
BANDS = 120
CONTAINMENT = 0.8


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def _pieces(words: list[str], shingle: int) -> list[str]:
    return list(dict.fromkeys(" ".join(words[i : i + shingle]) for i in range(max(len(words) - shingle + 1, 1))))


def anchor_words(templates: dict[str, str], shingle: int = SHINGLE) -> list[str]:
    """A word of every shingle of every template: its longest, the first of equals."""
    found = {max(piece.split(" "), key=len) for text in templates.values() for piece in _pieces(template_words(text), shingle)}
    return sorted(found)


def window_of(n_words: int) -> int:
    """Words of the windows in which a template of so many words is looked for."""
    window = WINDOW
    while n_words > window - window * STRIDE // WINDOW + 1:
        window *= 2
    return window


def needed_words(text: str, containment: float, shingle: int = SHINGLE) -> list[str]:
    """Words of which a window holds one at least if it holds `containment` of the template's shingles: long ones first,
    by the shingles they stand in, until the shingles without any of them are fewer than that."""
    left = [set(piece.split(" ")) for piece in _pieces(template_words(text), shingle)]
    least, out = containment * len(left) - 1e-9, []
    while left and len(left) >= least:
        words = sorted(set().union(*left))
        out.append(max(words, key=lambda w: (len(w) > 5, sum(w in piece for piece in left))))
        left = [piece for piece in left if out[-1] not in piece]
    return out


def shingles_of(words: Column, shingle: int = SHINGLE) -> Column:
    """Distinct shingles of a word array; all words as one shingle where there are fewer."""
    n = F.greatest(F.size(words) - (shingle - 1), F.lit(1))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(words, i, shingle), " ")))


def _once(value: Column) -> Column:
    """The value behind a generator, so that it is computed once and not again at each place that reads it."""
    return F.explode(F.array(value))


def _banded(rows: DataFrame, shingles: str) -> DataFrame:
    """The rows once for each band, with the band's number and the smallest shingle hash under its hash function."""
    hashed = rows.select("*", _once(F.transform(shingles, lambda s: F.xxhash64(s))).alias("hashed"))
    seeds = F.sequence(F.lit(0), F.lit(BANDS - 1))
    smallest = F.transform(seeds, lambda k: F.array_min(F.transform("hashed", lambda h: F.xxhash64(h, k))))
    return hashed.select(*rows.columns, F.posexplode(smallest).alias("band", "value"))


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: dict[str, str] | None = None,
    containment: float = CONTAINMENT,
) -> DataFrame:
    """(doc_id, license, containment, first_word, windows) of every license found in a document."""
    known = [*TEMPLATES.items(), *WORDINGS] if templates is None else [*templates.items()]
    held: dict[int, set[str]] = {}
    for name, text in known:
        words = template_words(text)
        window = window_of(len(words))
        if window > WINDOW and 2 * len(_pieces(words, SHINGLE)) < len(words) - SHINGLE + 1:
            raise ValueError(f"{name} repeats itself so much that a short stretch would count as the whole")
        own = anchor_words({name: text}) if window == WINDOW else needed_words(text, containment)
        held.setdefault(window, set()).update(own)
    rows = [(name, window_of(len(template_words(text))), _pieces(template_words(text), SHINGLE)) for name, text in known]
    spark = docs.sparkSession
    pieces = spark.createDataFrame(rows, "license string, width int, pieces array<string>")
    banded = F.broadcast(_banded(pieces, "pieces"))
    lowered = F.lower(docs[text_col])
    hinted = F.lit(False)
    for word in sorted(set().union(*held.values())):
        hinted = hinted | lowered.contains(word)
    texts = docs.where(hinted).select(docs[id_col].cast("long").alias("doc_id"), words_of(docs[text_col]).alias("words"))
    widths = [
        F.struct(F.lit(w).alias("width"), F.lit(w * STRIDE // WINDOW).alias("stride"), F.array(*map(F.lit, sorted(own))).alias("held"))
        for w, own in sorted(held.items())
    ]
    last = F.greatest(F.size("words") - (F.col("width") - F.col("stride")) - 1, F.lit(0))
    starts = F.sequence(F.lit(0), last - last % F.col("stride"), F.col("stride"))
    windows = (
        texts.select("doc_id", "words", F.inline(F.array(*widths)))
        .where(F.arrays_overlap("words", "held"))
        .select("doc_id", "width", "held", "words", F.explode(starts).alias("first_word"))
        .select("doc_id", "width", "held", "first_word", F.slice("words", F.col("first_word") + 1, F.col("width")).alias("window"))
        .where(F.arrays_overlap("window", "held"))
        .select("doc_id", "width", "first_word", _once(shingles_of(F.col("window"))).alias("own"))
    )
    met = _banded(windows, "own").join(banded, ["width", "band", "value"])
    share = F.size(F.array_intersect("own", "pieces")) / F.size("pieces")
    return (
        met.select("doc_id", "first_word", "license", share.alias("containment"))
        .where(F.col("containment") >= containment)
        .groupBy("doc_id", "license")
        .agg(
            F.max("containment").alias("containment"),
            F.min("first_word").cast("long").alias("first_word"),
            F.countDistinct("first_word").alias("windows"),
        )
    )
