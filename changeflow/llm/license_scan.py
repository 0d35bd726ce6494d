"""License scans by the Dice coefficient over word bigrams, in DataFrame functions only.

A text is normalised (A-Z in lower case; every run of ASCII characters other than letters and digits is
one space; lines stay apart). Compared with license templates are each of its lines, the whole text if it has
several, and windows of words that pass over lines: as many bigrams as the template has, or up to the end of
the text, from every place where one of the template's bigrams begins. So a notice is found that is wrapped,
or stands inside a longer line. The score is twice the bigrams in common by the sum of both numbers of
bigrams, repeated bigrams counted as often as they occur.

For a score of at least ``t`` the numbers n of the text and m of the template must satisfy
``m * t / (2 - t) <= n <= m * (2 - t) / t``, so templates (and lines that fit no template) are pruned by
counting spaces, before any bigram is made. A template is looked for only in texts that hold enough of its
words, its windows only where enough of its bigrams are; the number of hits inside a window, which the places
of the hits tell, bounds its score before bigrams are counted. All is computed within the row: nothing is shuffled,
however often a line or a document is repeated.

Defined results: null and empty texts, and texts of one word, match nothing. Of a document's matches with
one license the best counts: the highest score, then the first line (the whole text is line 0, a window has
the line on which it begins). Of its licenses that with most bigrams in common wins, so a full text goes before
a sentence inside it; then the best score, the first line, the first by name. Repeated rows are scanned each. Only the id and the text are read.
"""

from __future__ import annotations

import json
from collections import Counter
from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
#: Templates are constants of the plan, so their words are bounded.
MAX_TEMPLATE_WORDS = 200_000

# Public license notices and texts.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file'
    " except in compliance with the License. You may obtain a copy of the License at"
    " http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,"
    ' software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS'
    " OF ANY KIND, either express or implied. See the License for the specific language governing permissions and"
    " limitations under the License.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted"
    " provided that the following conditions are met: 1. Redistributions of source code must retain the above"
    " copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must"
    " reproduce the above copyright notice, this list of conditions and the following disclaimer in the"
    " documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright"
    " holder nor the names of its contributors may be used to endorse or promote products derived from this"
    ' software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND'
    ' CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED'
    " WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE"
    " COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR"
    " CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE,"
    " DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT,"
    " STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS"
    " SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of"
    " the GNU General Public License as published by the Free Software Foundation, either version 3 of the"
    " License, or (at your option) any later version. This program is distributed in the hope that it will be useful,"
    " but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR"
    " PURPOSE. See the GNU General Public License for more details.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee"
    " is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING'
    " ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,"
    " DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR"
    " PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN"
    " CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "mit": "Released under the MIT License.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and"
    ' associated documentation files (the "Software"), to deal in the Software without restriction, including'
    " without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies"
    " of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following"
    " conditions: The above copyright notice and this permission notice shall be included in all copies or"
    ' substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS'
    " OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE"
    " AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR"
    " OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION"
    " WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of"
    " the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy,"
    " modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled"
    " binary, for any purpose, commercial or non-commercial, and by any means.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the"
    " authors be held liable for any damages arising from the use of this software. Permission is granted to anyone"
    " to use this software for any purpose, including commercial applications, and to alter it and redistribute it"
    " freely, subject to the following restrictions",
}

TABLE = (
    "array<struct<license: string, n: int, least: int, most: int, grams: array<string>, kinds: array<string>, "
    "words: array<string>, enough_kinds: int, enough_words: int>>"
)
FOUND = "array<struct<less: int, minus: double, line: int, license: string>>"
#: Runs of ASCII characters other than small letters, digits and the newline.
GAPS = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def template_words(text: str) -> list[str]:
    out = "".join(c if c in LOWER or c in "0123456789" or ord(c) > 127 else " " for c in text.translate(str.maketrans(UPPER, LOWER)))
    return out.split()


def bounds(n: int, threshold: float) -> tuple[int, int]:
    """Fewest and most bigrams of a text that can score ``threshold`` with a template of ``n``."""
    slack = 1e-9
    return ceil(n * threshold / (2 - threshold) - slack), floor(n * (2 - threshold) / threshold + slack)


def numbered(words: list[str]) -> list[str]:
    """Bigrams, the k-th of its kind marked with k."""
    seen: Counter[str] = Counter()
    out = []
    for a, b in zip(words, words[1:], strict=False):
        seen[f"{a} {b}"] += 1
        out.append(f"{a} {b} {seen[f'{a} {b}']}")
    return out


def _templates(templates: dict[str, str], threshold: float) -> Column:
    words = {name: template_words(text) for name, text in sorted(templates.items())}
    if sum(map(len, words.values())) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates of more than {MAX_TEMPLATE_WORDS} words")
    if short := [name for name, w in words.items() if len(w) < 2]:
        raise ValueError(f"templates of fewer than two words: {short}")
    limits = {name: bounds(len(w) - 1, threshold) for name, w in words.items()}
    rows = []
    for name, w in words.items():
        least, most = limits[name]
        lost = len(w) - 1 - least
        kinds = _distinct(map(" ".join, zip(w, w[1:], strict=False)))
        row = {"license": name, "n": len(w) - 1, "least": least, "most": most, "grams": numbered(w)}
        # For windows: distinct bigrams and words, and how many of them a text must hold at least.
        row |= {"kinds": kinds, "words": _distinct(w), "enough_kinds": max(1, len(kinds) - lost), "enough_words": max(1, len(set(w)) - lost)}
        rows.append(row)
    # A constant of the plan: Spark folds it once.
    return F.from_json(F.lit(json.dumps(rows)), TABLE)


def _distinct(items) -> list[str]:
    return sorted(set(items))


def _bound(value: Column, fn) -> Column:
    """``fn(value)`` with the value evaluated once, as the argument of a one-element array's function."""
    return F.transform(F.array(value), fn)[0]


def _pairs(words: Column) -> Column:
    second = F.slice(words, F.lit(2), F.size(words))
    return F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), second, lambda a, b: F.concat(a, F.lit(" "), b))


def _numbered(pairs: Column) -> Column:
    """Sorted bigrams, the k-th of its kind marked with k."""
    return F.transform(pairs, lambda p, i: F.concat(p, F.lit(" "), (i - F.array_position(pairs, p) + 2).cast("string")))


def _grams(text: Column) -> Column:
    """Numbered bigrams of a normalised text."""
    return _bound(F.array_sort(_bound(F.split(text, " "), _pairs)), _numbered)


def _line(text: Column, word: Column) -> Column:
    """The line that holds a word, counted from 0, of a normalised text."""
    sizes = F.transform(F.split(text, "\n", -1), lambda x: F.size(F.filter(F.split(x, " "), lambda w: w != "")))
    start = F.struct(F.lit(0).alias("line"), F.lit(0).alias("seen"))
    walked = F.aggregate(
        sizes,
        start,
        lambda a, n: F.when(a["seen"] > word, a).otherwise(F.struct((a["line"] + 1).alias("line"), (a["seen"] + n).alias("seen"))),
    )
    return walked["line"]


def _likely(words: Column, table: Column, vocabulary: list[str]) -> Column:
    """The templates of which the text has enough words, wherever they stand."""
    met = F.array_intersect(words, F.split(F.lit(" ".join(vocabulary)), " "))

    def of(met: Column) -> Column:
        enough = lambda t: F.size(F.array_intersect(met, t["words"])) >= t["enough_words"]
        return F.filter(table, lambda t: (F.size(met) >= t["enough_words"]) & enough(t))

    return _bound(met, of)


def _windows(text: Column, words: Column, table: Column, threshold: float) -> Column:
    """The best window of each license: structs of ``minus``, ``line``, ``license`` and ``less``, all but the name to be small."""

    def best(grams: Column, t: Column) -> Column:
        placed = F.transform(grams, lambda g, i: F.struct(i.alias("at"), g.alias("gram")))
        hits = F.filter(placed, lambda h: F.array_contains(t["kinds"], h["gram"]))

        def scored(hits: Column) -> Column:
            def score(h: Column, k: Column) -> Column:
                size = F.least(t["n"], F.size(grams) - h["at"])
                inside = F.filter(F.slice(hits, k + 1, t["n"]), lambda x: x["at"] < h["at"] + t["n"])

                def exact(inside: Column) -> Column:
                    own = F.array_sort(F.transform(inside, lambda x: x["gram"]))
                    common = F.size(F.array_intersect(_bound(own, _numbered), t["grams"]))
                    likely = 2.0 * F.size(inside) >= (threshold - 1e-9) * (size + t["n"])
                    return F.when(
                        likely, _bound(common, lambda c: F.struct((-2.0 * c / (size + t["n"])).alias("minus"), h["at"].alias("at"), (-c).alias("less")))
                    )

                return _bound(inside, exact)

            return F.array_min(F.filter(F.transform(hits, score), lambda m: m["minus"] <= -threshold))

        return F.when(F.size(F.array_intersect(grams, t["kinds"])) >= t["enough_kinds"], _bound(hits, scored))

    each = _bound(_pairs(words), lambda grams: F.transform(table, lambda t: F.struct(best(grams, t).alias("m"), t["license"].alias("license"))))

    def placed(x: Column) -> Column:
        line = _line(text, x["m"]["at"])
        return F.struct(x["m"]["minus"].alias("minus"), line.alias("line"), x["license"].alias("license"), x["m"]["less"].alias("less"))

    return F.transform(F.filter(each, lambda x: x["m"].isNotNull()), placed)


def _units(text: Column, whole: Column, table: Column, threshold: float) -> Column:
    """Matches of lines and of the whole text, as those of ``_windows``."""
    lines = F.split(text, "\n", -1)
    units = F.transform(lines, lambda x, i: F.struct((i + 1).alias("line"), F.trim(x).alias("s")))
    one = F.array(F.struct(F.lit(0).alias("line"), whole.alias("s")))
    units = F.concat(units, F.when(F.contains(text, F.lit("\n")), one).otherwise(F.slice(one, 1, 0)))
    counted = F.transform(
        units,
        lambda u: F.struct(
            u["line"].alias("line"),
            u["s"].alias("s"),
            (F.length(u["s"]) - F.length(F.replace(u["s"], F.lit(" "), F.lit("")))).alias("n"),
        ),
    )
    likely = F.filter(counted, lambda c: F.exists(table, lambda t: c["n"].between(t["least"], t["most"])))

    def compare(c: Column) -> Column:
        def score(grams: Column) -> Column:
            fitting = F.filter(table, lambda t: c["n"].between(t["least"], t["most"]))
            return F.transform(
                fitting,
                lambda t: _bound(
                    F.size(F.array_intersect(grams, t["grams"])),
                    lambda common: F.struct(
                        (-2.0 * common / (c["n"] + t["n"])).alias("minus"),
                        c["line"].alias("line"),
                        t["license"].alias("license"),
                        (-common).alias("less"),
                    ),
                ),
            )

        return _bound(_grams(c["s"]), score)

    return F.filter(F.flatten(F.transform(likely, compare)), lambda m: m["minus"] <= -threshold)


def matches(text: Column, whole: Column, templates: dict[str, str], threshold: float) -> Column:
    """The best match with each license: structs of ``score``, ``line`` and ``license``, the best first.

    ``text`` is normalised, ``whole`` the same in one line.
    """
    table = _templates(templates, threshold)
    vocabulary = _distinct(w for t in templates.values() for w in template_words(t))

    def best(found: Column) -> Column:
        names = F.array_distinct(F.transform(found, lambda m: m["license"]))
        of = F.transform(names, lambda n: F.array_min(F.filter(found, lambda m: m["license"] == n)))
        return F.transform(of, lambda m: F.struct(*[m[c].alias(c) for c in ("less", "minus", "line", "license")]))

    def compared(words: Column) -> Column:
        def by(table: Column) -> Column:
            found = F.concat(_units(text, whole, table, threshold), _windows(text, words, table, threshold))
            return F.when(F.size(table) > 0, F.array_sort(_bound(found, best)))

        return _bound(_likely(words, table, vocabulary), by)

    found = F.coalesce(_bound(F.split(whole, " "), compared), F.from_json(F.lit("[]"), FOUND))
    return F.transform(found, lambda m: F.struct((-m["minus"]).alias("score"), m["line"].alias("line"), m["license"].alias("license")))


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, UPPER, LOWER), GAPS, " ")


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id`` and ``matches`` of each document."""
    text = docs.select("doc_id", normalised(F.coalesce("text", F.lit(""))).alias("_text"))
    text = text.select("doc_id", "_text", F.trim(F.regexp_replace("_text", "[ \n]+", " ")).alias("_whole"))
    return text.select("doc_id", matches(F.col("_text"), F.col("_whole"), templates, threshold).alias("matches"))


def license_scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``n_matches`` (licenses) and the best match (``license``, ``line``, ``score``; else null) of each document."""
    best = F.get(F.col("matches"), F.lit(0))
    return scan(docs, templates, threshold).select(
        "doc_id",
        F.size("matches").cast("long").alias("n_matches"),
        best["license"].alias("license"),
        best["line"].alias("line"),
        best["score"].alias("score"),
    )
