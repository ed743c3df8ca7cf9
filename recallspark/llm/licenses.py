"""License scans: Dice coefficient over word bigrams against licence templates (DataFrame functions only).

A text is normalised to one row of lower-case words of letters and digits, so line breaks, comment marks and punctuation are nothing. Where it holds an
anchor of a template, one of its least common bigrams, windows around that place are compared with the template. For sets of bigrams A and B,
Dice = 2 |A ∩ B| / (|A| + |B|) can reach t only if |A| is between t / (2 - t) and (2 - t) / t times |B|: windows are as long as these bounds
allow, and those of too few different bigrams are never compared. A template has so many anchors that a window without any cannot reach
t. Everything happens within the row, so no row is shuffled.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

THRESHOLD = 0.8

#: Public licence notices and headers.
TEMPLATES = {
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "MIT-notice": "Released under the MIT License.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "All-rights-reserved": "All rights reserved.",
    "MIT-full": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC-full": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "BSD-3-Clause-full": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
}


#: Lengths of the windows around an anchor, in parts of the template's.
SCALES = (0.8, 1.0, 1.25)


@dataclass(frozen=True)
class Template:
    """A template's distinct bigrams, the number of all, and its anchors with their first places."""

    name: str
    grams: tuple[str, ...]
    length: int
    anchors: tuple[tuple[str, int], ...]


def prepared(templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> list[Template]:
    """Templates by name. A window that reaches the threshold holds so many of a template's bigrams that it cannot lack all of its anchors; bigrams of long words are taken first, as they are rarer."""
    out = []
    for name, text in sorted(templates.items()):
        w = re.findall(r"[^\W_]+", text.lower())
        grams = [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]
        once = sorted(set(grams))
        # Dice >= t with |A| >= t / (2 - t) |B| leaves out this share of B's bigrams at most
        spare = math.floor(len(once) * (1 - threshold / (2 - threshold)) + 1e-9)
        best = sorted(once, key=lambda g: (-len(g), g))[: spare + 1]
        out.append(Template(name, tuple(once), len(grams), tuple((g, grams.index(g)) for g in best)))
    return out


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def scan(docs: DataFrame, *, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, license, dice, word, n_licenses) for each row of docs(doc_id, text).

    license: the template of the best window of threshold or more (ties: the first by name), null if there is none; dice, to 6 digits; word: the
    number of the window's first word among the text's, from 0 (ties: the first); n_licenses: how many templates are found. Null and empty
    texts match nothing. Repeated rows: each by itself. Columns other than the two are not read; an empty table gives an empty result.
    """
    known = prepared(templates, threshold)
    low = threshold / (2 - threshold)
    # an anchor leads to its places in templates: (template, place of the anchor in it)
    leads: dict[str, list[tuple[int, int]]] = {}
    for k, t in enumerate(known):
        for g, at in t.anchors:
            leads.setdefault(g, []).append((k, at))
    one = lambda g, x: F.struct(F.lit(x[0]).alias("k"), F.lit(x[1]).alias("at"), F.lit(known[x[0]].length).alias("n"))
    table = F.create_map(*[c for g, xs in leads.items() for c in (F.xxhash64(F.lit(g)), F.array(*[one(g, x) for x in xs]))])
    sets = F.array(*[F.array(*[F.xxhash64(F.lit(g)) for g in t.grams]) for t in known])
    names = F.array(*[F.lit(t.name) for t in known])
    text = F.coalesce(F.col("text"), F.lit(""))
    # a text without a single anchor, nearly all, ends with its bigrams
    first = F.array(*[F.xxhash64(F.lit(g)) for g in leads])

    def bigrams(words: Column) -> Column:
        n = F.greatest(F.size(words) - 1, F.lit(0))
        return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.xxhash64(F.concat(a, F.lit(" "), b)))

    rows = docs.select("doc_id", bigrams(F.split(normal(text), " ")).alias("grams"))
    hits = F.when(F.arrays_overlap("grams", first), F.filter(F.transform("grams", lambda g, i: F.struct(i.alias("i"), g.alias("g"))), lambda x: x["g"].isin(*[_literal(g) for g in leads])))
    rows = rows.select("doc_id", F.when(F.size(hits) > 0, F.col("grams")).alias("grams"), hits.alias("hits"))

    def windows(hit: Column) -> Column:
        """struct(k, begin, n) around one anchor, for each of its templates and each scale."""
        at = F.transform(F.element_at(table, hit["g"]), lambda x: F.array(*[F.struct(x["k"].alias("k"), F.greatest(hit["i"] - F.floor(x["at"] * s).cast("int"), F.lit(0)).alias("begin"), F.greatest(F.floor(x["n"] * s + 0.5).cast("int"), F.lit(1)).alias("n")) for s in SCALES]))
        return F.flatten(at)

    def compared(w: Column) -> Column:

        def score(x: Column) -> Column:
            h, theirs = x["h"], x["theirs"]
            dice = F.round(2.0 * F.size(F.array_intersect(h, theirs)) / (F.size(h) + F.size(theirs)), 6)
            # least first: minus dice, then the name's place, then the window's
            return F.when(F.size(h) >= F.size(theirs) * low - 1e-9, F.struct((-dice).alias("d"), w["k"].alias("k"), w["begin"].alias("begin")))

        return let(F.struct(F.array_distinct(F.slice("grams", w["begin"] + 1, w["n"])).alias("h"), F.element_at(sets, w["k"] + 1).alias("theirs")), score)

    tried = F.array_distinct(F.flatten(F.transform("hits", windows)))
    found = F.filter(F.transform(tried, compared), lambda x: x.isNotNull() & (x["d"] <= -threshold))
    rows = rows.select("doc_id", F.coalesce(found, F.expr("cast(array() as array<struct<d: double, k: int, begin: int>>)")).alias("found"))
    rows = rows.select("doc_id", F.array_min("found").alias("top"), F.size(F.array_distinct(F.transform("found", lambda x: x["k"]))).cast("long").alias("n_licenses"))
    return rows.select("doc_id", F.when(F.col("top").isNotNull(), F.element_at(names, F.col("top.k") + 1)).alias("license"), (-F.col("top.d")).alias("dice"), F.col("top.begin").cast("long").alias("word"), "n_licenses")


def _literal(gram: str) -> Column:
    return F.xxhash64(F.lit(gram))


def _sql() -> str:
    q = lambda g: chr(39) + g + chr(39)
    known = prepared()
    sets = ", ".join(f"({k}, {q(t.name)}, {t.length}, [{', '.join(q(g) for g in t.grams)}])" for k, t in enumerate(known))
    anchors = ", ".join(f"({k}, {q(g)}, {at})" for k, t in enumerate(known) for g, at in t.anchors)
    return f"""
WITH t(k, name, n, grams) AS (VALUES {sets}), a(k, gram, first) AS (VALUES {anchors}), z(scale) AS (VALUES {", ".join(f"({s}::DOUBLE)" for s in SCALES)}),
w AS (SELECT row_number() OVER () AS r, doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS words FROM documents),
b AS (SELECT r, doc_id, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) AS grams FROM w),
p AS (SELECT r, unnest(grams) AS gram, generate_subscripts(grams, 1) - 1 AS i FROM b),
v AS (SELECT DISTINCT r, a.k, greatest(i - floor(a.first * scale)::BIGINT, 0) AS start, greatest(floor(t.n * scale + 0.5)::BIGINT, 1) AS n FROM p JOIN a USING (gram) JOIN t ON t.k = a.k, z),
c AS (SELECT v.r, v.k, start, t.name, t.grams AS theirs, list_distinct(b.grams[start + 1 : start + v.n]) AS mine FROM v JOIN b USING (r) JOIN t ON t.k = v.k),
d AS (SELECT r, k, start, name, round(2.0 * len(list_intersect(mine, theirs)) / (len(mine) + len(theirs)), 6) AS dice FROM c WHERE len(mine) >= len(theirs) * {THRESHOLD / (2 - THRESHOLD)} - 1e-9),
h AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY dice DESC, k, start) AS place FROM d WHERE dice >= {THRESHOLD}),
n AS (SELECT r, count(DISTINCT k) AS n FROM h GROUP BY r)
SELECT w.doc_id, h.name AS license, h.dice::DOUBLE AS dice, h.start::BIGINT AS word, coalesce(n.n, 0)::BIGINT AS n_licenses
FROM w LEFT JOIN h ON h.r = w.r AND h.place = 1 LEFT JOIN n ON n.r = w.r
"""


SQL = _sql()
