"""Licence scan by the Dice coefficient over word bigrams, in DataFrame functions only.

A text's segments are its lines, runs of up to ``RUN`` lines, sentences, paragraphs, runs of up to ``RUN`` paragraphs, and the
whole text, all normalised to lower-case words, so that comment marks and line breaks do not matter. The similarity of a
segment to a template is ``2 * common / (a + b)`` over their bags of word bigrams. It cannot reach the threshold t unless
``t / (2 - t) * b <= a <= (2 - t) / t * b``; so a segment whose number of words fits no template is dropped, and a template is
only compared with segments of its size.

Before any of that, a text or segment has to hold one of a few words: a segment that reaches t shares at least
``t / (2 - t) * b`` of a template's bigrams, so it cannot lack all words of a set that touches more than the rest.

Templates are an inverted table of their bigrams, which is broadcast (``MAX_BIGRAMS`` rows at most; some 100 bytes each): a
plan does not grow with them. The bigrams of the segments that are left are counted, a segment at a place, and joined to it;
so texts without a licence word cost one regular expression and no shuffle.

Nulls and edge cases: a null or empty text has no segment. A segment or template of one word has no bigram and never
matches. Repeated rows get equal results. An empty table gives an empty result. Other columns travel in one struct, so their
names cannot clash; a column ``licenses`` is replaced. Rows are told apart by their place, so the input has to be a written
table.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.columns import packed, unpacked
from tessera.plans.staging import stage

THRESHOLD = 0.8
#: Lines or paragraphs that a segment may run over.
RUN = 4
MAX_BIGRAMS = 1_000_000

#: Licence notices and texts.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License, see the LICENSE file for details."),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "All rights reserved."),
    (
        "MIT",
        'The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    (
        "ISC",
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ),
    (
        "BSD-2-Clause",
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.',
    ),
    (
        "BSD-3-Clause",
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.',
    ),
    (
        "BSD",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
]


def words(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _runs(parts: Column, pattern: str) -> Column:
    """All runs of one to RUN neighbouring parts, normalised, that hold a word of the pattern. Each part is normalised and
    searched once; a run holds a word if one of its parts does."""
    none = F.array().cast("array<string>")
    marked = F.transform(F.transform(parts, words), lambda w: F.struct(w.alias("w"), w.rlike(pattern).alias("hit")))

    def of(x: Column, n: int) -> Column:
        at = F.filter(F.sequence(F.lit(1), F.size(x) - n + 1), lambda i: F.exists(F.slice(x, i, F.lit(n)), lambda y: y["hit"]))
        joined = F.transform(at, lambda i: F.array_join(F.filter(F.transform(F.slice(x, i, F.lit(n)), lambda y: y["w"]), lambda w: w != ""), " "))
        return F.when((F.size(x) >= n) & F.exists(x, lambda y: y["hit"]), joined).otherwise(none)

    return F.flatten(F.transform(F.array(marked), lambda x: F.concat(*[of(x, n) for n in range(1, RUN + 1)])))


def segments(text: Column, pattern: str) -> Column:
    """The distinct normalised segments of a text that hold a word of the pattern."""
    sentences = F.filter(F.transform(F.split(text, r"[.!?][ \t\r\n]+"), words), lambda w: w.rlike(pattern))
    parts = F.concat(_runs(F.split(text, "\n"), pattern), sentences, _runs(F.split(text, r"\n[ \t\r]*\n"), pattern), F.array(words(text)))
    return F.array_distinct(parts)


def prepared(templates: list[tuple[str, str]], threshold: float = THRESHOLD) -> list[tuple]:
    """(Licence, bigrams with repeats, least and most bigrams of a segment) of each template."""
    out = []
    for name, text in templates:
        w = re.sub(r"[^\w]+|_+", " ", text.lower()).split()
        bigrams = [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]
        if bigrams:
            out.append((name, bigrams, threshold / (2 - threshold) * len(bigrams), (2 - threshold) / threshold * len(bigrams)))
    return out


def sizes(ready: list[tuple]) -> list[tuple[int, int]]:
    """The numbers of bigrams that fit a template, as ranges that do not overlap."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((math.ceil(lo - 1e-9), math.floor(hi + 1e-9)) for _, _, lo, hi in ready):
        if out and lo <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def anchors(ready: list[tuple], threshold: float = THRESHOLD) -> list[str]:
    """Words of which every segment that reaches the threshold holds at least one."""
    chosen: list[str] = []
    for _, bigrams, lo, _ in ready:
        need = math.ceil(lo - 1e-9)  # of the template's bigrams
        missing, left = 0, list(bigrams)
        words_ = dict.fromkeys(w for g in bigrams for w in g.split())
        for w in sorted(words_, key=lambda w: (w not in chosen, -len(w))):
            hit = [g for g in left if w in g.split()]
            if missing > len(bigrams) - need:
                break
            if hit:
                missing += len(hit)
                left = [g for g in left if g not in hit]
                if w not in chosen:
                    chosen.append(w)
    return sorted(w for w in chosen if not any(o != w and o in w for o in chosen))


def _pattern(chosen: list[str]) -> str:
    """One regular expression for all the words, by first letter."""
    by: dict[str, list[str]] = {}
    for w in chosen:
        by.setdefault(w[0], []).append(w[1:])
    return "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in sorted(by.items()))


def scan(docs: DataFrame, text: str = "text", templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """docs, a written table, with ``licenses``: the best similarity of each licence that reaches the threshold, by name."""
    ready = prepared(templates, threshold)
    table = [(i, name, len(bigrams), lo, hi, g, n) for i, (name, bigrams, lo, hi) in enumerate(ready) for g, n in Counter(bigrams).items()]
    if len(table) > MAX_BIGRAMS:
        raise ValueError(f"{len(table)} bigrams of templates are too many to send to every executor; scan with some of the templates at a time")
    known = F.broadcast(docs.sparkSession.createDataFrame(table, "template int, license string, b int, lo double, hi double, g string, n int"))
    pattern = _pattern(anchors(ready, threshold))
    bigrams = lambda s: F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))  # noqa: E731  of a normalised segment
    fits = lambda s: _any([bigrams(s).between(lo, hi) for lo, hi in sizes(ready)])

    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    some = docs.select(F.monotonically_increasing_id().alias("row"), value.alias("value")).filter(F.lower("value").rlike(pattern))
    each = some.select("row", F.posexplode(F.filter(segments(F.col("value"), pattern), lambda s: F.when(F.length(s) > 0, fits(s)).otherwise(False))).alias("segment", "s"))
    split = F.split("s", " ")
    pairs = F.zip_with(F.slice(split, F.lit(1), F.size(split) - 1), F.slice(split, F.lit(2), F.size(split) - 1), lambda x, y: F.concat(x, F.lit(" "), y))
    counted = each.select("row", "segment", bigrams(F.col("s")).alias("a"), F.explode(pairs).alias("g")).join(known, "g").filter("a BETWEEN lo AND hi")
    common = counted.groupBy("row", "segment", "template", "license", "a", "b", "g", "n").agg(F.count("*").alias("c"))
    dice = common.groupBy("row", "segment", "template", "license", "a", "b").agg(F.sum(F.least("c", "n")).alias("common"))
    best = dice.select("row", "license", (2 * F.col("common") / (F.col("a") + F.col("b"))).alias("dice")).filter(F.col("dice") >= threshold).groupBy("row", "license").agg(F.max("dice").alias("dice"))
    lists = best.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("license", "dice"))).alias("licenses"))  # one entry a licence
    found = packed(docs).withColumn("row", F.monotonically_increasing_id()).join(stage(lists, "licenses"), "row", "left")
    none = F.array().cast("array<struct<license:string,dice:double>>")
    return unpacked(found, docs, licenses=F.coalesce("licenses", none))


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def oracle(templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same in DuckDB's SQL, by joining counted bigrams."""
    rows = ", ".join(f"({i}, '{name}', '{text.replace(chr(39), chr(39) * 2)}')" for i, (name, text) in enumerate(templates))
    runs = [f"list_transform(range(1, len({c}) - {n - 2}), lambda i: array_to_string({c}[i : i + {n - 1}], chr(10)))" for c in ("ls", "ps") for n in range(2, RUN + 1)]
    clean = "trim(regexp_replace(lower(x), '[^\\p{L}\\p{N}]+', ' ', 'g'))"
    return f"""
        WITH t(id, license, x) AS (VALUES {rows}),
        tw AS (SELECT id, license, string_split({clean}, ' ') AS w FROM t),
        tb AS (SELECT id, license, len(w) - 1 AS b, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM tw),
        tc AS (SELECT id, license, b, g, count(*) AS n FROM tb GROUP BY ALL),
        d AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
        l AS (SELECT doc_id, x, string_split(x, chr(10)) AS ls, regexp_split_to_array(x, '\\n[ \\t\\r]*\\n') AS ps FROM d),
        p AS (SELECT doc_id, unnest(list_concat(ls, ps, regexp_split_to_array(x, '[.!?][ \\t\\r\\n]+'), [x], {", ".join(runs)})) AS x FROM l),
        s AS (SELECT row_number() OVER () AS sid, doc_id, w FROM (SELECT DISTINCT doc_id, string_split({clean}, ' ') AS w FROM p)),
        sb AS (SELECT sid, doc_id, len(w) - 1 AS a, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM s WHERE len(w) > 1),
        sc AS (SELECT sid, doc_id, a, g, count(*) AS n FROM sb GROUP BY ALL),
        m AS (SELECT sid, doc_id, id, license, 2.0::DOUBLE * sum(least(sc.n, tc.n)) / (any_value(a) + any_value(b)) AS dice FROM sc JOIN tc USING (g) GROUP BY 1, 2, 3, 4),
        best AS (SELECT doc_id, license, max(dice) AS dice FROM m WHERE dice >= {threshold} GROUP BY 1, 2)
        SELECT doc_id, coalesce(n, 0)::BIGINT AS n_licenses, coalesce(names, '') AS licenses, coalesce(top, 0.0::DOUBLE) AS best_dice
        FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n, string_agg(license, ',' ORDER BY license) AS names, round(max(dice), 6) AS top FROM best GROUP BY 1) USING (doc_id)
    """
