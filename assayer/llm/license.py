"""Licence scans: Dice coefficient over word bigrams against licence templates.

A text is normalised to its lower-case ASCII words and numbers.  Its units are all runs of
consecutive words, so notices within a sentence, lines, paragraphs and licences of many paragraphs
are found alike, however the text is laid out; a unit is compared as the set of its word bigrams.
Templates are pruned by size: with Dice at least t, a unit of n bigrams can only match templates
of n * t / (2 - t) to n * (2 - t) / t bigrams, and a template of s bigrams shares at least
s * t / (2 - t) of them with the whole text.

``license_lines`` counts the lines that match a template as they stand.

Defined results: null and empty texts match nothing; units of fewer than two words match
nothing; equal scores go to the template whose licence comes first by name; repeated rows are
rows of their own; very long texts are scanned whole, a run of words only as far as a template
can reach; an empty table gives no rows; extra columns are carried along by :func:`scan`, which
replaces those of its results' names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from importlib.resources import files

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import bounded_batches, table

THRESHOLD = 0.8
_WORD = re.compile(r"[a-z0-9]+")

#: Names by which notices refer to licences.
NAMES = {
    "AGPL-3.0": ["GNU Affero General Public License, version 3"],
    "Apache-2.0": ["Apache License, Version 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "GPL-2.0": ["GNU General Public License, version 2"],
    "GPL-3.0": ["GNU General Public License, version 3"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3"],
    "MIT": ["MIT License"],
    "MPL-2.0": ["Mozilla Public License, version 2.0"],
}
#: Ways a one-line notice is put.
NOTICES = ["Licensed under {0}", "Licensed under the {0}", "Released under the {0}", "Distributed under the {0}", "This work is licensed under the {0}", "This work is licensed under a {0}", "This program is released under the terms of the {0}"]
#: The header of the GNU licences, by name and version.
_GNU = "This program is free software{2} you can redistribute it and/or modify it under the terms of the {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {0} for more details."
#: The BSD licences, whose third condition is the argument.
_BSD = 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. {0}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
#: Longer texts, word for word.
TEXTS = {
    "AGPL-3.0": [_GNU.format("GNU Affero General Public License", 3, ":")],
    "Apache-2.0": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
    ],
    "BSD-2-Clause": [_BSD.format("")],
    "BSD-3-Clause": [_BSD.format("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. ")],
    "GPL-2.0": [_GNU.format("GNU General Public License", 2, ";")],
    "GPL-3.0": [_GNU.format("GNU General Public License", 3, ":")],
    "ISC": [
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
    ],
    "LGPL-3.0": [_GNU.format("GNU Lesser General Public License", 3, ":")],
    "MIT": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ],
    "0BSD": [
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
    ],
    "BSL-1.0": [
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
    ],
    "Proprietary": ["All rights reserved."],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
    ],
}


def templates() -> list[tuple[str, str]]:
    """(licence, template text): each notice with each name, the longer texts, and the whole ones of the folder ``licences``."""
    out = {(lic, n.format(name)) for lic, names in NAMES.items() for name in names for n in NOTICES}
    whole = {(p.name.removesuffix(".txt"), p.read_text()) for p in files("assayer.llm").joinpath("licences").iterdir()}
    return sorted(out | whole | {(lic, t) for lic, texts in TEXTS.items() for t in texts})


def bigrams(text: str) -> set[tuple[str, str]]:
    words = _WORD.findall(text.lower())
    return set(zip(words, words[1:]))


class Matcher:
    """Templates by size, with an index from bigrams, so that only sharing pairs are compared."""

    def __init__(self, pairs: list[tuple[str, str]], threshold: float):
        self.threshold = threshold
        self.sets = [(lic, bigrams(t)) for lic, t in pairs]
        self.index: dict[tuple[str, str], list[int]] = {}
        for k, (_, s) in enumerate(self.sets):
            for g in s:
                self.index.setdefault(g, []).append(k)
        sizes = [len(s) for _, s in self.sets]
        self.least = min(sizes) * threshold / (2 - threshold) - 1e-9
        self.most = max(sizes) * (2 - threshold) / threshold + 1e-9
        self.words = {w for g in self.index for w in g}
        self.grams = set(self.index)
        self.need = [n * threshold / (2 - threshold) - 1e-9 for n in sizes]

    def best(self, words: list[str]) -> tuple[float, str] | None:
        """The highest Dice and its licence, for a unit's normalised words."""
        if len(words) - 1 < self.least:
            return None
        known = self.words
        if sum([w in known for w in words]) < 2:
            return None
        own = set(zip(words, words[1:]))
        n = len(own)
        if not self.least <= n <= self.most:
            return None
        shared = Counter(k for g in own if g in self.index for k in self.index[g])
        found = None
        for k, c in shared.items():
            lic, s = self.sets[k]
            t = self.threshold
            if not n * t / (2 - t) - 1e-9 <= len(s) <= n * (2 - t) / t + 1e-9:
                continue
            dice = 2 * c / (n + len(s))
            if dice >= t and (found is None or (-dice, lic) < (-found[0], found[1])):
                found = dice, lic
        return found


class Runs:
    """The runs of consecutive words of a text, as bigrams."""

    def __init__(self, words: list[str], m: Matcher):
        self.grams = list(zip(words, words[1:]))
        self.known = [(p, g) for p, g in enumerate(self.grams) if g in m.grams]

    def best(self, s: set[tuple[str, str]], threshold: float, over: float = 0.0) -> float:
        """The highest Dice of a run with a template's bigrams, or 0 if it is below the threshold or not over ``over``.

        A best run begins with a bigram of the template that does not come again in it: without
        that bigram, the run would be as good.  A run ends before its first bigram comes again,
        or when it has too many others; and no start is tried when those of the template from there on are
        too few for a better run.
        """
        grams, end = self.grams, len(self.grams)
        again: dict[tuple[str, str], int] = {}
        starts = []
        for p, g in reversed(self.known):
            if g in s:
                stop = again.get(g, end)
                again[g] = p
                starts.append((p, stop, 2 * len(again) / (len(again) + len(s))))
        size, found = len(s), 0.0
        most = size * (2 - threshold) / threshold + 1e-9
        for p, stop, bound in reversed(starts):
            if bound < threshold or bound < over or bound <= found:
                break
            own: set[tuple[str, str]] = set()
            shared = 0
            for g in grams[p:stop] if stop - p <= most else _stepwise(grams, p, stop):
                if g in own:
                    continue
                own.add(g)
                if g in s:
                    shared += 1
                    found = max(found, 2 * shared / (len(own) + size))
                    if shared == size:
                        break
                elif len(own) > most:
                    break
        return found if found >= threshold else 0.0


def _stepwise(grams: list[tuple[str, str]], start: int, stop: int) -> Iterator[tuple[str, str]]:
    """A slice of a long list, without copying what will not be looked at."""
    for p in range(start, stop):
        yield grams[p]


def scan_text(text: str, m: Matcher) -> tuple[str | None, float, int]:
    """Best licence (or None), its Dice (or 0), and the number of lines that match some."""
    words = _WORD.findall(text.lower())
    runs = Runs(words, m)
    shared = Counter(k for g in {g for _, g in runs.known} for k in m.index[g])
    close = [(2 * c / (c + len(m.sets[k][1])), k) for k, c in shared.items() if c >= m.need[k]]
    if not close:
        return None, 0.0, 0
    best = None
    for bound, k in sorted(close, reverse=True):
        lic, s = m.sets[k]
        if best and bound < best[0]:
            break
        dice = runs.best(s, m.threshold, best[0] if best else 0.0)
        if dice and (best is None or (-dice, lic) < (-best[0], best[1])):
            best = dice, lic
    lines_hit = sum(m.best(_WORD.findall(line.lower())) is not None for line in text.split("\n"))
    return (best[1], best[0], lines_hit) if best else (None, 0.0, lines_hit)


def scan(docs: DataFrame, threshold: float = THRESHOLD, text_col: str = "text", pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """All columns of ``docs`` with ``license``, ``dice`` and ``license_lines`` added, in place of any of those names."""
    bounded_batches(docs.sparkSession)
    pairs = pairs or templates()

    @F.pandas_udf("license string, dice double, license_lines int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = Matcher(pairs, threshold)
        for texts in batches:
            got = [scan_text(t or "", m) for t in texts]
            yield pd.DataFrame({"license": pd.Series([g[0] for g in got], dtype=object), "dice": [float(g[1]) for g in got], "license_lines": [g[2] for g in got]})

    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("license", "dice", "license_lines")]
    return docs.select(*rest, run(F.col(f"`{text_col}`")).alias("_license_")).select(*rest, "_license_.*")


def license_report(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def oracle() -> str:
    """All runs of words against all templates in DuckDB SQL.

    A run's bigrams are new where they have not come since its start; it starts with one of the
    template's and ends before that comes again, as a run that repeats its first bigram is as good without it.
    """
    quoted = ", ".join("('" + lic + "', '" + t.replace("'", "''") + "')" for lic, t in templates())
    return rf"""
WITH t(lic, txt) AS (VALUES {quoted}),
tw AS (SELECT lic, row_number() OVER (ORDER BY lic, txt) AS k, regexp_extract_all(lower(txt), '[a-z0-9]+') AS ws FROM t),
tb AS MATERIALIZED (SELECT DISTINCT lic, k, ws[i] || ' ' || ws[i + 1] AS g FROM (SELECT lic, k, ws, unnest(generate_series(1, len(ws) - 1)) AS i FROM tw)),
ts AS MATERIALIZED (SELECT k, lic, COUNT(*) AS n FROM tb GROUP BY ALL),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
dw AS (SELECT r, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM docs),
wb AS MATERIALIZED (SELECT r, p, g, lag(p) OVER w AS before, lead(p) OVER w AS again FROM (SELECT r, i AS p, ws[i] || ' ' || ws[i + 1] AS g FROM (SELECT r, ws, unnest(generate_series(1, len(ws) - 1)) AS i FROM dw)) WINDOW w AS (PARTITION BY r, g ORDER BY p)),
m AS MATERIALIZED (SELECT wb.r, tb.k, wb.p, wb.again FROM wb JOIN tb USING (g)),
c AS MATERIALIZED (SELECT m.r, m.k, ts.lic, ts.n FROM m JOIN ts USING (k) GROUP BY ALL HAVING COUNT(*) FILTER (WHERE m.again IS NULL) >= ts.n * {THRESHOLD}::DOUBLE / (2 - {THRESHOLD}::DOUBLE) - 1e-9),
q AS MATERIALIZED (SELECT c.r, c.k, c.lic, c.n, wb.p, wb.before, tb.g IS NOT NULL AS hit FROM c JOIN wb USING (r) LEFT JOIN tb ON tb.k = c.k AND tb.g = wb.g),
runs AS (
  SELECT q.r, q.lic, q.n, q.hit, COUNT(*) OVER w AS own, COUNT(*) FILTER (WHERE q.hit) OVER w AS shared
  FROM (SELECT m.* FROM m JOIN c USING (r, k)) s JOIN q ON q.r = s.r AND q.k = s.k AND q.p >= s.p AND (s.again IS NULL OR q.p < s.again) AND (q.before IS NULL OR q.before < s.p)
  WINDOW w AS (PARTITION BY s.r, s.k, s.p ORDER BY q.p)
),
d AS (SELECT r, lic, max(2.0::DOUBLE * shared / (own + n)) AS dice FROM runs WHERE hit GROUP BY r, lic),
best AS (SELECT * FROM d WHERE dice >= {THRESHOLD}::DOUBLE QUALIFY row_number() OVER (PARTITION BY r ORDER BY dice DESC, lic) = 1),
lw AS (SELECT r, row_number() OVER () AS u, regexp_extract_all(lower(line), '[a-z0-9]+') AS ws FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs)),
lb AS MATERIALIZED (SELECT DISTINCT r, u, ws[i] || ' ' || ws[i + 1] AS g FROM (SELECT r, u, ws, unnest(generate_series(1, len(ws) - 1)) AS i FROM lw)),
ln AS MATERIALIZED (SELECT r, u, COUNT(*) AS n FROM lb GROUP BY ALL),
x AS MATERIALIZED (SELECT lb.r, lb.u, tb.k, COUNT(*) AS c FROM lb JOIN tb USING (g) GROUP BY ALL),
hits AS (SELECT x.r, COUNT(DISTINCT x.u) AS k FROM x JOIN ln USING (r, u) JOIN ts USING (k) WHERE 2.0::DOUBLE * x.c / (ln.n + ts.n) >= {THRESHOLD}::DOUBLE GROUP BY x.r)
SELECT o.doc_id, b.lic AS license, COALESCE(b.dice, 0.0::DOUBLE) AS dice, CAST(COALESCE(h.k, 0) AS INTEGER) AS license_lines
FROM docs o LEFT JOIN best b USING (r) LEFT JOIN hits h USING (r)
"""
