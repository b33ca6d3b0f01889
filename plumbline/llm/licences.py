"""Licence scans: parts of a text compared to licence templates, in DataFrame expressions only.

A text, its paragraphs, its lines and its sentences are the parts. A part is normalised (lower case, runs of letters and
digits) and becomes the set of its word bigrams; a template matches by the Dice coefficient 2 |A and B| / (|A| + |B|).
A template of ``WINDOW`` words or more is also compared to runs of as many words anywhere in a text, whatever lines,
comment marks or code are around them, that begin with one of its bigrams.
The sizes alone bound the coefficient by 2 min / (|A| + |B|), so only templates of a size near the part's are compared.
And a match shares so many of a template's bigrams that it must hold one of a few telling words; parts, and texts, that
hold none of them need no bigrams at all, and a text's runs are looked at only if the whole text holds that many.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import documents
from plumbline.llm.spotsigs import COMMON, bind

LEAST = 0.8
#: Templates of fewer words are looked for in lines, sentences and paragraphs only.
WINDOW = 8
#: White space in the patterns that part a text.
BLANK = r"[ \t\n\f\r]"
#: Licences and their notices as they are published.
TEMPLATES = {
    "0bsd": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS
PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING
FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH
THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "agpl-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as
published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to
in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either
express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "boost-1.0": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS
IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY,
OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "bsd-3-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its
contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS
PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE
LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF
SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF
THE POSSIBILITY OF SUCH DAMAGE.""",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-nc-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0": """To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.""",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "gpl-warranty": """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.""",
    "isc-full": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY
SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION
OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "lgpl-notice": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as
published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.""",
    "mit": "Released under the MIT License.",
    "mit-full": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE
OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "mit-notice": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.""",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-2.0-notice": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with
this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "reserved": "All rights reserved.",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In
jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to
the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend
this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE
SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER
IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications,
and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you
must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would
be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the
original software. 3. This notice may not be removed or altered from any source distribution.""",
}

#: Words that hardly tell a licence from other texts.
PLAIN = {*COMMON, "all", "any", "may", "source", "under", "without"}


def bigrams(text: str) -> list[str]:
    own = re.findall(r"[a-z0-9]+", text.lower())
    return sorted({f"{a} {b}" for a, b in zip(own, own[1:], strict=False)})


def n_words(text: str) -> int:
    return len(re.findall(r"[a-z0-9]+", text.lower()))


def run_of(part: Column) -> Column:
    """The word bigrams of a part in their order."""
    words = F.regexp_extract_all(F.lower(part), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return bind(words, lambda w: F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1))))


def pairs_of(part: Column) -> Column:
    """The distinct word bigrams of a part."""
    return F.array_distinct(run_of(part))


def best_window(run: Column, own: list[str], size: int, least: float) -> Column:
    """The best coefficient of a template, given as its bigrams, with the runs of ``size`` bigrams of a text that begin with one of
    them; null if the whole text holds too few of them for any."""
    theirs = F.array(*map(F.lit, own))
    dice = lambda w: 2.0 * F.size(F.array_intersect(w, theirs)) / (F.size(w) + len(own))
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(run), F.lit(1))), lambda i: F.array_contains(theirs, F.get(run, i - 1)))
    each = F.transform(starts, lambda i: bind(F.array_distinct(F.slice(run, i, F.lit(size))), dice))
    return F.when(F.size(F.array_intersect(run, theirs)) >= least / (2 - least) * len(own) - 1e-9, F.array_max(each))


def window_matches(text: Column, templates: dict[str, str], least: float) -> Column:
    """(dice, licence) of each template of WINDOW words or more that some run of as many words is like, the best of its runs."""
    long = {name: t for name, t in sorted(templates.items()) if n_words(t) >= WINDOW}
    if not long:
        return F.array().cast("array<struct<dice:double,licence:string>>")
    of = lambda run: F.array(*[F.struct(best_window(run, bigrams(t), n_words(t) - 1, least).alias("dice"), F.lit(name).alias("licence")) for name, t in long.items()])
    return F.filter(bind(run_of(text), of), lambda m: m["dice"] >= least)


def matches(part: Column, templates: dict[str, str], least: float) -> Column:
    """(dice, licence) of each template that a part is like, as an array."""

    def of(own: Column) -> Column:
        n = F.size(own)
        found = []
        for name, text in sorted(templates.items()):
            theirs = bigrams(text)
            fits = (2 * F.least(n, F.lit(len(theirs))) >= least * (n + len(theirs))) & (n > 0)
            dice = F.when(fits, 2.0 * F.size(F.array_intersect(own, F.array(*map(F.lit, theirs)))) / (n + len(theirs)))
            found.append(F.struct(dice.alias("dice"), F.lit(name).alias("licence")))
        return F.filter(F.array(*found), lambda m: m["dice"] >= least)

    return bind(pairs_of(part), of)


def telling(templates: dict[str, str], least: float) -> list[str]:
    """Words of which every part that matches a template holds one.

    With a coefficient of least or more, a part shares least / (2 - least) of the template's bigrams at least. Words that
    stand in more of them than may be missing cannot all be missing. They are chosen greedily, and long ones and none of the
    common words where that is possible, which are rare in other texts."""
    left = {name: set(bigrams(text)) for name, text in templates.items()}
    left = {name: own for name, own in left.items() if own}
    need = {name: len(own) - math.ceil(least / (2 - least) * len(own) - 1e-9) + 1 for name, own in left.items()}
    chosen: list[str] = []
    while need:
        gain: dict[str, float] = {}
        for name, own in left.items():
            per: dict[str, int] = {}
            for b in own:
                for w in set(b.split(" ")):
                    per[w] = per.get(w, 0) + 1
            rare = {w: n for w, n in per.items() if w not in PLAIN and not w.isdigit()} or per
            for w, n in rare.items():
                gain[w] = gain.get(w, 0.0) + min(n, need[name]) / need[name] * len(w) ** 2
        best = max(sorted(gain), key=lambda w: gain[w])
        chosen.append(best)
        for name in list(need):
            with_it = {b for b in left[name] if best in b.split(" ")}
            left[name] -= with_it
            need[name] -= len(with_it)
            if need[name] <= 0:
                del need[name], left[name]
    return chosen


def parts_of(text: Column) -> Column:
    """The text, its paragraphs, its lines and its sentences, each once."""
    lines, paragraphs, sentences = F.split(text, r"\n", -1), F.split(text, rf"\n{BLANK}*\n", -1), F.split(text, rf"[.!?]{BLANK}+", -1)
    return F.array_distinct(F.concat(lines, paragraphs, sentences, F.array(text)))


def scan(df: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, licence and dice of the best match (nulls if there is none), and licences, all that match, for every row.

    The best is the one with the largest coefficient, of equal ones the first by name. A null or empty text matches
    nothing; whole texts of any length are scanned; equal rows give equal results; an empty table gives an empty result;
    other columns are ignored.
    """
    templates = TEMPLATES if templates is None else templates
    text = F.coalesce(df[text_col], F.lit(""))
    words = F.array(*map(F.lit, telling(templates, least))).cast("array<string>")
    tells = lambda part: F.arrays_overlap(F.split(F.lower(part), r"[^\p{L}\p{N}]+"), words)
    some = F.filter(parts_of(text), tells)
    parts = F.flatten(F.transform(some, lambda p: matches(p, templates, least)))
    found = F.when(tells(text), F.concat(parts, window_matches(text, templates, least))).otherwise(F.array().cast("array<struct<dice:double,licence:string>>"))
    rows = df.select(df[id_col].alias("doc_id"), found.alias("found"))
    best = F.element_at(F.array_sort(F.transform("found", lambda m: F.struct((-m["dice"]).alias("d"), m["licence"].alias("licence")))), 1)
    rows = rows.withColumn("best", F.when(F.size("found") > 0, best))
    return rows.select("doc_id", F.col("best.licence").alias("licence"), (-F.col("best.d")).alias("dice"), F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda m: m["licence"]))), ",").alias("licences"))


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))


def scan_sql(templates: dict[str, str] = TEMPLATES, least: float = LEAST) -> str:
    rows = ", ".join(f"('{name}', {n_words(text)}, [{', '.join(repr(b) for b in bigrams(text))}])" for name, text in sorted(templates.items()))
    return rf"""
WITH template(licence, m, b) AS (VALUES {rows}),
part AS (
  SELECT DISTINCT doc_id, unnest(list_concat(string_split(t, chr(10)), regexp_split_to_array(t, '\n{BLANK}*\n'), regexp_split_to_array(t, '[.!?]{BLANK}+'), [t])) AS p
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
word AS (SELECT doc_id, regexp_extract_all(lower(p), '[\p{{L}}\p{{N}}]+') AS w FROM part),
gram AS (SELECT doc_id, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS a FROM word WHERE len(w) > 1),
dice AS (
  SELECT doc_id, licence, 2.0::DOUBLE * len(list_intersect(a, b)) / (len(a) + len(b)) AS dice
  FROM gram JOIN template ON 2 * least(len(a), len(b)) >= {least} * (len(a) + len(b))),
flat AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS w FROM documents),
run AS (SELECT doc_id, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS g FROM flat WHERE len(w) > 1),
window_dice AS (
  SELECT doc_id, licence, list_max(list_transform(list_filter(range(1, len(g) + 1), lambda i: list_contains(b, g[i])),
    lambda i: 2.0::DOUBLE * len(list_intersect(list_distinct(g[i:i + m - 2]), b)) / (len(list_distinct(g[i:i + m - 2])) + len(b)))) AS dice
  FROM run JOIN template ON m >= {WINDOW} AND len(list_intersect(list_distinct(g), b)) >= {least / (2 - least)} * len(b) - 1e-9),
good AS (SELECT doc_id, licence, max(dice) AS dice FROM (FROM dice UNION ALL FROM window_dice) WHERE dice >= {least} GROUP BY ALL),
best AS (SELECT doc_id, arg_min(licence, (-dice, licence)) AS licence, max(dice) AS dice, string_agg(licence, ',' ORDER BY licence) AS licences FROM good GROUP BY doc_id)
SELECT doc_id, licence, dice, coalesce(licences, '') AS licences FROM documents LEFT JOIN best USING (doc_id)"""
