"""Licence scan by Dice coefficient over word bigrams, in DataFrame operations only.

Text is normalised (lower case, everything but letters and digits as one
space). Units are every line, the text as a whole, and, for each template, all
windows of as many words as the template has, wherever they begin and lines
break; so wrapped, commented and embedded notices are found. Only windows that hold enough of the
template's bigrams, repeats counted, are compared; their starts follow from the places
of those bigrams, so no window that matches is left out. A unit's set of distinct word bigrams is compared with the template's.
Size bounds prune templates: with a Dice coefficient of t or more, the sizes a
and b obey t / (2 - t) <= a / b <= (2 - t) / t, and at least t / (2 - t) of the
template's bigrams are shared. So a text without any of the words that stand for
enough of a template's bigrams is skipped before bigrams are built, and a
template of whose bigrams the text has too few has no windows.

Null, empty and one-word units have no bigram and match nothing; an empty table
gives no rows. Long texts are scanned whole, in time by their length. Repeated
rows are scanned each for itself. Of templates of one licence, and of windows
with equal coefficients, the best counts. Columns but ``doc_id`` and ``text``
are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import let

#: Least Dice coefficient of a match.
LEAST = 0.8

# Licence notices as they commonly stand in texts.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("all-rights-reserved", "All rights reserved."),
    (
        "MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    (
        "ISC",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "BSD-2-Clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    (
        "BSD-3-Clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
        3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    (
        "Apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ),
    (
        "GPL-3.0",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
        This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
        You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    ),
    (
        "GPL-2.0",
        """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.
        This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
        You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.""",
    ),
    (
        "Zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
        Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
        1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
        2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
        3. This notice may not be removed or altered from any source distribution.""",
    ),
    (
        "MPL-2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    ),
)


def normal_words(text: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def template_bigrams(text: str) -> list[str]:
    w = normal_words(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})


def anchors(bigrams: list[str], least: float) -> set[str]:
    """Words of which a matching unit has one: of so many bigrams that not all can be missing, the rarer (longer) word."""
    missing = len(bigrams) - math.ceil(least / (2 - least) * len(bigrams) - 1e-9)
    best = sorted(bigrams, key=lambda b: -max(map(len, b.split())))[: missing + 1]
    return {max(b.split(), key=len) for b in best}


def scan(docs: DataFrame, templates=TEMPLATES, least: float = LEAST) -> DataFrame:
    """doc_id, n_units (matching lines, or the text), n_windows (matching windows, overlapping ones each), licences
    (sorted, comma-joined), best (the largest coefficient; null if none)."""
    grams = [(name, len(normal_words(t)), template_bigrams(t)) for name, t in templates]
    low, high = least / (2 - least), (2 - least) / least
    listed = lambda values: F.array(*[F.lit(x) for x in values])
    wanted = listed(sorted(set().union(*(anchors(g, least) for *_, g in grams))))
    norm = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}\n]+", " ")
    rows = docs.select("doc_id", norm.alias("norm")).withColumn("found", F.arrays_overlap(F.split("norm", r"[ \n]+"), wanted))

    def pairs(w):
        """The bigrams of words, in order; null if there is none."""
        return F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.get(w, i - 1), F.get(w, i))))

    def scored(name, g, b):
        """(licence, Dice coefficient) if the set of bigrams is within the template's size bounds."""
        within = F.size(b).between(math.ceil(low * len(g) - 1e-9), math.floor(high * len(g) + 1e-9))
        dice = 2.0 * F.size(F.array_intersect(b, listed(g))) / (F.size(b) + len(g))
        return F.struct(F.lit(name).alias("licence"), F.when(within, dice).alias("dice"))

    enough = lambda a: F.filter(a, lambda x: x["dice"] >= least)
    no_match = F.array().cast("array<struct<licence:string,dice:double>>")
    of_unit = lambda b: enough(F.array(*[scored(name, g, b) for name, _, g in grams]))

    def windows(name, n, g, b, own):
        """The template's matches among all windows of its length over the bigrams ``b``; ``own`` has them without repeats."""
        need, last = math.ceil(low * len(g) - 1e-9), F.greatest(F.size(b) + 1 - n, F.lit(0))

        def starts(p):
            """Starts of the windows with ``need`` of the template's bigrams or more, from their places: for each place the starts after
            the place before it, up to it, from which a window reaches the ``need``-th place from there."""
            reach = lambda j: F.greatest(F.get(p, j + need - 1) - (n - 2), F.coalesce(F.get(p, j - 1) + 1, F.lit(0)), F.lit(0))
            until = lambda j: F.least(F.get(p, j), last)
            return F.flatten(F.transform(F.sequence(F.lit(0), F.size(p) - need), lambda j: F.when(reach(j) <= until(j), F.sequence(reach(j), until(j))).otherwise(F.array().cast("array<int>"))))

        places = F.filter(F.sequence(F.lit(0), F.size(b) - 1), lambda i: F.array_contains(listed(g), F.get(b, i)))
        found = let(places, lambda p: F.transform(starts(p), lambda at: let(F.array_distinct(F.slice(b, at + 1, F.lit(n - 1))), lambda d: scored(name, g, d))))
        many = F.size(F.array_intersect(own, listed(g))) >= need
        return F.when(many, enough(found)).otherwise(no_match)

    def of_text(b):
        return F.when(b.isNotNull(), let(F.array_distinct(b), lambda own: F.flatten(F.array(*[windows(name, n, g, b, own) for name, n, g in grams])))).otherwise(no_match)

    split = lambda unit: F.filter(F.split(unit, " "), lambda x: x != "")
    lines, whole = F.split("norm", "\n"), F.translate("norm", "\n", " ")
    units = F.when(F.size(lines) > 1, F.concat(lines, F.array(whole))).otherwise(lines)
    matches = F.filter(F.transform(F.filter(units, lambda u: F.arrays_overlap(F.split(u, " "), wanted)), lambda u: let(F.array_distinct(let(split(u), pairs)), of_unit)), lambda m: F.size(m) > 0)
    hit = rows.select("doc_id", F.when(F.col("found"), matches).otherwise(F.array()).alias("m"), F.when(F.col("found"), let(let(split(whole), pairs), of_text)).otherwise(no_match).alias("w"))
    flat = hit.select("doc_id", F.size("m").cast("long").alias("n_units"), F.size("w").cast("long").alias("n_windows"), F.concat(F.flatten("m"), "w").alias("all"))
    return flat.select(
        "doc_id",
        "n_units",
        "n_windows",
        F.array_join(F.array_sort(F.array_distinct(F.transform("all", lambda x: x["licence"]))), ",").alias("licences"),
        F.array_max(F.transform("all", lambda x: x["dice"])).alias("best"),
    )


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


ORACLE = rf"""
with t as (select * from (values {", ".join(f"({i}, {_sql(n)}, {len(normal_words(x))}, [{', '.join(map(_sql, template_bigrams(x)))}])" for i, (n, x) in enumerate(TEMPLATES))}) as v(tid, licence, n, grams)),
d as (select row_number() over () as r, doc_id, regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g') as norm from documents),
parts as (select r, string_split(norm, chr(10)) as lines, translate(norm, chr(10), ' ') as whole from d),
u as (select r, unnest(case when len(lines) > 1 then lines || [whole] else lines end) as unit from parts),
n as (select row_number() over () as k, r, list_filter(string_split(unit, ' '), lambda x: x <> '') as w from u),
g as (select k, r, list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) as b from n where len(w) > 1),
m as (select g.k, g.r, licence, 2.0::double * len(list_intersect(b, grams)) / (len(b) + len(grams)) as dice from g, t where len(b) <= 2 * len(grams) and 2 * len(b) >= len(grams)),
ww as (select r, list_filter(string_split(whole, ' '), lambda x: x <> '') as w from parts),
wb as (select r, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))] as b from ww where len(w) > 1),
pick as (select r, tid, licence, n, grams, b, greatest(len(b) + 1 - n, 0) as final from wb, t where 3 * len(list_intersect(list_distinct(b), grams)) >= 2 * len(grams)),
st as (select *, unnest(range(0, final + 1)) as pos from pick),
wd as (select r, licence, grams, list_distinct(b[pos + 1 : pos + n - 1]) as own from st),
wm as (select r, licence, 2.0::double * len(list_intersect(own, grams)) / (len(own) + len(grams)) as dice from wd),
h as (select r, count(distinct k) as n_units, sum(win) as n_windows, string_agg(distinct licence, ',' order by licence) as licences, max(dice) as best
  from (select r, k, licence, dice, 0 as win from m where dice >= {LEAST} union all select r, null, licence, dice, 1 from wm where dice >= {LEAST}) group by r)
select d.doc_id, cast(coalesce(n_units, 0) as bigint) as n_units, cast(coalesce(n_windows, 0) as bigint) as n_windows, coalesce(licences, '') as licences, best from d left join h using (r)
"""
