"""License scans: TF-IDF cosine to templates, then inheritance down directories.

The units of a text are its lines, its blocks of ``BLOCKS`` consecutive lines (a
header is often wrapped), and the whole.  Every unit is a sparse TF-IDF vector;
the weights come from the templates (whole licences, their usual headers, short
notices, SPDX lines), words that no template has weigh as the rarest, and
function words and years are left out.  A file's own license is that of its best
unit with a cosine of ``THRESHOLD`` at least, provided that it shares ``SHARED``
different words with the template.  A license file, told by its name alone,
speaks for its directory and all below it that have none of their own nearer by:
files without own license inherit from the nearest ancestor directory, found by
joining paths.

Units are looked at only if they have an *anchor*, a word of a template that is
chosen such that no unit without anchors can reach the threshold (:func:`anchors`).
A unit's vector is made within its row; by Cauchy and Schwarz only units whose
known words carry the threshold's share of the norm can reach it, and only these
are joined to the templates' weights.  Only DataFrame functions are used.  The
templates are a fixed table, so their broadcast is bounded.

Nulls, empties and the rest: a null text has no license of its own but
inherits; a null path or repository is the root directory of a repository
without name; very long texts are taken whole; of equal scores the license first
by name counts, of several license files in a directory the better match; rows
that repeat are reported one by one; columns that clash with names used here are
not read; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdatrace.llm.common import BROADCAST_KEYS, settle

#: Cosine from which on a text is taken for a template's.
THRESHOLD = 0.75
#: Different words that a text and a template must share.
SHARED = 2
#: Lines of a block.
BLOCKS = (1, 2, 3, 4, 6, 8, 12)
#: Parts that the files of one directory are dealt over where directories are too many to broadcast.
PARTS = 32
#: Name of a license file; its directory takes its license whatever else it says.
LICENSE_FILE = r"(?i)(^|/)(licen[cs]e|copying|unlicense)([._-][^/]*)?$"

# Licence texts, their usual headers, and short notices by which licences are given, by SPDX name.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"""
_MIT_REST = """The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"""
_APACHE_REST = """Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."""
_GPL_REST = """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details.
You should have received a copy of the {name} along with this program. If not, see <https://www.gnu.org/licenses/>."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."""
_GNU = {"GPL": "GNU General Public License", "LGPL": "GNU Lesser General Public License", "AGPL": "GNU Affero General Public License"}
_SPDX = "0BSD AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC0-1.0 EPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MIT MPL-2.0 Unlicense Zlib".split()
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", f"{_APACHE} {_APACHE_REST}"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("MIT", "Released under the MIT License"),
    ("MIT", _MIT),
    ("MIT", f"MIT License {_MIT} {_MIT_REST}"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    *((f"{short}-{version}", _GPL.format(name=name, version=v)) for short, name in _GNU.items() for v, version in ((("3", "3.0"), ("2", "2.0")) if short == "GPL" else (("3", "3.0"), ("2.1", "2.1")) if short == "LGPL" else (("3", "3.0"),))),
    *((f"{short}-3.0", f"{_GPL.format(name=name, version='3')} {_GPL_REST.format(name=name)}") for short, name in _GNU.items()),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-2-Clause", _BSD_2),
    ("BSD-2-Clause", f"BSD 2-Clause License {_BSD_2} {_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD_2} {_BSD_3}"),
    ("BSD-3-Clause", f"BSD 3-Clause License {_BSD_2} {_BSD_3} {_BSD_END}"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("MPL-2.0", _MPL),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0"),
    ("ISC", "Released under the ISC License"),
    ("ISC", f"ISC License {_ISC}"),
    ("Zlib", _ZLIB),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("Unlicense", _UNLICENSE),
    ("Proprietary", "All rights reserved"),
    ("Proprietary", "Copyright. All rights reserved. Unauthorized copying of this file is strictly prohibited"),
    *((x.removesuffix("-only").removesuffix("-or-later"), f"SPDX-License-Identifier: {x}") for x in _SPDX),
)
# Function words, which are no terms, as years are none.
STOP_WORDS = "a an and any are as at be by can do for from if in into is it may not of on or other that the they this to under use used was were will with you your".split()
_TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
_YEAR = "^(19|20)[0-9][0-9]$"


def terms_of(text: str) -> list[str]:
    """Terms of a text, repeats included."""
    return [t for t in re.findall(_TERM, text.lower()) if t not in STOP_WORDS and not re.match(_YEAR, t)]


def template_weights() -> tuple[list[tuple[int, str, str, float]], dict[str, float], float]:
    """Rows (template, license, term, weight), inverse document frequencies, and that of unknown words."""
    counts = [Counter(terms_of(text)) for _, text in TEMPLATES]
    seen = Counter(t for c in counts for t in c)
    idf = {t: math.log((1 + len(TEMPLATES)) / (1 + n)) + 1 for t, n in seen.items()}
    rows = []
    for k, ((name, _), c) in enumerate(zip(TEMPLATES, counts, strict=True)):
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in c.items()))
        rows += [(k, name, t, n * idf[t] / norm) for t, n in sorted(c.items())]
    return rows, idf, math.log(1 + len(TEMPLATES)) + 1


def anchors() -> list[str]:
    """Words of which a text has one at least if it shares ``SHARED`` words with a template and its cosine to it reaches the threshold.

    By Cauchy and Schwarz the cosine of a text without anchors is at most the
    norm of the template's other words, which is kept below the threshold, unless
    too few are left to be shared; long words go first, which are rare in other texts.
    """
    rows, _, _ = template_weights()
    own: dict[int, list[tuple[str, float]]] = {}
    for k, _, t, w in rows:
        own.setdefault(k, []).append((t, w))
    chosen: set[str] = set()
    for k in sorted(own, key=lambda k: len(own[k])):
        left = [x for x in sorted(own[k], key=lambda x: (-len(x[0]), x[0])) if x[0] not in chosen]
        while len(left) >= SHARED and math.sqrt(sum(w * w for _, w in left)) >= THRESHOLD - 1e-9:
            chosen.add(left.pop(0)[0])
    return sorted(chosen)


def anchor_pattern() -> str:
    return r"(?i)(?<![a-z0-9])(?:" + "|".join(re.escape(a) for a in anchors()) + r")(?![a-z0-9])"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def units(t: Column) -> Column:
    """Lines and blocks of a text that have an anchor, and the whole text, as one array."""
    pattern = anchor_pattern()

    def blocks(lines: Column, marked: Column) -> Column:
        def of(w: int) -> Column:
            starts = F.filter(F.sequence(F.lit(1), F.size(lines) - (w - 1)), lambda i: F.exists(F.slice(marked, i, w), lambda x: x))
            return F.when(F.size(lines) >= w, F.transform(starts, lambda i: F.array_join(F.slice(lines, i, w), "\n"))).otherwise(F.array().cast("array<string>"))

        return F.concat(*(of(w) for w in BLOCKS), F.array(t))

    return _let(F.split(t, "\n"), lambda lines: _let(F.transform(lines, lambda x: x.rlike(pattern)), lambda marked: blocks(lines, marked)))


def vector(unit: Column, weight_of: dict[str, float], unknown: float) -> Column:
    """Known terms of a text with their values (``known``), and the sums of squares of these (``own``) and of all others (``other``)."""
    vocabulary, idf = sorted(weight_of), F.create_map(*(F.lit(x) for t in sorted(weight_of) for x in (t, weight_of[t])))
    square = lambda a, of: F.aggregate(a, F.lit(0.0), lambda s, x: s + of(x) * of(x))

    def runs(terms: Column, first: Column) -> Column:
        """Equal terms stand together, so the places where a term begins give its number."""
        return F.zip_with(first, F.concat(F.slice(first, F.lit(2), F.size(first)), F.array(F.size(terms))), lambda a, b: F.struct(F.get(terms, a).alias("term"), (b - a).cast("double").alias("n")))

    def sums(of: Column) -> Column:
        known = F.transform(F.filter(of, lambda x: x["term"].isin(vocabulary)), lambda x: F.struct(x["term"].alias("term"), (x["n"] * F.element_at(idf, x["term"])).alias("v")))
        other = square(F.filter(of, lambda x: ~x["term"].isin(vocabulary)), lambda x: x["n"]) * unknown**2
        return _let(known, lambda k: F.struct(k.alias("known"), square(k, lambda x: x["v"]).alias("own"), other.alias("other")))

    places = lambda terms: F.filter(F.sequence(F.lit(0), F.size(terms) - 1), lambda i: (i == 0) | (F.get(terms, i) != F.get(terms, i - 1)))
    terms = F.array_sort(F.filter(F.regexp_extract_all(F.lower(unit), F.lit(_TERM), F.lit(0)), lambda x: ~x.isin(STOP_WORDS) & ~x.rlike(_YEAR)))
    return _let(terms, lambda ts: F.when(F.size(ts) > 0, _let(places(ts), lambda first: _let(runs(ts, first), sums))))


def _best(files: DataFrame) -> DataFrame:
    """Best template of each row, by cosine: ``row``, ``license``, ``score`` (from the threshold up)."""
    rows, idf, unknown = template_weights()
    weights = F.broadcast(files.sparkSession.createDataFrame(rows, "template int, license string, term string, w double"))
    enough = lambda x: x.isNotNull() & (F.size(x["known"]) >= SHARED) & (x["own"] >= (THRESHOLD - 1e-6) ** 2 * (x["own"] + x["other"]))
    each = files.select("row", F.posexplode(F.filter(F.transform(units(F.col("t")), lambda u: vector(u, idf, unknown)), enough)).alias("unit_id", "x"))
    dots = each.select("row", "unit_id", F.sqrt(F.col("x.own") + F.col("x.other")).alias("norm"), F.explode("x.known").alias("y")).select("row", "unit_id", "norm", F.col("y.term").alias("term"), F.col("y.v").alias("v")).join(weights, "term")
    cosine = dots.groupBy("row", "unit_id", "norm", "template", "license").agg(F.sum(F.col("v") * F.col("w")).alias("dot"), F.count("*").alias("shared")).where(F.col("shared") >= SHARED).select("row", "license", F.round(F.col("dot") / F.col("norm"), 9).alias("score"))
    return cosine.where(F.col("score") >= THRESHOLD).groupBy("row").agg(F.min(F.struct(-F.col("score"), F.col("license"))).alias("b")).select("row", F.col("b.license").alias("own_license"), (-F.col("b.col1")).alias("own_score"))


def scan(files: DataFrame, key: Column, repo: Column, path: Column, text: Column) -> DataFrame:
    """One row a file: ``key``, ``path``, ``own_license``, ``own_score``, ``is_license_file``, ``inherited_license``, ``license``."""
    full = F.concat_ws("/", F.coalesce(repo.cast("string"), F.lit("")), F.coalesce(path.cast("string"), F.lit("")))
    rows = files.select(F.monotonically_increasing_id().alias("row"), key.alias("key"), full.alias("path"), text.alias("t"))
    # Texts without an anchor can't reach the threshold, be it by a part or as a whole.
    slim, _ = settle(rows.select("row", "key", "path", F.when(F.col("t").rlike(anchor_pattern()), F.col("t")).alias("t")), "licenses")
    own = slim.select("row", "key", "path").join(_best(slim.where("t IS NOT NULL")), "row", "left")
    own = own.select("row", "key", "path", "own_license", "own_score", (F.col("path").rlike(LICENSE_FILE) & F.col("own_license").isNotNull()).alias("is_license_file"), F.regexp_replace("path", "/[^/]*$", "").alias("dir"))
    own, _ = settle(own, "licensed")
    speaks = own.where("is_license_file").groupBy("dir").agg(F.min(F.struct(-F.col("own_score"), F.col("own_license"))).alias("s")).select(F.col("dir").alias("above"), F.col("s.own_license").alias("of_dir"))
    # Each directory asks its ancestors once, however many files it holds.
    parts = F.split("dir", "/")
    asking = own.select("dir").distinct().select("dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("above")))).alias("a")).select("dir", "a.depth", "a.above")
    nearest = asking.join(speaks, "above").groupBy("dir").agg(F.max_by("of_dir", "depth").alias("inherited_license"))
    # One directory may hold a third of all files, so files are not dealt by directory alone: few directories, by their
    # count, are broadcast; many are repeated for each of the parts that a directory's files are dealt over.
    nearest, _ = settle(nearest, "directories")
    if nearest.count() <= BROADCAST_KEYS:
        joined = own.join(F.broadcast(nearest), "dir", "left")
    else:
        parted = nearest.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        joined = own.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(PARTS)).cast("int")).join(parted, ["dir", "part"], "left")
    return joined.select("key", "path", "own_license", "own_score", "is_license_file", "inherited_license", F.coalesce("own_license", "inherited_license").alias("license"))
