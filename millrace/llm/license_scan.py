"""License scans: Dice coefficient over word bigrams against licence templates, DataFrame functions only.

Segments of a text are its lines, the sentences of lines that have several, its paragraphs of several lines (up
to a blank line), runs of up to ``RUN`` consecutive paragraphs, and the whole text if it has several paragraphs.  A segment
with a different bigrams can reach Dice ``t`` only with templates of a*t/(2-t) to a*(2-t)/t bigrams, so candidates are joined
on the segment's size.  At Dice 0.8 two thirds of a template's bigrams are in the segment.  So texts are passed over, before anything
is split, that have none of the stems that more than a third of each template's bigrams hold; and segments
leave, before any bigram is built, that have too few words, or none of the words that hold as many.

A text's licence is the best match; the bare reservation of rights counts only where nothing else matches.

A null or empty text has no segment and matches nothing; a tie goes to the first name; long texts are scanned whole;
a licence of more than ``RUN`` paragraphs inside a longer text is found by parts of it alone; repeated rows are each
reported; other columns are not read, whatever their names; an empty table gives no row.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_id_of, keyed

THRESHOLD = 0.8
#: Paragraphs in a row that are compared together.
RUN = 8
#: Parts of words that most notices have; ``stems_of`` adds what other templates need.
STEMS = ("licen", "under", "copyright", "software", "permission", "distribut", "warrant")
#: Letters of a word that is no stem by itself.
SHORT_WORD = 4
RESERVED = "all-rights-reserved"

_GPL_REST = " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} for more details. You should have received a copy of the GNU {} along with this program. If not, see <https://www.gnu.org/licenses/>."
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_MIT_REST = " THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_IF = ", provided that the above copyright notice and this permission notice appear in all copies."
_ISC_REST = " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_REST = " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
_APACHE_REST = " Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
_UNLICENSE = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."


def _gnu(name: str, version: str, later: str, separator: str = ":") -> list[str]:
    """The notice of a GNU licence, short and in full."""
    notice = f"This program is free software{separator} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation{',' if separator == ':' else ';'} either version {version} of the License, or (at your option) {later}."
    return [notice, notice + _GPL_REST.format(name, name)]


def _short(*names: str) -> list[str]:
    """One-line notices of a licence."""
    return [f"{verb} under {name}." for name in names for verb in ("Licensed", "Released", "Distributed")]


def _spdx(name: str) -> list[str]:
    """The line of a source file that names its licence."""
    return [f"SPDX-License-Identifier: {name}" + end for end in (("-only", "-or-later") if "GPL" in name else ("",))]


# Licence notices and short licences as published, by SPDX name.
TEMPLATES = {
    "0BSD": [_ISC + "." + _ISC_REST],
    "AGPL-3.0": _gnu("Affero General Public License", "3", "any later version"),
    "Apache-2.0": [*_short("the Apache License, Version 2.0"), _APACHE, _APACHE + _APACHE_REST],
    "BSD-2-Clause": [*_short("the BSD 2-Clause License"), _BSD, _BSD + _BSD_REST],
    "BSD-3-Clause": [*_short("the BSD 3-Clause License"), _BSD + _BSD_THIRD, _BSD + _BSD_THIRD + _BSD_REST],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"],
    "CC-BY-4.0": [*_short("CC BY 4.0"), "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": [*_short("CC BY-NC 4.0"), "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": [*_short("CC BY-SA 4.0"), "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "GPL-2.0": [*_short("the GNU General Public License, version 2"), "This work is licensed under the GNU General Public License, version 2.", *_gnu("General Public License", "2", "any later version", ";")],
    "GPL-3.0": [*_short("the GNU General Public License, version 3"), "This work is licensed under the GNU General Public License, version 3.", *_gnu("General Public License", "3", "any later version")],
    "ISC": [_ISC + _ISC_IF, _ISC + _ISC_IF + _ISC_REST],
    "LGPL-2.1": _gnu("Lesser General Public License", "2.1", "any later version", ";"),
    "LGPL-3.0": _gnu("Lesser General Public License", "3", "any later version"),
    "MIT": [*_short("the MIT License"), _MIT, _MIT + _MIT_REST],
    "MPL-2.0": [*_short("the Mozilla Public License, version 2.0"), "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "Unlicense": [_UNLICENSE],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."],
    RESERVED: ["Copyright. All rights reserved."],
}
for _name, _texts in TEMPLATES.items():
    if _name != RESERVED:
        _texts += _spdx(_name)


#: Stands for the end of a sentence inside a line.
STOP = "\x01"


def normalised(text):
    """Lower case; everything but letters, digits, line feeds and ends of sentences becomes one space."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[.!?]+[ \t]+", STOP), r"[^\p{L}\p{N}\n\x01]+", " ")


def words_in(segment):
    return F.filter(F.split(segment, r"[\s\x01]+"), lambda x: x != "")


def bigram_set(words):
    """The different word bigrams of an array of words, as strings."""
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.filter(pairs, lambda x: x.isNotNull()))


def template_table(spark: SparkSession, templates: dict[str, list[str]], threshold: float) -> tuple[DataFrame, int, list[str], list[str]]:
    """``size, name, b_size, grams``: one row for each template and each segment size that may match it; the least size;
    words of which every segment at the threshold has one; stems of which every text with such a segment has one.

    As many rows as the fixed templates allow, whatever the data.
    """
    raw = spark.createDataFrame([(n, t) for n, ts in templates.items() for t in ts], "name string, template string")
    own = raw.select("name", bigram_set(words_in(normalised(F.col("template")))).alias("grams")).withColumn("b_size", F.size("grams"))
    low = F.ceil(F.col("b_size") * threshold / (2 - threshold) - 1e-9)
    high = F.floor(F.col("b_size") * (2 - threshold) / threshold + 1e-9)
    rows = own.select(low.cast("int").alias("low"), high.cast("int").alias("high"), "name", "b_size", "grams").collect()  # the fixed templates
    cover: set[str] = set()
    for r in rows:
        left = list(r["grams"])
        # fewer bigrams are left without one of the words than a segment at the threshold shares
        for word in sorted({w for g in left for w in g.split(" ")}, key=lambda w: (w not in cover, -len(w), w)):
            if len(left) < r["b_size"] * threshold / (2 - threshold) - 1e-9:
                break
            cover.add(word)
            left = [g for g in left if word not in g.split(" ")]
    table = spark.createDataFrame(rows, "low int, high int, name string, b_size int, grams array<string>").select(F.explode(F.sequence("low", "high")).alias("size"), "name", "b_size", "grams")
    return table, min(r["low"] for r in rows), sorted(cover), stems_of([list(r["grams"]) for r in rows], threshold)


def stems_of(grams: list[list[str]], threshold: float) -> list[str]:
    """Strings (or two words) of which every text with a segment at the threshold has one: ``STEMS``, and more where they are too few."""
    out = set(STEMS)
    for own in grams:
        left = [g for g in own if not any(x in word for x in out for word in g.split(" "))]
        words = sorted({w for g in left for w in g.split(" ")}, key=lambda w: (-len(w), w))
        # a short word is a part of many others, so two words stand in its place
        for word in [w for w in words if len(w) > SHORT_WORD] + left:
            # fewer bigrams are left without a stem than a segment at the threshold shares
            if len(left) < len(own) * threshold / (2 - threshold) - 1e-9:
                break
            out.add(word)
            left = [g for g in left if word not in g]
    return sorted(x for x in out if not any(y in x and y != x for y in out))


def matches(docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``did, rid, segment, name, dice`` of every segment and licence at or above the threshold."""
    spark = docs.sparkSession
    table, least, cover, stems = template_table(spark, templates or TEMPLATES, threshold)
    low = F.lower(F.coalesce("text", F.lit("")))
    rows = keyed(docs).where(reduce(or_, [reduce(and_, [F.contains(low, F.lit(w)) for w in x.split(" ")]) for x in stems])).select("did", "rid", normalised(F.coalesce("text", F.lit(""))).alias("t"))
    lines = F.split("t", "\n")
    sentences = F.flatten(F.transform(F.filter(lines, lambda x: F.contains(x, F.lit(STOP))), lambda x: F.split(x, STOP)))
    paragraphs = F.filter(F.split("t", r"\n[ \n\x01]*\n"), lambda p: F.contains(F.trim(p), F.lit("\n")))
    every = F.split("t", r"\n[ \n\x01]*\n")
    n = F.size(every)
    several = lambda i: F.transform(F.sequence(i + 1, F.least(i + RUN - 1, n)), lambda j: F.array_join(F.slice(every, i, j - i + 1), "\n"))
    runs = F.when(n > 1, F.flatten(F.transform(F.sequence(F.lit(1), n - 1), several))).otherwise(F.array().cast("array<string>"))
    whole = F.when(F.col("t").rlike(r"\n[ \n\x01]*\n"), F.array("t")).otherwise(F.array().cast("array<string>"))
    segments = rows.select("did", "rid", F.posexplode(F.concat(lines, sentences, paragraphs, runs, whole)).alias("segment", "s"))
    worded = segments.select("did", "rid", "segment", words_in(F.col("s")).alias("w")).where((F.size("w") > least) & F.arrays_overlap("w", F.lit(cover)))
    sized = worded.select("did", "rid", "segment", bigram_set(F.col("w")).alias("own")).withColumn("size", F.size("own"))
    pairs = sized.join(F.broadcast(table), "size").withColumn("dice", 2.0 * F.size(F.array_intersect("own", "grams")) / (F.col("size") + F.col("b_size")))
    return pairs.where(F.col("dice") >= threshold - 1e-12).select("did", "rid", "segment", "name", "dice")


def license_scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, license, dice (6 digits), n_segments`` of every document: its best licence and how many segments match any.

    ``license`` and ``dice`` are null and ``n_segments`` 0 where none matches.
    """
    best = matches(docs, templates, threshold).groupBy("did", "rid").agg(
        F.min(F.struct((F.col("name") == RESERVED).alias("reserved"), (-F.col("dice")).alias("d"), "name")).alias("best"), F.countDistinct("segment").alias("n")
    )
    every = keyed(docs).select("did", "rid")
    found = every.join(best, ["did", "rid"], "left")
    return found.select(doc_id_of(), F.col("best.name").alias("license"), F.round(-F.col("best.d"), 6).alias("dice"), F.coalesce("n", F.lit(0)).cast("long").alias("n_segments"))

