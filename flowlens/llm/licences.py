"""Licence scan by canonical digests, with DataFrame functions only.

A text is made canonical: lower case; copyright lines ("copyright (c) 2020 ...", "(c) ...", also behind marks of a comment) are dropped;
every run of other characters than letters and digits becomes one space; equivalent spellings become one
(``SPELLINGS``). The SHA-256 of the whole canonical text is joined with the digests of the known licences: a
table (licence, text) made canonical by the same columns, ``known_texts`` by default. Notices are found by the same join: the
lines of a text are made canonical, and those whose digest is known are gathered per distinct text.

The table of digests is broadcast up to ``BROADCAST_LICENCES`` rows, beyond it the joins shuffle digests. What is gathered is one row
per distinct text that holds a known line; it is keyed by the text's digest, so thousands of copies are one row.

**Edge cases.** Null, blank and all-punctuation texts have a null digest and no licence; so has a text of
copyright lines alone. Repeated rows are scanned each; a licence text without a word is ignored, and of licences with one
canonical text the first by name stands for all. Very long texts are scanned whole. Other columns may have any names; ``licence_digest``,
``licence`` and ``licence_notices`` are replaced. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import aside, stored

# Rows of the digest table, and of texts with notices, that are broadcast at most.
BROADCAST_LICENCES = 100_000
BROADCAST_NOTICES = 100_000

# Pairs of words held to be the same, right to left.
SPELLINGS = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sub license", "sublicense"),
    ("sublicence", "sublicense"),
    ("noninfringement", "non infringement"), ("whilst", "while"), ("favour", "favor"),
    ("organisation", "organization"), ("authorised", "authorized"), ("copyright owner", "copyright holder"),
    ("copyright owners", "copyright holders"), ("https", "http"),
)
COPYRIGHT = (
    r"(^|\n)[ \t*#/;-]*((portions )?copyright[ \t]*(\(c\)|©|:|<|\[|[0-9]{4})|\(c\)[ \t]|©|all rights reserved)[^\n]*"
)

# Texts of short licences.
_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO
EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN
AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE
OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission."""
_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR
IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY
DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH
DAMAGE."""
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including
without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies
of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following
conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions
of the Software."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""
_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS
SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE
FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF
USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR
IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is
distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the
License for the specific language governing permissions and limitations under the License."""
TEXTS = (
    ("MIT", _MIT + "\n" + _WARRANTY),
    ("MIT", "MIT License\n" + _MIT + "\n" + _WARRANTY),
    ("MIT", "The MIT License (MIT)\n" + _MIT + "\n" + _WARRANTY),
    ("BSD-2-Clause", _BSD + "\n" + _BSD_WARRANTY),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD + "\n" + _BSD_WARRANTY),
    ("BSD-3-Clause", _BSD + "\n" + _BSD_THIRD + "\n" + _BSD_WARRANTY),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD + "\n" + _BSD_THIRD + "\n" + _BSD_WARRANTY),
    ("ISC", _ISC + "\n" + _ISC_WARRANTY),
    ("ISC", "ISC License\n" + _ISC + "\n" + _ISC_WARRANTY),
    ("Apache-2.0", _APACHE_HEADER),
)
_ZERO_BSD = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as
a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright
interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the
detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all
present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE
FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <http://unlicense.org/>"""
_MPL_HEADER = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""
_GNU_HEADER = """This {work} is free software{colon} you can redistribute it and/or modify it under the terms of the GNU {kind}
Public License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later
version.
This {work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} Public License for more details.
You should have received a copy of the GNU {kind} Public License along with this {work}. If not, see
<https://www.gnu.org/licenses/>."""
TEXTS += (
    ("0BSD", _ZERO_BSD + "\n" + _ISC_WARRANTY),
    ("0BSD", "BSD Zero Clause License\n" + _ZERO_BSD + "\n" + _ISC_WARRANTY),
    ("Zlib", _ZLIB),
    ("Zlib", "zlib License\n" + _ZLIB),
    ("Unlicense", _UNLICENSE),
    ("MPL-2.0", _MPL_HEADER),
    *(
        (f"{short}-{version}.0-or-later", _GNU_HEADER.format(work=work, colon=":", kind=kind, version=version))
        for short, kind, versions in (("GPL", "General", "23"), ("LGPL", "Lesser General", "3"), ("AGPL", "Affero General", "3"))
        for version in versions
        for work in ("program", "library", "file")
    ),
)
# Identifiers of licences whose notice line is known.
IDENTIFIERS = (
    "MIT", "MIT-0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "0BSD", "ISC", "Zlib", "BSL-1.0", "Unlicense", "WTFPL",
    "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later",
    "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-2.0", "EPL-2.0", "CDDL-1.0",
    "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0",
)
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    *((name, f"SPDX-License-Identifier: {name}") for name in IDENTIFIERS),
)


def canonical(text: str) -> str:
    """The canonical form of a known text, as ``canonical_column`` makes it."""
    plain = re.sub(r"[\W_]+", " ", re.sub(COPYRIGHT, "\n", text.lower())).strip()
    for other, one in SPELLINGS:
        plain = f" {plain} ".replace(f" {other} ", f" {one} ").strip()
    return plain


def lines_column(text: Column) -> Column:
    """Canonical text that keeps its line ends, with a space at either side of every word."""
    bare = F.regexp_replace(F.lower(text), COPYRIGHT, "\n")
    spaced = F.regexp_replace(bare, r"[^\p{L}\p{N}\n]+", " ")
    # One space between words, two around a line end, so that each word has its own.
    return F.concat(F.lit(" "), F.replace(spaced, F.lit("\n"), F.lit(" \n ")), F.lit(" "))


def _spelled(words: Column) -> Column:
    for other, one in SPELLINGS:
        words = F.replace(words, F.lit(f" {other} "), F.lit(f" {one} "))
    return words


def canonical_column(lines: Column) -> Column:
    """Whole canonical text from ``lines_column``."""
    return F.trim(_spelled(F.regexp_replace(lines, r"[ \n]+", " ")))


def known_texts(spark) -> DataFrame:
    """The texts and notices above as a table: licence, text."""
    return spark.createDataFrame([*TEXTS, *NOTICES], "licence string, text string")


def known_digests(licences: DataFrame) -> DataFrame:
    """known_digest, known_licence: one row per canonical text of ``licences`` (licence, text)."""
    digest = F.sha2(F.nullif(canonical_column(lines_column(F.col("text"))), F.lit("")), 256)
    rows = licences.select(digest.alias("known_digest"), F.col("licence").alias("known_licence")).filter("known_digest is not null")
    return rows.groupBy("known_digest").agg(F.min("known_licence").alias("known_licence"))


def scan(docs: DataFrame, licences: DataFrame | None = None) -> DataFrame:
    """``docs`` with licence_digest, licence (of the whole text, or null) and licence_notices (array)."""
    known = stored(known_digests(known_texts(docs.sparkSession) if licences is None else licences))
    if known.count() <= BROADCAST_LICENCES:
        known = F.broadcast(known)
    plain, back = aside(docs.drop("licence_digest", "licence", "licence_notices"), ("text",))
    lined = plain.withColumn("lines", lines_column(F.col("text")))
    # Notices: every line's digest meets the table; what is left is one row per distinct text with a known line.
    lines = F.transform(F.split("lines", "\n"), lambda x: F.trim(_spelled(F.regexp_replace(x, " +", " "))))
    digests = F.transform(F.array_distinct(F.filter(lines, lambda x: x != "")), lambda x: F.sha2(x, 256))
    each = lined.select(F.sha2("text", 256).alias("text_digest"), F.explode(digests).alias("known_digest"))
    found = each.join(known, "known_digest").groupBy("text_digest").agg(F.array_sort(F.collect_set("known_licence")).alias("notices"))
    found = stored(found)
    if found.count() <= BROADCAST_NOTICES:
        found = F.broadcast(found)
    whole = F.sha2(F.nullif(canonical_column(F.col("lines")), F.lit("")), 256)
    told = lined.withColumn("licence_digest", whole).withColumn("text_digest", F.sha2("text", 256)).drop("lines")
    joined = told.join(known, F.col("licence_digest") == F.col("known_digest"), "left").join(found, "text_digest", "left")
    none = F.array().cast("array<string>")
    return joined.select(
        *back, "licence_digest", F.col("known_licence").alias("licence"), F.coalesce("notices", none).alias("licence_notices")
    )


def _sql() -> str:
    def text(value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    def spelled(column: str) -> str:
        for other, one in SPELLINGS:
            column = f"replace({column}, ' {other} ', ' {one} ')"
        return column

    first: dict[str, str] = {}
    for name, t in sorted((*TEXTS, *NOTICES)):
        first.setdefault(hashlib.sha256(canonical(t).encode()).hexdigest(), name)
    digests = sorted(first.items())
    known = ", ".join(f"({text(name)}, {text(digest)})" for digest, name in digests)
    entries = ", ".join(f"({text(digest)}, {text(name)})" for digest, name in digests)
    return f"""
with known(licence, digest) as (values {known}),
lined as (select doc_id, ' ' || replace(regexp_replace(regexp_replace(lower(text), {text(COPYRIGHT)}, chr(10), 'g'),
    '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g'), chr(10), ' ' || chr(10) || ' ') || ' ' as lines from documents),
whole as (select doc_id, lines, nullif(trim({spelled("regexp_replace(lines, '[ \\n]+', ' ', 'g')")}, ' '), '') as canon from lined),
lists as (select doc_id, canon, list_transform(coalesce(string_split(lines, chr(10)), []),
    lambda x: trim({spelled("regexp_replace(x, ' +', ' ', 'g')")}, ' ')) as each from whole)
select doc_id, sha256(canon) as digest, (select any_value(licence) from known where digest = sha256(canon)) as license,
  array_to_string(list_sort(list_distinct(list_filter(list_transform(each, lambda x:
    map_from_entries([{entries}])[sha256(x)]), lambda x: x is not null))), ',') as notices
from lists
"""


SQL = _sql()
