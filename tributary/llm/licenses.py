"""License scans by canonical digest lookup, in DataFrame functions only.

A text is made canonical: lower case, copyright lines dropped, every run of other than ASCII letters, digits or characters
from U+0080 made one space within its line, equivalent spellings made one. The SHA-256 digest of the whole canonical text
is hash-joined to the digests of known licence texts and notices, made canonical by the same expressions. The same lookup
is made for each line, as notices stand on lines of their own; a document's lines never leave its row, as the known
digests of lines (a table of fixed size) are a literal map.

Whole texts are those of ``license_texts`` and of ``NOTICES``, with and without their usual titles; notices are ``NOTICES`` and
the usual forms of the names in ``NAMES`` and of the Creative Commons licences. No other text or form is known.

Defined cases: a null text, or one that is nothing once canonical, has a null digest and matches nothing; repeated rows
each give a row; other columns, whatever their names, are not touched.
"""

from __future__ import annotations

import re
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm import shared

# Known notices and licence texts, by SPDX identifier.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\");"),
    ("Apache-2.0", "This work is licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "Licensed under the GNU General Public License, version 2."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0-only", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0-only", "Licensed under the GNU Affero General Public License, version 3."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0-or-later", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("MIT", """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
]

_WARRANTY = next(text for name, text in NOTICES if name == "BSD-2-Clause" and "\n" in text).partition("THIS SOFTWARE")
_NEITHER = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
NOTICES.append(("BSD-3-Clause", _WARRANTY[0] + "3. " + _NEITHER + "\n\n" + _WARRANTY[1] + _WARRANTY[2]))

# Usual names of licences, as they stand in notices.
NAMES = [
    ("MIT", "MIT License"), ("Apache-2.0", "Apache License 2.0"), ("Apache-2.0", "Apache License, Version 2.0"), ("Apache-2.0", "Apache 2.0 License"), ("Apache-2.0", "Apache-2.0 License"),
    ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"), ("BSD-2-Clause", "2-Clause BSD License"), ("BSD-3-Clause", "3-Clause BSD License"), ("ISC", "ISC License"), ("Zlib", "zlib License"),
    ("MPL-1.1", "Mozilla Public License, version 1.1"), ("MPL-2.0", "Mozilla Public License, version 2.0"), ("MPL-2.0", "Mozilla Public License 2.0"), ("MPL-2.0", "MPL 2.0"), ("OFL-1.1", "SIL Open Font License, Version 1.1"), ("Unlicense", "Unlicense"),
    *[(f"{short}-{v}.0-only", form) for short, name, versions in (("GPL", "General", (1, 2, 3)), ("LGPL", "Lesser General", (3,)), ("AGPL", "Affero General", (3,))) for v in versions for form in (f"GNU {name} Public License, version {v}", f"GNU {name} Public License v{v}", f"GNU {name} Public License v{v}.0", f"GNU {short}v{v}", f"{short}v{v}", f"{short}-{v}.0", f"GNU {short} v{v}", f"GNU {short} version {v}")],
    *[("LGPL-2.1-only", form) for form in ("GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "LGPLv2.1", "LGPL-2.1")],
]
_OR_LATER = ("GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_CC_VERSIONS = {"4.0": "International", "3.0": "Unported", "2.5": "Generic", "2.0": "Generic"}
_VERBS = ("Licensed under", "Released under", "Distributed under", "This work is licensed under", "This software is licensed under", "This project is licensed under")
_TITLES = {"MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"), "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"), "BSD-2-Clause": ("BSD 2-Clause License", "The 2-Clause BSD License", "Simplified BSD License"), "BSD-3-Clause": ("BSD 3-Clause License", "The 3-Clause BSD License", "New BSD License"), "Zlib": ("zlib License", "The zlib License", "The zlib/libpng License")}


def _texts() -> list[tuple[str, str]]:
    """The files of license_texts; a file's name is the licence's, and for another version of the text ~ and a number."""
    files = sorted((x for x in resources.files(__package__).joinpath("license_texts").iterdir() if x.name.endswith(".txt")), key=lambda x: x.name)
    return [(x.name.removesuffix(".txt").partition("~")[0], x.read_text("utf-8")) for x in files]


def _forms() -> list[tuple[str, str]]:
    """Usual forms: notices by name and abbreviation, identifiers, whole texts without what often is left out."""
    out = [(name, f"{verb} {the}{form}.") for name, form in NAMES for verb in _VERBS for the in ("the ", "")]
    for code, words in _CC.items():
        for version, kind in _CC_VERSIONS.items():
            name = f"CC-{code}-{version}"
            long = f"Creative Commons {words} {version}"
            for form in (f"CC {code} {version}", f"CC {code} {version} License", long, f"{long} License", f"{long} {kind} License", f"{long} {kind}"):
                out += [(name, f"{verb} {article}{form}.") for verb in _VERBS for article in ("", "a ", "the ")]
            out += [(name, f"SPDX-License-Identifier: {name}")]
    out += [("CC0-1.0", f"{verb} {form}.") for verb in _VERBS for form in ("CC0 1.0", "CC0 1.0 Universal", "the CC0 1.0 Universal License", "Creative Commons Zero v1.0 Universal")]
    whole = [x for x in NOTICES if "\n" in x[1] and x[0] in _TITLES] + _texts()
    ids = {name for name, _ in NOTICES + NAMES + whole} | {f"{x}-{y}" for x in _OR_LATER for y in ("only", "or-later")}
    out += [(name, f"SPDX-License-Identifier: {name}") for name in sorted(ids)]
    for name, text in whole:
        body = text.removeprefix("MIT License\n\n")
        bodies = [body]
        if name.startswith("BSD-"):
            bodies.append(re.sub(r"^[123]\. ", "* ", body, flags=re.M))
        if name == "Apache-2.0":
            bodies += [body.partition("APPENDIX: How to apply")[0]]
        if name == "Unlicense":
            bodies += [body.partition("For more information")[0], body.replace("http://unlicense.org", "https://unlicense.org")]
        if name.startswith(("GPL-", "LGPL-")) and "END OF TERMS AND CONDITIONS" in body:
            bodies += [body.partition("END OF TERMS AND CONDITIONS")[0] + "END OF TERMS AND CONDITIONS"]
        out += [(name, x) for x in bodies] + [(name, f"{title}\n\n{x}") for x in bodies for title in _TITLES.get(name, ())]
    return out


NOTICES = list(dict.fromkeys(NOTICES + _forms()))

# Spellings that count as the same, as they stand once canonical.
SPELLINGS = [("sub license", "sublicense"), ("sub licence", "sublicense"), ("sublicence", "sublicense"), ("license", "licence"), ("licensed", "licenced"), ("noncommercial", "non commercial"), ("organization", "organisation"), ("authorized", "authorised"), ("acknowledgment", "acknowledgement"), ("v 2 0", "version 2 0"), ("v2 0", "version 2 0"), ("copyright holder", "copyright owner"), ("copyright holders", "copyright owners")]

#: Characters by which lines that can't be known are told before they are digested.
HEAD = 12
#: Not within ASCII letters, digits, line feed, or U+0080 on: what becomes a space.
_MARKS = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"
#: A line that states a copyright: the word near its start, then a year or a reservation.
_COPYRIGHT = r"^.{0,16}(?:copyright|\(c\)|©).{0,60}(?:[12][0-9]{3}|all rights reserved)"
_SIGNS = ("copyright", "(c)", "©")


def _either(x: Column, signs: tuple[str, ...]) -> Column:
    out = x.contains(signs[0])
    for sign in signs[1:]:
        out = out | x.contains(sign)
    return out


def _lines(text: Column) -> Column:
    """The canonical lines of a text; each step is a function of one line, so no expression is repeated."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ\r", "abcdefghijklmnopqrstuvwxyz\n")
    out = F.filter(F.split(lower, "\n"), lambda x: ~(_either(x, _SIGNS) & x.rlike(_COPYRIGHT)))
    out = F.transform(out, lambda x: F.trim(F.regexp_replace(x, _MARKS, " ")))
    for spelling, standard in SPELLINGS:
        out = F.transform(out, lambda x: F.when(x.contains(spelling), F.regexp_replace(x, rf"(?<![a-z0-9]){spelling}(?![a-z0-9])", standard)).otherwise(x))  # noqa: B023
    return F.filter(out, lambda x: F.length(x) > 0)


def digest(lines: Column) -> Column:
    """The digest of canonical lines, or null if there are none."""
    return F.when(F.size(lines) > 0, F.sha2(F.concat_ws(" ", lines), 256))


def known(spark: SparkSession, notices=None) -> DataFrame:
    """(digest, license, lengths, heads) of the known texts; heads are their first HEAD characters. A constant table."""
    rows = spark.createDataFrame(notices or NOTICES, "license string, text string")
    rows = rows.select(_lines(F.col("text")).alias("lines"), "license")
    rows = rows.select(digest(F.col("lines")).alias("digest"), F.concat_ws(" ", "lines").alias("all"), "license")
    return rows.groupBy("digest").agg(F.min("license").alias("license"), F.collect_set(F.length("all")).alias("lengths"), F.collect_set(F.substring("all", 1, HEAD)).alias("heads"))


def scan(docs: DataFrame, text: str = "text", notices=None) -> DataFrame:
    """(row, digest, license, n_lines, line_licenses): whole-text match, and licences that lines of the text match."""
    spark = docs.sparkSession
    table = known(spark, notices)
    held = table.collect()  # the constant table
    short = {x.digest: x.license for x in held}
    lookup = F.create_map(*[F.lit(x) for pair in sorted(short.items()) for x in pair])
    lengths, heads = (sorted({y for x in held for y in x[column]}) for column in ("lengths", "heads"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(_lines(F.col(f"`{text}`")), F.array().cast("array<string>")).alias("lines"))
    likely = F.filter("lines", lambda x: F.length(x).isin(lengths) & F.substring(x, 1, HEAD).isin(heads))
    rows = rows.select("row", digest(F.col("lines")).alias("digest"), F.filter(F.transform(likely, lambda x: F.element_at(lookup, F.sha2(x, 256))), lambda x: x.isNotNull()).alias("found"))
    rows = rows.join(F.broadcast(table.select("digest", "license")), "digest", "left")  # at most the constant table
    return rows.select("row", "digest", "license", F.size("found").cast("long").alias("n_lines"), F.concat_ws(",", F.array_sort(F.array_distinct("found"))).alias("line_licenses"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(shared.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", "digest", "license", "n_lines", "line_licenses")


def _oracle() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"

    def lines(column: str) -> str:
        lower = f"translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(13), 'abcdefghijklmnopqrstuvwxyz' || chr(10))"
        signs = " OR ".join(f"contains(x, {quote(x)})" for x in _SIGNS)
        out = f"list_filter(string_split({lower}, chr(10)), lambda x: NOT (({signs}) AND regexp_matches(x, {quote(_COPYRIGHT)})))"
        out = f"list_transform({out}, lambda x: trim(regexp_replace(x, {quote(_MARKS)}, ' ', 'g'), ' '))"
        for spelling, standard in SPELLINGS:
            # RE2 has no look-around: a spelling is matched with its neighbours, twice as neighbours may be shared
            once = "regexp_replace({}, '(^|[^a-z0-9])" + spelling + "($|[^a-z0-9])', '\\1" + standard + "\\2', 'g')"
            out = f"list_transform({out}, lambda x: CASE WHEN contains(x, '{spelling}') THEN {once.format(once.format('x'))} ELSE x END)"
        return f"list_filter({out}, lambda x: length(x) > 0)"

    values = ", ".join(f"({quote(a)}, {quote(t)})" for a, t in NOTICES)
    return f"""
WITH kn AS (SELECT min(license) AS license, sha256(l) AS digest FROM (SELECT license, array_to_string({lines("text")}, ' ') AS l FROM (VALUES {values}) v(license, text)) GROUP BY l),
docs AS (SELECT row_number() OVER () AS r, doc_id, {lines("coalesce(text, '')")} AS l FROM documents),
dig AS (SELECT r, doc_id, CASE WHEN len(l) > 0 THEN sha256(array_to_string(l, ' ')) END AS digest FROM docs),
byline AS (SELECT r, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS s FROM (SELECT r, unnest(l) AS x FROM docs) JOIN kn ON digest = sha256(x) GROUP BY r)
SELECT doc_id, dig.digest, kn.license, CAST(coalesce(n, 0) AS BIGINT) AS n_lines, coalesce(s, '') AS line_licenses
FROM dig LEFT JOIN kn ON dig.digest = kn.digest LEFT JOIN byline USING (r)
"""


ORACLE = _oracle()
