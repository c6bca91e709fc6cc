"""Known licences by canonical digests, in DataFrame functions only.

A text is brought to one canonical form (case, spellings of one word, copyright
lines, punctuation and white space), its SHA-256 digest is taken, and digests
are joined to those of known licences and notices, formed in the same way. The
units that are looked up whole are the document, its paragraphs and its lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from importlib.resources import files

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Licences and the notices by which texts declare them.
_NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", """MIT License

Copyright (c) <year> <copyright holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("ISC", """ISC License

Copyright (c) <year> <owner>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License v3.0."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("all-rights-reserved", "All rights reserved."),
)

#: The identifiers of tag lines, beside those above.
_TAGS = {
    "BSD-2-Clause": ("BSD-2-Clause",), "BSD-3-Clause": ("BSD-3-Clause",), "MPL-1.1": ("MPL-1.1",), "MPL-2.0": ("MPL-2.0",), "Unlicense": ("Unlicense",),
    "CC0-1.0": ("CC0-1.0",), "CC-BY-4.0": ("CC-BY-4.0",), "CC-BY-NC-4.0": ("CC-BY-NC-4.0",), "Zlib": ("Zlib",), "BSL-1.0": ("BSL-1.0",), "Artistic-1.0-Perl": ("Artistic-1.0-Perl",),
    **{f"{k}-{v}": (f"{k}-{v}", f"{k}-{v}-only", f"{k}-{v}-or-later", f"{k}-{v}+") for k, v in (
        ("GPL", "1.0"), ("GPL", "2.0"), ("GPL", "3.0"), ("LGPL", "2.0"), ("LGPL", "2.1"), ("LGPL", "3.0"), ("AGPL", "3.0"), ("GFDL", "1.2"), ("GFDL", "1.3"))},
}
_APACHE_HEADER = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "http://www.apache.org/licenses/LICENSE-2.0",
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
    "either express or implied. See the License for the specific language governing permissions and limitations under the License.",
)
_MPL_HEADER = (
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
)
#: Family, name of the licence, version, what stands before "you can redistribute it".
_GNU = (
    ("GPL", "GNU General Public License", "2", ";"), ("GPL", "GNU General Public License", "3", ":"), ("AGPL", "GNU Affero General Public License", "3", ":"),
    ("LGPL", "GNU Library General Public License", "2", ";"), ("LGPL", "GNU Lesser General Public License", "2.1", ";"), ("LGPL", "GNU Lesser General Public License", "3", ":"),
)


def _headers() -> Iterator[tuple[str, str]]:
    """Standard headers: whole, and their first paragraphs, which name the licence."""
    yield "Apache-2.0", "\n\n".join(_APACHE_HEADER)
    yield "Apache-2.0", " ".join(_APACHE_HEADER[:2])
    yield "Apache-2.0", _APACHE_HEADER[0]
    yield "Apache-2.0", _APACHE_HEADER[2]
    yield "MPL-2.0", _MPL_HEADER
    for family, name, version, mark in _GNU:
        for thing in ("program", "library"):
            for either in (f"either version {version} of the License, or (at your option) any later version", f"version {version} of the License"):
                first = f"This {thing} is free software{mark} you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation{';' if mark == ';' else ','} {either}."
                second = f"This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details."
                third = f"You should have received a copy of the {name} along with this {thing}. If not, see <http://www.gnu.org/licenses/>."
                licence = f"{family}-{version if '.' in version else version + '.0'}"
                yield licence, first
                yield licence, f"{first}\n\n{second}"
                yield licence, f"{first}\n\n{second}\n\n{third}"


def _whole() -> Iterator[tuple[str, str]]:
    """Whole texts as published and with each paragraph on one line, with and without what follows their terms and without their title."""
    for path in sorted(files("heliotide.llm").joinpath("licence_texts").iterdir(), key=lambda p: p.name):
        if not path.name.endswith(".txt"):
            continue
        licence, text = path.name[: -len(".txt")], path.read_bytes().decode()
        texts = [text]
        if "END OF TERMS AND CONDITIONS" in text:
            texts.append(text[: text.index("END OF TERMS AND CONDITIONS")] + "END OF TERMS AND CONDITIONS")
            texts.append(text[: text.index("END OF TERMS AND CONDITIONS")])
        if licence.startswith(("BSD", "Zlib", "BSL")):
            texts.append(text.split("\n\n", 1)[1])
            texts += [t.replace("All rights reserved.\n", "") for t in texts if "All rights reserved." in t]
        for t in texts:
            yield licence, t
            yield licence, "\n\n".join(" ".join(p.split()) for p in re.split(r"\n\s*\n", t))


#: Titles under which the short licences are published; some texts have none.
_TITLES = {"MIT": ("The MIT License (MIT)", "The MIT License", "MIT License (MIT)", "MIT"), "ISC": ("The ISC License", "ISC License (ISC)", "The ISC License (ISC)", "ISC")}


def _titled() -> Iterator[tuple[str, str]]:
    """The short licences under their other titles and without one."""
    for licence, text in _NOTICES:
        title, _, rest = text.partition("\n\n")
        if rest:
            yield licence, rest
            for other in _TITLES[licence]:
                yield licence, f"{other}\n\n{rest}"


#: Notices, tag lines, standard headers and whole texts.
KNOWN = tuple(dict.fromkeys((*_NOTICES, *_titled(), *((k, f"SPDX-License-Identifier: {tag}") for k, tags in _TAGS.items() for tag in tags), *_headers(), *_whole())))

#: Spellings that mean the same, as (pattern over the lower-cased text, replacement).
EQUIVALENT = (
    (r"licence", "license"), (r"licencing", "licensing"), (r"sub-license", "sublicense"), (r"non-commercial", "noncommercial"),
    (r"merchantibility", "merchantability"), (r"organisation", "organization"), (r"whilst", "while"), (r"judgement", "judgment"),
    (r"https://", "http://"), (r"\bv(?:er)?\.? ?(?=[0-9])", "version "), (r"\bversion +([0-9]+)\.0\b", "version $1"), (r"©", "(c)"),
)
#: A line that begins like this names an owner, not a licence: the word with a year, a sign or a blank to fill in behind it.
COPYRIGHT_LINE = r"(?m)^[ \t#*/;-]*(?:copyright:?[ \t]*(?:\(c\)|[0-9]{4}|[<\[{])|\(c\)[ \t]*(?:[0-9]{4}|copyright)).*$"


def canonical_lines(text: Column) -> Column:
    """Lower case, one spelling, no copyright lines, letters and digits alone; line breaks stay."""
    out = F.lower(text)
    for pattern, to in EQUIVALENT:
        out = F.regexp_replace(out, pattern, to)
    out = F.regexp_replace(out, COPYRIGHT_LINE, " ")
    return F.regexp_replace(out, r"[^\p{L}\p{N}\n]+", " ")


def joined(lines: Column) -> Column:
    """Canonical lines as one text, with one space between words."""
    return F.trim(F.regexp_replace(lines, r"[ \n]+", " "))


def canonical(text: Column) -> Column:
    return joined(canonical_lines(text))


def known_licences(spark, known: Sequence[tuple[str, str]] = KNOWN) -> DataFrame:
    """``licence, digest`` for (licence, text) pairs; a text without a letter or digit after canonicalisation is left out."""
    texts = spark.createDataFrame(list(known), "licence string, text string").withColumn("canon", canonical(F.col("text")))
    return texts.where("canon <> ''").select("licence", F.sha2("canon", 256).alias("digest")).distinct()


def _units(lines: Column) -> Column:
    """(scope, canonical text) of the whole, of its paragraphs and of its lines, the latter where there are several."""
    unit = lambda scope: lambda t: F.struct(F.lit(scope).alias("scope"), t.alias("text"))
    filled = lambda units: F.filter(units, lambda t: t != "")
    several = lambda units: F.when(F.size(units) > 1, units).otherwise(F.array().cast("array<string>"))
    return F.concat(
        F.transform(filled(F.array(joined(lines))), unit("text")),
        F.transform(several(filled(F.transform(F.split(lines, r"\n(?: *\n)+"), joined))), unit("paragraph")),
        F.transform(several(filled(F.transform(F.split(lines, r"\n"), lambda t: F.trim(t)))), unit("line")),
    )


def matches(docs: DataFrame, licences: DataFrame) -> DataFrame:
    """``doc_id, text_key, scope, unit, licence`` for each unit of a text whose digest is known.

    A document is looked up as a whole; its paragraphs and lines too where it
    has several. Paragraphs end at lines without letters or digits, such as
    blank lines and copyright lines. ``licences`` comes from ``known_licences``,
    a list the caller holds, and is sent to the documents.
    """
    texts = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_key"),
        canonical_lines(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("lines"),
    )
    units = texts.select("doc_id", "text_key", F.posexplode(_units(F.col("lines"))).alias("unit", "u"))
    digests = units.select("doc_id", "text_key", "unit", F.col("u.scope").alias("scope"), F.sha2("u.text", 256).alias("digest"))
    # A fixed list from the driver: no digest of a document is moved.
    return digests.join(F.broadcast(licences), "digest").select("doc_id", "text_key", "scope", "unit", "licence")


def report(docs: DataFrame, known: Sequence[tuple[str, str]] = KNOWN) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, whole_licence, licences, n_units``.

    ``whole_licence`` is set where the entire text is a known licence (the
    first by name if several are); ``licences`` lists the licences of all
    matching units, sorted and comma-joined, and ``n_units`` counts those units.
    Null and empty texts match nothing. Rows that repeat a doc_id are told apart
    by their text; extra columns are ignored.
    """
    found = matches(docs, known_licences(docs.sparkSession, known)).groupBy("doc_id", "text_key").agg(
        F.min(F.when(F.col("scope") == "text", F.col("licence"))).alias("whole_licence"),
        F.array_join(F.array_sort(F.collect_set("licence")), ",").alias("licences"),
        F.count_distinct("unit").alias("n_units"),
    ).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "whole_licence", "licences", "n_units")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_key"))
    joined = rows.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    return joined.select(
        "doc_id", "whole_licence", F.coalesce("licences", F.lit("")).alias("licences"), F.coalesce("n_units", F.lit(0)).cast("bigint").alias("n_units")
    )
