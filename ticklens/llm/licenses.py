"""Whole texts that are known licences, by the digest of their canonical form.

The canonical form has ASCII letters in lower case, no copyright lines, one space for each run of
anything but letters and digits, and one spelling for equivalent ones, much as the public SPDX
matching guidelines ask.  Equivalent spellings are closed lists of words: a word that isn't in one
("our", "filled") stays as it is, so texts of other words have other digests.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import texts

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A line that starts with a copyright mark and a year, mark or placeholder, or reserves all rights.
#: Wrapped prose ("copyright notice and this permission ...") isn't one.
COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n]*((copyright|\(c\)|©)[ \t]*((\(c\)|©|copyright)[ \t]*)*[\[<{(]?([0-9]{4}|year|yyyy)|(copyright[ \t]*(\(c\)|©)|©|\(c\)[ \t]*copyright)|all rights reserved[^a-z0-9\n]*$)[^\n]*"
#: Letters and digits; what is outside ASCII counts as a letter from U+00C0 on but for general punctuation.
SEPARATORS = r"[^a-z0-9\x{C0}-\x{1FFF}\x{2070}-\x{10FFFF}]+"
# Equivalent spellings (fixed values): beginnings and endings of words, and the letters between them in
# either spelling; then pairs of whole words, and pairs of two words and one.
_IZE = ("author", "capital", "categor", "character", "custom", "emphas", "final", "general", "initial", "maxim", "minim", "modern", "normal",
        "optim", "organ", "real", "recogn", "serial", "special", "standard", "summar", "synchron", "util", "unauthor", "reorgan")
_IZE_ENDS = ("e", "ed", "es", "er", "ers", "ing", "ation", "ations", "able")
_OR = ("behavi", "col", "endeav", "fav", "harb", "hon", "lab", "neighb")
_OR_ENDS = ("", "s", "ed", "ing", "able", "ite", "ites")
_L = ("cance", "labe", "mode", "signa", "trave")
FAMILIES = (
    (_IZE, "is", "iz", _IZE_ENDS), (_OR, "our", "or", _OR_ENDS), (_L, "ll", "l", ("ed", "ing")),
    (("licen", "sublicen"), "c", "s", ("e", "es", "ed", "ing", "ee", "ees", "or", "ors")), (("off", "def", "pret"), "ence", "ense", ("", "s")),
    (("acknowledg", "judg"), "ement", "ment", ("", "s")), (("catal", "anal"), "ogue", "og", ("", "s")), (("analy",), "s", "z", ("e", "ed", "er", "ers", "ing")),
    (("art",), "e", "i", ("fact", "facts")), (("cent", "calib"), "re", "er", ("", "s")), (("program",), "me", "", ("", "s")),
    (("fulfil",), "", "l", ("", "s", "ment")), (("wil",), "", "l", ("ful", "fully")), (("whil",), "st", "e", ("",)), (("http",), "s", "", ("",)),
)
PHRASES = (("sub license", "sublicense"), ("sub licensed", "sublicensed"), ("sub licensing", "sublicensing"), ("non commercial", "noncommercial"),
           ("per cent", "percent"), ("copyright holder", "copyright owner"), ("copyright holders", "copyright owners"))


def _family(begins: tuple[str, ...], old: str, new: str, ends: tuple[str, ...]) -> tuple[str, str]:
    """Pattern and replacement.  The pattern starts with letters, so that most places are passed by one
    comparison; what stands before and after them is looked at only then."""
    if not old:  # what is put in follows the beginning
        old, new, begins = begins[0], begins[0] + new, ("",)
    return rf"{old}(?<=\b(?:{'|'.join(begins)}){old})(?=(?:{'|'.join(ends)})\b)", new


#: Applied in turn: pattern, replacement.
SPELLINGS = (*(_family(*f) for f in FAMILIES), *((rf"\b{old}\b", new) for old, new in PHRASES))

_PERMISSION = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted{}.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
_BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_NAMES = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
_ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software. If you use this software
   in a product, an acknowledgment in the product documentation would be
   appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be
   misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.

In jurisdictions that recognize copyright laws, the author or authors
of this software dedicate any and all copyright interest in the
software to the public domain. We make this dedication for the benefit
of the public at large and to the detriment of our heirs and
successors. We intend this dedication to be an overt act of
relinquishment in perpetuity of all present and future rights to this
software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR
OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <http://unlicense.org/>"""
_BOOST = """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute,
execute, and transmit the Software, and to prepare derivative works of the
Software, and to permit third-parties to whom the Software is furnished to
do so, all subject to the following:

The copyright notices in the Software and this entire statement, including
the above license grant, this restriction and the following disclaimer,
must be included in all copies of the Software, in whole or in part, and
all derivative works of the Software, unless such copies or derivative
works are solely in the form of machine-executable object code generated by
a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT
SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE
FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
DEALINGS IN THE SOFTWARE."""
_KEEP_NOTICE = ", provided that the above\ncopyright notice and this permission notice appear in all copies"
_TEXTS = (("MIT", "MIT License", _PERMISSION), ("ISC", "ISC License", _ISC.format(_KEEP_NOTICE)), ("0BSD", "BSD Zero Clause License", _ISC.format("")),
          ("BSD-2-Clause", "BSD 2-Clause License", _BSD.format("")), ("BSD-3-Clause", "BSD 3-Clause License", _BSD.format(_BSD_NAMES)),
          ("Zlib", "zlib License", _ZLIB), ("Unlicense", "The Unlicense", _UNLICENSE), ("BSL-1.0", "", _BOOST), ("Apache-2.0", "", _APACHE_NOTICE))
#: Known texts (fixed values): public licence texts with and without their title, and one-line notices.
KNOWN = (
    *((k, f"{title}\n\nCopyright (c) <year> <owner>\n\n{body}") for k, title, body in _TEXTS if title),
    *((k, body) for k, _, body in _TEXTS),
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
)


def canonical(text: Column) -> Column:
    """The canonical form of a text column that isn't null."""
    made = F.regexp_replace(F.translate(text, UPPER, LOWER), COPYRIGHT_LINE, "")
    made = F.concat(F.lit(" "), F.regexp_replace(made, SEPARATORS, " "), F.lit(" "))
    for pattern, put in SPELLINGS:
        made = F.regexp_replace(made, pattern, put)
    return F.trim(F.regexp_replace(made, " +", " "))


def digest(text: Column) -> Column:
    return F.sha2(F.encode(canonical(text), "UTF-8"), 256)


def known_digests(spark: SparkSession) -> DataFrame:
    """licence and text of the built-in texts."""
    return spark.createDataFrame(list(KNOWN), "licence string, text string")


def license_scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, canonical_sha256 and licence (null: none) of every row of ``docs``.

    ``known`` has licence and text; of several licences with one digest the first by name counts,
    and its null or wordless texts are left out.  Null texts are empty, and a text without words is
    no licence.  Repeated rows and null doc_ids stay.
    """
    lines = known.filter(F.col("text").isNotNull() & (canonical(F.col("text")) != "")).select("licence", digest(F.col("text")).alias("canonical_sha256"))
    table = lines.groupBy("canonical_sha256").agg(F.min("licence").alias("licence"))
    found = texts(docs).select("doc_id", digest(F.col("text")).alias("canonical_sha256"))
    return found.join(table, "canonical_sha256", "left").select("doc_id", "canonical_sha256", "licence")


def oracle_sql() -> str:
    """The same over the built-in texts, for DuckDB, by words and not by patterns: every word is looked
    up in a table of all spellings, and phrases are replaced between doubled spaces."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    words = {a + old + e: a + new + e for begins, old, new, ends in FAMILIES for a in begins for e in ends}
    names, put = ([quote(x) for x in column] for column in zip(*sorted(words.items()), strict=True))

    def form(text: str) -> str:
        made = f"regexp_replace(translate({text}, '{UPPER}', '{LOWER}'), {quote(COPYRIGHT_LINE)}, '', 'g')"
        made = f"string_split(trim(regexp_replace({made}, {quote(SEPARATORS)}, ' ', 'g'), ' '), ' ')"
        made = f"'  ' || array_to_string([coalesce(spellings[w], w) FOR w IN {made}], '  ') || '  '"
        for old, new in PHRASES:
            made = f"replace({made}, {quote('  ' + old.replace(' ', '  ') + '  ')}, {quote('  ' + new.replace(' ', '  ') + '  ')})"
        return f"trim(replace({made}, '  ', ' '), ' ')"

    values = ", ".join(f"({quote(k)}, {quote(t)})" for k, t in KNOWN)
    return (f"WITH spelt AS (SELECT MAP([{', '.join(names)}], [{', '.join(put)}]) AS spellings), "
            f"known AS (SELECT {form('text')} AS c, licence FROM (VALUES {values}) v(licence, text), spelt), "
            "digests AS (SELECT sha256(c) AS canonical_sha256, min(licence) AS licence FROM known WHERE c <> '' GROUP BY 1), "
            f"found AS (SELECT doc_id, sha256({form("coalesce(text, '')")}) AS canonical_sha256 FROM documents, spelt) "
            "SELECT doc_id, canonical_sha256, licence FROM found LEFT JOIN digests USING (canonical_sha256)")
