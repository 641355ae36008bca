"""Licence scans: canonical digests of whole texts and of whole lines, joined to the digests of known licences."""

from __future__ import annotations

import functools
import hashlib
import re
from pathlib import Path

import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Spellings that count as equal, as whole words after punctuation has become spaces.
SPELLINGS = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("sub licence", "sublicense"), ("sub license", "sublicense"),
    ("non commercial", "noncommercial"), ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"),
    ("favour", "favor"), ("honour", "honor"), ("acknowledgement", "acknowledgment"), ("organisation", "organization"), ("whilst", "while"),
    ("per cent", "percent"), ("http", "https"),
)
#: What a line holds that is no part of a licence text: a year or sign after the word "copyright", the holder before the year, "The X Authors", a year
#: to be filled in, "all rights reserved". A line that begins with HOLDER is part of one all the same.
_SIGN = r"[^\p{L}\p{N}\n]*"
COPYRIGHT = rf"{_SIGN}(?:copyright|copr|\(c\)|©)[^\p{{L}}\p{{N}}\n]+(?:[^\p{{L}}\n]*[0-9]{{4}}|\(c\)|©)"
HOLDER = rf"{_SIGN}(?:copyright|copr|\(c\)|©)[^\p{{L}}\p{{N}}\n]+(?:holders?|owners?)\b"
NO_TEXT = (
    rf"{_SIGN}(?:(?:copyright|copr|\(c\)|©)[^\p{{L}}\p{{N}}\n]+"
    r"(?:.*\b(?:19|20)[0-9]{2}[^\p{L}\n]*(?:present[^\p{L}\n]*)?|.*\b(?:authors|contributors|developers|maintainers)[^\p{L}\p{N}\n]*|(?:\(?c\)[^\p{L}\p{N}\n]*)?(?:yyyy|year|19yy)\b.*)"
    r"(?:all rights reserved[^\p{L}\p{N}\n]*)?|all rights reserved[^\p{L}\p{N}\n]*)$"
)
#: One of these is in every such line.
SIGNS = ("copyright", "copr", "©", "(c)", "all rights reserved")

_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
    "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER "
    "CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF "
    "ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
)
# Public licence texts and notices, by identifier.
KNOWN = (
    ("MIT", "MIT License\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software "
     "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
     "Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n" + _WARRANTY),
    ("ISC", _GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC),
    ("0BSD", _GRANT + ".\n" + _ISC),
    ("BSD-2-Clause", _BSD_HEAD + _BSD),
    ("BSD-3-Clause", _BSD_HEAD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n" + _BSD),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n"
     "http://www.apache.org/licenses/LICENSE-2.0\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
     "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
)

#: Whole texts in the folder `licenses`, and how many of their first lines are a title.
WHOLE = {
    "Apache-2.0": 3, "GPL-1.0": 2, "GPL-2.0": 2, "GPL-3.0": 2, "LGPL-2.0": 2, "LGPL-2.1": 2, "LGPL-3.0": 2, "MPL-1.1": 2, "MPL-2.0": 1,
    "CC0-1.0": 2, "GFDL-1.2": 2, "GFDL-1.3": 2, "Artistic-1.0-Perl": 1, "BSD-3-Clause": 0,
}
_BSD_TITLES = ("BSD License", "The BSD License")
#: Titles under which the short texts are found.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License", "0BSD License"),
    "BSD-2-Clause": (*_BSD_TITLES, "BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License", "Simplified BSD License", "BSD 2-Clause \"Simplified\" License", "FreeBSD License"),
    "BSD-3-Clause": (*_BSD_TITLES, "BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License", "New BSD License", "Revised BSD License", "BSD 3-Clause \"New\" or \"Revised\" License"),
}


def whole_texts() -> list[tuple[str, str]]:
    """(license, text) of the whole texts in their usual forms: with and without title; long ones with and without what follows their
    terms, short ones under each of TITLES and with or without numbers before their conditions."""
    out, short = [], [(n, t) for n, t in KNOWN if n in TITLES and len(t) > 300]
    for name, title in WHOLE.items():
        text = (Path(__file__).parent / "licenses" / f"{name}.txt").read_text()
        if name in TITLES:
            short.append((name, text))
            continue
        lines = [x for x in text.split("\n") if re.search(r"[^\W_]", x)]
        ends = [len(lines), *(i + j for i, x in enumerate(lines) if x.strip() == "END OF TERMS AND CONDITIONS" for j in (0, 1))]
        out += [(name, "\n".join(lines[lo:hi])) for lo in range(title + 1) for hi in ends]
    for name, text in short:
        body = text.removeprefix(f"{TITLES[name][0]}\n")
        bodies = dict.fromkeys((body, re.sub(r"(?m)^[0-9]\. ", "", body)))
        out += [(name, f"{title}\n{b}") for title in ("", *TITLES[name]) for b in bodies]
    return out


def canonical_lines(text: Column) -> Column:
    """Lines in lower case without copyright lines and "all rights reserved"; punctuation is space, spellings are equal; lines left empty are dropped.

    The text goes through each step as a whole. In between, a word has a space of its own on either side.
    """
    x = F.lower(text)
    signs = functools.reduce(Column.__or__, [x.contains(s) for s in SIGNS])
    x = F.when(signs, F.regexp_replace(x, rf"(?md)^(?:{COPYRIGHT}.*|(?!{HOLDER}){NO_TEXT})", "")).otherwise(x)
    x = F.concat(F.lit(" "), F.replace(F.regexp_replace(x, r"[^\p{L}\p{N}\n]+", "  "), F.lit("\n"), F.lit(" \n ")), F.lit(" "))
    for a, b in SPELLINGS:
        x = F.replace(x, F.lit(_spaced(a)), F.lit(_spaced(b)))
    x = F.replace(x, F.lit("  "), F.lit(" "))  # spaces in a row are left at the ends of lines alone
    return F.filter(F.transform(F.split(x, "\n", -1), lambda line: F.trim(line)), lambda line: line != "")


def _spaced(words: str) -> str:
    return f" {words.replace(' ', '  ')} "


def canonical(text: str) -> list[str]:
    """As canonical_lines(), for one text on the driver."""
    out = []
    for line in text.lower().split("\n"):
        if regex.match(COPYRIGHT, line) or (regex.match(NO_TEXT, line) and not regex.match(HOLDER, line)):
            continue
        line = f" {regex.sub(r'[^\p{L}\p{N}]+', '  ', line)} "
        for a, b in SPELLINGS:
            line = line.replace(_spaced(a), _spaced(b))
        if line := " ".join(line.split()):
            out.append(line)
    return out


def digest(canonical: Column) -> Column:
    return F.sha2(canonical.cast("binary"), 256)


def digests(known: tuple[tuple[str, str], ...] | None = None) -> list[tuple[str, str]]:
    """(digest, license) of the known texts, KNOWN and whole_texts() by default; of texts that are equal, the first."""
    out: dict[str, str] = {}
    for name, text in [*KNOWN, *whole_texts()] if known is None else known:
        out.setdefault(hashlib.sha256(" ".join(canonical(text)).encode()).hexdigest(), name)
    return list(out.items())


def known_digests(spark: SparkSession, known: tuple[tuple[str, str], ...] | None = None) -> DataFrame:
    """digests() as a table, of one row a known text."""
    return spark.createDataFrame(digests(known), "digest string, license string")


#: Known digests up to which their table is broadcast.
BROADCAST = 100_000


def license_scan(docs: DataFrame, known: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, license, notices, n_notices) for every row.

    `license` is the known licence whose digest the whole canonical text has, else null. `notices` are the licences, in order and
    once each, of lines that are a known text as a whole, and n_notices counts those lines. `known` (digest, license) is a table
    of one row a licence text, and is broadcast if it has BROADCAST rows at most.

    Null or empty text, or one of copyright lines and punctuation alone: null, none, 0. Rows that share an id share what is found
    in any of them, n_notices summed. Null ids: null, none, 0. Empty table: empty result. Other columns are ignored.
    """
    lines = docs.select(F.col(id_col).alias("id"), canonical_lines(F.col(text_col)).alias("lines")).filter("id is not null")
    whole = F.array(F.struct(F.lit(True).alias("whole"), digest(F.array_join("lines", " ")).alias("digest")))
    each = F.transform("lines", lambda x: F.struct(F.lit(False).alias("whole"), digest(x).alias("digest")))
    units = lines.select("id", F.explode(F.when(F.size("lines") > 0, F.concat(whole, each))).alias("u")).select("id", "u.whole", "u.digest")
    known = known.select("digest", "license")
    hits = units.join(F.broadcast(known) if known.limit(BROADCAST + 1).count() <= BROADCAST else known, "digest")
    found = hits.groupBy("id").agg(
        F.min(F.when(F.col("whole"), F.col("license"))).alias("license"),
        F.sort_array(F.collect_set(F.when(~F.col("whole"), F.col("license")))).alias("notices"),
        F.count_if(~F.col("whole")).alias("n_notices"),
    )
    rows = docs.select(F.col(id_col).alias("id")).join(found, "id", "left")
    return rows.select(F.col("id").alias(id_col), "license", F.coalesce("notices", F.array().cast("array<string>")).alias("notices"), F.coalesce("n_notices", F.lit(0)).alias("n_notices"))
