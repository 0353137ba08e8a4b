"""Licence texts by canonical digest: whole texts and whole lines, normalised and hash-joined to known licences."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, table

#: Whole public licences, each in a file of its short name, beside this module.
WHOLE_LICENCES = Path(__file__).with_name("licences")

# Equivalent spellings, replaced in this order in lower-case text.
SPELLINGS = (
    ("https://", "http://"), ("licence", "license"), ("sub-license", "sublicense"), ("sub license", "sublicense"),
    ("non-infringement", "noninfringement"), ("non infringement", "noninfringement"), ("merchantibility", "merchantability"),
    ("non-commercial", "noncommercial"), ("per cent", "percent"), ("organisation", "organization"), ("favour", "favor"),
    ("fulfil ", "fulfill "), ("judgement", "judgment"), ("whilst", "while"), ("wilful", "willful"), ("&", " and "),
)
#: A line that says who holds the copyright since when, and one that reserves all rights.
COPYRIGHT_LINE = r"\n[^a-z0-9\n]*(?:copyright[^a-z0-9\n]*(?:\(c\)|©|c [0-9]|[0-9<\[{])|\(c\)|©)[^\n]*"
RIGHTS_LINE = r"\n[^a-z0-9\n]*all rights reserved[^a-z0-9\n]*(\n)"
PUNCTUATION = r"[\x00-\x2F\x3A-\x60\x7B-\x7F“”‘’–—«»©]+"
PUNCTUATION_IN_LINE = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F“”‘’–—«»©]+"

# Public licence texts, each with its public short name.
_AS_IS_COPYING = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_MIT_BODY = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_UNLICENSE = 'This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <https://unlicense.org/>'
_ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."
_BOOST = 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n\nThe copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_X11 = _MIT_BODY + "\n\nExcept as contained in this notice, the name of the X Consortium shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization from the X Consortium."
KNOWN_LICENCES = (
    ("MIT", "MIT License\n\n" + _MIT_BODY),
    ("MIT", _MIT_BODY),
    ("ISC", "ISC License\n\n" + _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _AS_IS_COPYING),
    ("ISC", _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _AS_IS_COPYING),
    ("0BSD", _ISC_GRANT + ".\n\n" + _AS_IS_COPYING),
    ("BSD-2-Clause", _BSD_START + _BSD_END),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD_START + _BSD_END),
    ("BSD-3-Clause", _BSD_START + _BSD_NAMES + _BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD_START + _BSD_NAMES + _BSD_END),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("All-rights-reserved", "All rights reserved."),
    ("Unlicense", _UNLICENSE), ("Zlib", _ZLIB), ("Zlib", "zlib License\n\n" + _ZLIB), ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003\n\n" + _BOOST), ("X11", _X11),
    *[(name, f"SPDX-License-Identifier: {name}") for name in ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-3.0-only", "MPL-2.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "Unlicense", "Zlib", "BSL-1.0")],
)


def spelled(text: Column) -> Column:
    """``text`` in lower case and one spelling."""
    text = F.lower(text)
    for other, one in SPELLINGS:
        text = F.replace(text, F.lit(other), F.lit(one))
    return text


def canonical(text: Column) -> Column:
    """Words of a whole `spelled` text without its copyright lines, single spaces between; one of copyright lines alone keeps them."""
    bare = lambda x: F.trim(F.regexp_replace(x, PUNCTUATION, " "))
    has = lambda *marks: F.exists(F.array(*[F.lit(m) for m in marks]), lambda m: F.contains(text, m))
    body = F.concat(F.lit("\n"), text, F.lit("\n"))
    body = F.when(has("copyright", "(c)", "©"), F.regexp_replace(body, COPYRIGHT_LINE, "\n")).otherwise(body)
    body = bare(F.when(has("all rights reserved"), F.regexp_replace(body, RIGHTS_LINE, "\n")).otherwise(body))
    return F.when(body == "", bare(text)).otherwise(body)


def canonical_lines(text: Column) -> Column:
    """Words of each line of a `spelled` text that has any, single spaces between."""
    bare = F.transform(F.split(F.regexp_replace(text, PUNCTUATION_IN_LINE, " "), "\n"), lambda x: F.trim(x))
    return F.filter(bare, lambda x: x != "")


def known_digests(known: DataFrame) -> DataFrame:
    """digest, licence of ``known`` (licence, text); the first name where texts are equal, nulls and empty texts left out."""
    one_line = F.array_join(canonical_lines(F.col("text")), " ")
    form = known.where("licence is not null").select("licence", spelled(F.col("text")).alias("text")).select("licence", F.explode(F.array(canonical(F.col("text")), one_line)).alias("form"))
    return form.where("form is not null and form <> ''").groupBy(F.sha2("form", 256).alias("digest")).agg(F.min("licence").alias("licence"))


def whole_licences() -> list[tuple[str, str]]:
    """(licence, text) of the files that come with this module; few and fixed, so that the driver reads them."""
    return [(p.stem, p.read_text(encoding="utf-8")) for p in sorted(WHOLE_LICENCES.glob("*.txt"))]


def known_in_folder(spark: SparkSession, folder: str) -> DataFrame:
    """licence, text of the files of a folder that every executor sees, each whole file a licence named by its file name.

    Empty files are no licences; of files with equal texts the first name counts; an empty folder
    gives no rows.
    """
    files = spark.read.text(folder, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.txt|\.md)?$", 1).alias("licence"), F.col("value").alias("text"))
    return files.where("text <> ''")


def scan_licences(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, licence, notices, n_notices for every row of ``docs`` (doc_id, text).

    ``licence`` is that of the whole text, null if it is not a known one; ``notices`` are the
    distinct licences, in order, of lines that are a whole known text each, ``n_notices``
    counts those lines.  ``known`` (licence, text) is digested once and written; the planner
    broadcasts the digests while their bytes are few and shuffles both sides beyond that.

    Null and empty texts have no licence; null ids and repeated rows keep a row each; an empty
    table gives no rows; other columns are not read.
    """
    digests = materialise(known_digests(known), "licences")
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("_row"), spelled(F.col("text").cast("string")).alias("_text"))
    lines = F.transform(canonical_lines(F.col("_text")), lambda x: F.sha2(x, 256))
    rows = materialise(rows.select("doc_id", "_row", F.sha2(canonical(F.col("_text")), 256).alias("digest"), lines.alias("lines")), "licence-digests")
    hits = rows.select("_row", F.explode("lines").alias("digest")).join(digests, "digest").groupBy("_row")
    hits = materialise(hits.agg(F.array_sort(F.collect_set("licence")).alias("notices"), F.count("*").alias("n_notices")), "licence-lines")
    joined = rows.drop("lines").join(digests, "digest", "left").join(hits, "_row", "left")
    none = F.array().cast("array<string>")
    return joined.select("doc_id", "licence", F.coalesce("notices", none).alias("notices"), F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan the whole ``documents`` table for KNOWN_LICENCES, notices and short texts, and for the whole licences of the folder."""
    known = spark.createDataFrame([*KNOWN_LICENCES, *whole_licences()], "licence string, text string")
    out = scan_licences(table(spark, sf_dir, "documents"), known)
    return out.select("doc_id", "licence", F.array_join("notices", ",").alias("notices"), "n_notices")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql(text: str, whole: bool) -> str:
    text = f"lower({text})"
    for other, one in SPELLINGS:
        text = f"replace({text}, {_quoted(other)}, {_quoted(one)})"
    bare = lambda x: f"trim(regexp_replace({x}, {_quoted(PUNCTUATION)}, ' ', 'g'), ' ')"
    if not whole:
        return bare(text)
    body = f"regexp_replace(chr(10) || {text} || chr(10), {_quoted(COPYRIGHT_LINE)}, chr(10), 'g')"
    return f"coalesce(nullif({bare(f'regexp_replace({body}, {_quoted(RIGHTS_LINE)}, chr(10), {_quoted("g")})')}, ''), {bare(text)})"


ORACLE_SQL = f"""
WITH k AS (SELECT * FROM (VALUES {", ".join(f"({_quoted(n)}, {_quoted(t)})" for n, t in (*KNOWN_LICENCES, *whole_licences()))}) AS v(licence, body)),
f AS (SELECT licence, {_sql("body", True)} AS form FROM k UNION ALL SELECT licence, {_sql("body", False)} FROM k),
d AS (SELECT sha256(form) AS digest, min(licence) AS licence FROM f WHERE form <> '' GROUP BY 1),
r AS (SELECT doc_id, text, row_number() OVER () AS r FROM documents),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM r),
h AS (SELECT r, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices, count(*) AS n_notices
      FROM (SELECT r, sha256({_sql("line", False)}) AS digest FROM l) JOIN d USING (digest) GROUP BY r)
SELECT r.doc_id, d.licence, coalesce(h.notices, '') AS notices, coalesce(h.n_notices, 0)::BIGINT AS n_notices
FROM r LEFT JOIN d ON d.digest = sha256({_sql("r.text", True)}) LEFT JOIN h ON h.r = r.r
"""
