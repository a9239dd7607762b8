"""License scans by canonical digests.

A text is made canonical: every run of anything but ASCII letters and digits is a blank, letters are lower case,
lines that are a copyright notice go, and spellings that licence lists treat as equal become one. A notice begins with
a copyright sign, or with the word and has a sign after it or a year: a licence's own line that happens to be wrapped
before "copyright holder" stays. Whole documents and each of their lines, as entire texts, are hash-joined by digest
with known licence texts and notices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Spellings that are treated as equal, and public licence texts and standard notices.
EQUAL = (
    ("licence", "license"), ("licenced", "licensed"), ("licences", "licenses"), ("copyright holder", "copyright owner"), ("copyright holders", "copyright owners"),
    ("sublicence", "sublicense"), ("sub license", "sublicense"), ("non infringement", "noninfringement"), ("non commercial", "noncommercial"), ("organisation", "organization"), ("favour", "favor"),
    ("acknowledgement", "acknowledgment"), ("authorised", "authorized"), ("merchantibility", "merchantability"), ("per cent", "percent"), ("whilst", "while"), ("wilful", "willful"),
    ("http", "https"),
)
_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so'
_BSD = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
_ISC = 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted'
_ISC_END = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
KNOWN = (
    ("MIT", f"MIT License\n\n{_GRANT}, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n{_WARRANTY}"),
    ("MIT", f"{_GRANT}, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n{_WARRANTY}"),
    ("MIT-0", f"MIT No Attribution\n\n{_GRANT}.\n\n{_WARRANTY}"),
    ("BSD-2-Clause", f"{_BSD_HEAD}{_BSD}"),
    ("BSD-3-Clause", f"{_BSD_HEAD}3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n{_BSD}"),
    ("ISC", f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_END}"),
    ("0BSD", f"{_ISC}.\n\n{_ISC_END}"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", f"This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\n{_WARRANTY.replace('AUTHORS OR COPYRIGHT HOLDERS', 'AUTHORS')}\n\nFor more information, please refer to <https://unlicense.org>"),
)
# Digests of the canonical forms of whole public licence texts, as their publishers give them.
DIGESTS = (
    ("Apache-2.0", "c356b639d57258a01ba9d9ac97344c26"),
    ("Artistic-1.0-Perl", "2fe792d1191a708e71b9beca097682bd"),
    ("BSD-3-Clause", "ddcd765ed0a3236bf96e15f76c36983a"),
    ("CC0-1.0", "d2a76f70ce19809695b7fb93c6241c23"),
    ("GFDL-1.2-only", "0ddc974af2022d1eb483df77268fc903"),
    ("GFDL-1.3-only", "6dcd514fc8d59959d92fedf319737026"),
    ("GPL-1.0-only", "dffcc23cae41db415bb27b7987712965"),
    ("GPL-2.0-only", "d12bd1861b765e3ef34910ec8272e64b"),
    ("GPL-3.0-only", "7c84c57719c51d58b686442de8f8471b"),
    ("LGPL-2.0-only", "ebf358251bfe9161668a8c8251261977"),
    ("LGPL-2.1-only", "1ff066c677365f47fea81c911a7c822e"),
    ("LGPL-3.0-only", "b31b7335bc37919e8cdd79154e04d88d"),
    ("MPL-1.1", "bba4061456cdbf0de00fa6bd343f6cb3"),
    ("MPL-2.0", "a27e119cd87d765a971af4667b2bf9b1"),
)
BROADCAST_BYTES = 8 << 20


#: A copyright sign as a word of its own, and what a line of a notice looks like. Words have two blanks between them, so
#: that each has its own on either side.
SIGNS, SIGN = ("©", "(c)", "(C)"), "copyrightsign"
NOTICE = f"^ +(?:{SIGN} |copyright +{SIGN} |copyright (?:.* )?(?:19|20)[0-9][0-9] |all  rights  reserved )"


def marked_lines(text: Column) -> Column:
    """Lower-case lines, words two blanks apart with two at either end, those empty or of a copyright notice left out."""
    marked = F.coalesce(text.cast("string"), F.lit(""))
    for sign in SIGNS:
        marked = F.replace(marked, F.lit(sign), F.lit(f" {SIGN} "))
    flat = F.lower(F.regexp_replace(F.concat(F.lit("\n"), marked, F.lit("\n")), "[^A-Za-z0-9\n]+", "  "))
    kept = F.filter(F.split(F.regexp_replace(flat, " *\n *", "  \n  "), "\n"), lambda x: (F.trim(x) != "") & ~x.rlike(NOTICE))
    return F.filter(F.transform(kept, lambda x: F.replace(x, F.lit(f" {SIGN} "), F.lit(""))), lambda x: F.trim(x) != "")


def canonical(words: Column) -> Column:
    """Equal spellings made one, words one blank apart."""
    for a, b in EQUAL:
        words = F.replace(words, F.lit(f" {a.replace(' ', '  ')} "), F.lit(f" {b.replace(' ', '  ')} "))
    return F.trim(F.regexp_replace(words, " +", " "))


def digest_of(lines: Column) -> Column:
    """md5 of the words of marked lines: line breaks don't count."""
    return F.md5(canonical(F.regexp_replace(F.array_join(lines, ""), " +", "  ")))


def known_digests(spark: SparkSession, known: tuple[tuple[str, str], ...] = KNOWN, digests: tuple[tuple[str, str], ...] = DIGESTS) -> DataFrame:
    """(digest, license), one row for each digest: of two licences with one text the first by name."""
    table = spark.createDataFrame(list(known), "license string, text string").withColumn("lines", marked_lines(F.col("text")))
    both = table.select(digest_of(F.col("lines")).alias("digest"), "license").unionByName(spark.createDataFrame(list(digests), "license string, digest string"))
    return both.groupBy("digest").agg(F.min("license").alias("license"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: tuple[tuple[str, str], ...] = KNOWN, digests: tuple[tuple[str, str], ...] = DIGESTS) -> DataFrame:
    """(doc_id, text_digest, text_license, n_notices, notice_licenses), one row for each row of docs.

    text_license: of the whole text, null if unknown; n_notices: its lines that as entire texts are known;
    notice_licenses: their distinct names, sorted, comma-joined, empty for none. A null text is an empty one (its digest
    is that of no words), a null id stays null, repeated rows are repeated. An empty table gives no rows; other columns
    are not read. The text is read once; a task sums up a row's lines before the shuffle, which moves one small row each.
    """
    lines = F.col("lines")
    units = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), marked_lines(F.col(text_col)).alias("lines")).select(
        "row", "doc_id", F.explode(F.concat(F.array(F.struct(F.lit(True).alias("whole"), digest_of(lines).alias("digest"))), F.transform(lines, lambda x: F.struct(F.lit(False).alias("whole"), F.md5(canonical(x)).alias("digest"))))).alias("u")
    )
    table = known_digests(docs.sparkSession, known, digests)
    small = sum(len(n) + len(t) for n, t in (*known, *digests)) < BROADCAST_BYTES  # digests are shorter than what they're of
    joined = units.select("row", "doc_id", "u.whole", "u.digest").join(F.broadcast(table) if small else table, "digest", "left")
    return joined.groupBy("row", "doc_id").agg(
        F.min(F.when(F.col("whole"), F.col("digest"))).alias("text_digest"),
        F.min(F.when(F.col("whole"), F.col("license"))).alias("text_license"),
        F.count(F.when(~F.col("whole"), F.col("license"))).alias("n_notices"),
        F.array_join(F.array_sort(F.collect_set(F.when(~F.col("whole"), F.col("license")))), ",").alias("notice_licenses"),
    ).drop("row")


def license_sql(known: tuple[tuple[str, str], ...] = KNOWN, digests: tuple[tuple[str, str], ...] = DIGESTS) -> str:
    """The same as DuckDB SQL."""

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def lines(x: str) -> str:
        marked = f"coalesce({x}, '')"
        for sign in SIGNS:
            marked = f"replace({marked}, '{sign}', ' {SIGN} ')"
        out = f"regexp_replace(lower(regexp_replace(chr(10) || {marked} || chr(10), '[^A-Za-z0-9\\n]+', '  ', 'g')), ' *\\n *', '  ' || chr(10) || '  ', 'g')"
        kept = f"list_filter(string_split({out}, chr(10)), lambda x: trim(x) <> '' and not regexp_matches(x, '{NOTICE}'))"
        return f"list_filter(list_transform({kept}, lambda x: replace(x, ' {SIGN} ', '')), lambda x: trim(x) <> '')"

    def canonical(x: str) -> str:
        for a, b in EQUAL:
            x = f"replace({x}, ' {a.replace(' ', '  ')} ', ' {b.replace(' ', '  ')} ')"
        return f"trim(regexp_replace({x}, ' +', ' ', 'g'))"

    text = "regexp_replace(array_to_string(lines, ''), ' +', '  ', 'g')"
    whole = f"md5({canonical(text)})"
    values = ", ".join(f"({quoted(n)}, {quoted(t)})" for n, t in known)
    more = ", ".join(f"({quoted(n)}, {quoted(t)})" for n, t in digests)
    return f"""
with every as (select {whole} as digest, license from (select license, {lines("text")} as lines from (values {values}) k(license, text)) union all select digest, license from (values {more}) d(license, digest)),
known as (select digest, min(license) as license from every group by 1),
docs as (select row_number() over () as r, doc_id, {lines("text")} as lines from documents),
units as (select r, doc_id, true as whole, {whole} as digest from docs union all select r, doc_id, false, md5({canonical("line")}) from (select r, doc_id, unnest(lines) as line from docs))
select doc_id, min(case when whole then digest end) as text_digest, min(case when whole then license end) as text_license,
  count(case when not whole then license end) as n_notices, coalesce(string_agg(distinct case when not whole then license end, ',' order by case when not whole then license end), '') as notice_licenses
from units left join known using (digest) group by r, doc_id"""
