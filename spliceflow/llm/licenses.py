"""License scans: entire texts, brought to a canonical form, are looked up by digest among known licences and notices.

The canonical form drops copyright lines, lower-cases, reduces everything but letters and digits to single spaces, writes equivalent
spellings one way, and drops a title. The whole text is looked up, each paragraph, and each line of the paragraphs that aren't known: a
document may be a licence or carry a notice, wrapped or not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spliceflow.llm.common import cut

#: Licence identifiers with texts that grant them, without copyright lines and titles.
KNOWN = [
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("0BSD", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("BSD-3-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org>'),
    ("BSL-1.0", 'Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
]
#: Licences too long to be written out here, with the SHA-256 of the canonical form of their published texts and its length
#: and its first word (digests_of() gives them for a folder of such texts).
DIGESTS: list[tuple[str, str, int, str]] = [
    ("Apache-2.0", "5dc5dde8f70f588d016089ea161aff735414de2d1a1f4a65830bf660785ee5c7", 9887, "apache"),
    ("Artistic-1.0-Perl", "4eaaa9e33aeef0af0ff83ab5edac0ad421a1da9cc861c564630460107b4b772c", 5812, "preamble"),
    ("BSD-3-Clause", "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651", 1361, "redistribution"),
    ("CC0-1.0", "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e", 6691, "creative"),
    ("GFDL-1.2", "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60", 19583, "gnu"),
    ("GFDL-1.3", "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826", 22018, "gnu"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224", 11765, "gnu"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821", 17117, "gnu"),
    ("GPL-3.0", "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a", 33406, "gnu"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908", 24130, "gnu"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891", 25217, "gnu"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be", 7104, "gnu"),
    ("MPL-1.1", "118b2c814d7e3fa57c85f71b240c6a47d353e8acce9164ed6f28305ba85202b2", 22448, "mozilla"),
    ("MPL-2.0", "2ae5d4417f09cff2e3412d0e35c4ee2439f6c18ca69d7d9cc799b33614c368a5", 14342, "mozilla"),
]
#: Spellings that count as equal, written as the second. They hold for whole words of the canonical form.
SPELLINGS = [("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sub license", "sublicense"), ("non infringement", "noninfringement"), ("organisation", "organization"), ("favour", "favor"), ("behaviour", "behavior"), ("percent", "per cent"), ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"), ("acknowledgement", "acknowledgment"), ("https", "http")]
#: Titles in canonical form that may stand before a licence's text.
TITLES = ["mit license", "the mit license", "the mit license mit", "mit license mit", "isc license", "the isc license", "isc license isc", "isc license iscl", "bsd zero clause license", "zero clause bsd", "bsd 2 clause license", "the bsd 2 clause license", "bsd 3 clause license", "the bsd 3 clause license", "new bsd license", "zlib license", "the zlib license", "the unlicense", "the artistic license", "boost software license version 1 0 august 17th 2003"]
#: A line that names holders: the word or sign with a year, a bracket or the other sign behind it. "copyright notice" is none.
HOLDER_LINE = r"^[^\p{L}\p{N}\n]*(copyright\s*(\(c\)|©|[:,]?\s*([\[<{]|[0-9]{4}|by\s))|©|\(c\)\s*([0-9]{4}|copyright|[\[<{])|all rights reserved[^\p{L}\p{N}\n]*$)[^\n]*$"
GAP = r"[^\p{L}\p{N}]+"
TITLE = "^(" + "|".join(sorted(TITLES, key=len, reverse=True)) + ") (.+)$"
PARAGRAPHS = r"\n[ \t\r]*\n"


def canonical(text: Column) -> Column:
    """The canonical form; empty for null."""
    kept = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "(?md)" + HOLDER_LINE, " ")
    # Two spaces between words: neighbours that are both replaced don't share one.
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(kept, GAP, "  ")), F.lit(" "))
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(f" {old.replace(' ', '  ')} "), F.lit(f" {new.replace(' ', '  ')} "))
    return F.regexp_replace(F.trim(F.replace(out, F.lit("  "), F.lit(" "))), TITLE, "$2")


def digests_of(spark: SparkSession, folder: str) -> DataFrame:
    """(license, digest, length, first) of the text files of a folder, named by their files: rows for DIGESTS."""
    texts = spark.read.text(folder, wholetext=True).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("license"), canonical(F.col("value")).alias("c"))
    return _digested(texts)


def _digested(texts: DataFrame) -> DataFrame:
    return texts.select("license", F.sha2("c", 256).alias("digest"), F.length("c").alias("length"), F.split_part("c", F.lit(" "), F.lit(1)).alias("first"))


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None, digests: list[tuple[str, str, int, str]] | None = None) -> DataFrame:
    """(digest, license, length, first) of the known texts; their number is that of the lists, whatever the documents."""
    given = DIGESTS if known is None and digests is None else digests or []
    rows = _digested(spark.createDataFrame(known or KNOWN, "license string, text string").select("license", canonical(F.col("text")).alias("c")))
    rows = rows.union(spark.createDataFrame(given, "license string, digest string, length int, first string"))
    return rows.groupBy("digest", "length", "first").agg(F.min("license").alias("license"))


def _may_start(firsts: list[str]) -> str:
    """A pattern that every text (in lower case) matches whose canonical form begins with one of these words: most others don't."""
    spelled = [old.split()[0] for old, new in SPELLINGS if new.split()[0] in firsts]
    titled = {t.removeprefix("the ").split()[0] for t in TITLES}
    words = "|".join(sorted({*firsts, *spelled, *titled}))
    return rf"(?md)^[^\p{{L}}\p{{N}}\n]*(the[^\p{{L}}\p{{N}}]+)?({words})(?![\p{{L}}\p{{N}}])"


def license_scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, n_notices, notices) for each row of docs.

    license is that of the whole text, null if it is none; n_notices the number of paragraphs (between blank lines) that are a known text
    and of such lines in the others; notices their different licences, sorted and comma-joined (empty without any). Null and empty texts
    have none. Null ids and repeated rows are kept as they are; an empty table gives an empty one; other columns aren't read. known is
    small: a row for each known text.
    """
    small = F.broadcast(known.select("digest", F.col("license").alias("found")))
    rows = known.select("length", "first").collect()  # a row for each known text
    least, longest = min((r["length"] for r in rows), default=1), max((r["length"] for r in rows), default=0)
    start = _may_start(sorted({r["first"] for r in rows}))
    # What can't begin like a known text, or is too short (spellings lengthen a text by less than its length), isn't brought to the form.
    may_be = lambda x: (F.length(x) * 2 >= least) & F.lower(x).rlike(start)

    def digest(text: Column) -> Column:
        form = canonical(text)
        return F.when(F.length(form).between(least, longest), F.sha2(form, 256))

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    whole = numbered.select("row", "doc_id", "text", F.when(may_be(F.col("text")), digest(F.col("text"))).alias("digest")).join(small, "digest", "left")
    pieces = lambda of: F.filter(of, may_be)
    parts = whole.select("row", "doc_id", F.col("found").alias("license"), F.explode_outer(pieces(F.split("text", PARAGRAPHS))).alias("part"))
    parts = parts.withColumn("digest", digest(canonical(F.col("part")))).join(small, "digest", "left").select("row", "doc_id", "license", "found", F.when(F.col("found").isNull() & F.contains("part", F.lit("\n")), F.col("part")).alias("part"))
    lines = parts.select("row", "doc_id", "license", F.col("found").alias("of_part"), F.explode_outer(pieces(F.split("part", "\n"))).alias("line"))
    lines = lines.withColumn("digest", digest(canonical(F.col("line")))).join(small, "digest", "left").withColumn("found", F.coalesce("of_part", "found"))
    # Rows of one document lie together: they are combined before they are exchanged.
    out = lines.groupBy("row", "doc_id", "license").agg(F.count("found").alias("n_notices"), F.array_sort(F.collect_set("found")).alias("ids"))
    return out.select("doc_id", "license", "n_notices", F.concat_ws(",", "ids").alias("notices"))
