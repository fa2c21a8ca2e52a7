"""Licence scan by canonical digests.

A text is brought into canonical form: lower case, copyright lines removed,
everything but letters and digits made one space, equivalent spellings made
one. The digest of the whole canonical text is hash-joined with the digests
of known licence texts; the same is done with each line, which is how short
notices stand in documents. Short known texts are held as they are, long ones
by their canonical digests, which are those of the texts as they are commonly
distributed; a folder of further texts can be added. The known table is a
constant of this module, so its broadcast does not grow with the data; that
of a folder is counted first.

As copyright lines go whole, a long licence that is wrapped at other places
has another digest where one of its own lines begins with that word.

Defined results: null and blank texts have the digest of the empty text and
no licence; repeated rows are scanned each on its own; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Beginnings of words that are spelt in two ways, and the one used; applied in this order. Fixed values.
SPELLINGS = (
    (" licenc", " licens"), (" sub licens", " sublicens"), (" organis", " organiz"), (" authoris", " authoriz"),
    (" recognis", " recogniz"), (" utilis", " utiliz"), (" realis", " realiz"), (" favour", " favor"),
    (" behaviour", " behavior"), (" e mail", " email"), (" non commercial", " noncommercial"), (" whilst ", " while "),
    (" per cent ", " percent "), (" merchantibility ", " merchantability "), (" fulfilment ", " fulfillment "),
)
#: Lines that only say whose the text is.
COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n]*(copyright|\(c\)|©|all rights reserved)[^\n]*$"
#: Only lines with one of these can be a known notice: each known text has one.
MARK = r"(?i)licen|permission|redistribution"

_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_AUTHOR = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_REDIST = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n" + _WARRANTY
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n" + _AUTHOR
_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\nhttp://www.apache.org/licenses/LICENSE-2.0\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""
#: (licence, text): public licence texts and the notices that name a licence; fixed values.
KNOWN = (
    ("MIT", _MIT), ("MIT", "MIT License\n" + _MIT), ("MIT", "The MIT License (MIT)\n" + _MIT),
    ("ISC", _ISC), ("ISC", "ISC License\n" + _ISC),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + _AUTHOR),
    ("BSD-2-Clause", _REDIST + _BSD),
    ("BSD-3-Clause", _REDIST + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n" + _BSD),
    ("Apache-2.0", _APACHE), ("Unlicense", _UNLICENSE), ("Unlicense", _UNLICENSE + "For more information, please refer to <https://unlicense.org>"), ("Unlicense", _UNLICENSE + "For more information, please refer to <http://unlicense.org/>"),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "This project is licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "Released under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "Licensed under the GNU General Public License, version 3."), ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
)

#: (licence, digest of the canonical form of its whole text); fixed values.
DIGESTS = (
    ("Apache-2.0", "a926a90b3c0a8655acc39a762385451ec7780a40ff51efcebbe1aa61f276fb07"),
    ("Artistic-1.0-Perl", "156ea114802e980c9f8581dd18b8b55a8361edd115f7fe75024213e44424ed7e"),
    ("CC0-1.0", "3e6e368fd02abd67188d1bf25b196ac79f5782b2079e9579134c5e3f71f9ab74"),
    ("GFDL-1.2", "aea6038a701fc689af000f5d68aea404e3b4687ea875aea0e78acfd5dd6dfeee"),
    ("GFDL-1.3", "caa7b41c65ff5e92e1ba9af89759decfd1356c2acf3e1e5e238c3b7a7e5337f7"),
    ("GPL-1.0", "33d98ff41562c09dfe36872170aead2a9e1e374cee5b97fd749ca83088665e41"),
    ("GPL-2.0", "2459d0b759a85e7f8584d32ab04131d27dab1b6fd11644fcaf2fc5caf8db2ae7"),
    ("GPL-3.0", "d60c230a33a8c40d7faa034ed52950460f8168d531aa2f2abcce422231eaf48f"),
    ("LGPL-2.0", "954890b464598853673509c334974ad7f9ab367de826784aea2071f5ba278174"),
    ("LGPL-2.1", "9b69d00b4bccc9b1926b5da285024ec98a15727a8e9a5388aa118b10f4a79cf0"),
    ("LGPL-3.0", "f0cae4b317f4f263dca8e79625f8d9c7618c87e0ca6665c79b0f1c12ac856938"),
    ("MPL-1.1", "260b601de5d5e5ec00bd903c42a1ac3b0cf3eebd7b1e529b025961a8d981cb56"),
    ("MPL-2.0", "a90ba5346ad1927fede05edb2d96afdd4948d68d16cef5d29e84239426134356"),
    ("BSD-3-Clause", "48c8a35a4353dae3524b849cfd2c781b3c935e964f465e15fb0bc23f23cf96ad"),
)
#: Most texts of a folder of further licences.
FOLDER_TEXTS = 10_000


def canonical(text: Column) -> Column:
    """The canonical form of a text, words parted by single spaces, one space at each end."""
    text = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, " ")
    text = F.concat(F.lit(" "), F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    text = F.replace(F.replace(text, F.lit("  "), F.lit(" ")), F.lit("  "), F.lit(" "))
    for a, b in SPELLINGS:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession, folder: str | None = None) -> DataFrame:
    """digest and licence of each known text. ``folder``: further texts, each a file named after its licence."""
    table = spark.createDataFrame(list(KNOWN), "license string, text string")
    found = table.select(digest(F.col("text")).alias("digest"), "license").unionByName(spark.createDataFrame(list(DIGESTS), "license string, digest string"))
    if folder is not None:
        own = spark.read.text(folder, wholetext=True).select(digest(F.col("value")).alias("digest"), F.regexp_extract("_metadata.file_name", r"^(.*?)(\.txt)?$", 1).alias("license"))
        if own.limit(FOLDER_TEXTS + 1).count() > FOLDER_TEXTS:
            raise ValueError(f"a folder holds at most {FOLDER_TEXTS} licence texts")
        found = found.unionByName(own)
    return found.groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """doc_id, text_digest, text_license, notice_licenses (distinct, sorted, comma-joined), n_notices.

    Each text becomes a row for itself and one for each line that could be a
    notice; digests, not texts, go through the join and the regrouping.
    """
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(MARK))
    units = docs.select("doc_id", F.monotonically_increasing_id().alias("_row"), digest(text).alias("text_digest"), F.transform(lines, digest).alias("lines"))
    whole = F.struct(F.lit(True).alias("whole"), F.col("text_digest").alias("digest"))
    each = F.transform("lines", lambda d: F.struct(F.lit(False).alias("whole"), d.alias("digest")))
    units = units.select("doc_id", "_row", "text_digest", F.explode(F.concat(F.array(whole), each)).alias("unit"))
    known = known_digests(docs.sparkSession, folder).withColumnRenamed("digest", "_digest")
    found = units.join(F.broadcast(known), F.col("unit.digest") == F.col("_digest"), "left")
    line = F.when(~F.col("unit.whole"), F.col("license"))
    return found.groupBy("_row", "doc_id", "text_digest").agg(
        F.max(F.when(F.col("unit.whole"), F.col("license"))).alias("text_license"),
        F.array_join(F.array_sort(F.collect_set(line)), ",").alias("notice_licenses"),
        F.count(line).alias("n_notices"),
    ).drop("_row")
