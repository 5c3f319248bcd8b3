"""Licence notices inside texts.

A notice is a set of word shingles. Windows that overlap by half run over a text, in one size
for each size of notice; MinHash values of windows meet those of notices, any one agreeing
value being enough, and the share of the notice's shingles the window holds decides. Only
texts with at least one shingle of some notice have windows made, which loses nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm.storage import Workspace
from veilframe.llm.text import WHITE, only

SHINGLE = 5
CONTAINMENT = 0.8
# A window has at most four times the notice's shingles, so with four fifths of them the
# similarity is 0.19 at least, and the chance that no value agrees (1 - 0.19)^64 < 2e-6.
HASHES = 64
# Notices of up to so many shingles together travel with every task; more are joined as a table.
MOST_SHINGLES = 20_000
_WHITE_CHARS = "".join(map(chr, WHITE))
_WHITE_CODES = "".join(rf"\x{c:02x}" for c in WHITE)
# Stripped from both ends of words, in notices and texts alike.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\u2018\u2019\u201c\u201d\u2013\u2014\u00ab\u00bb\u2022\u00b7"

# Wording of common licence notices.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction",
    ),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met",
    ),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    (
        "MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of
        the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
        THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
        AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
        CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
        DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "ISC",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
        ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
        DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
        WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE
        USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "BSD-2-Clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
        the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
        following disclaimer in the documentation and/or other materials provided with the distribution.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
        WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
        PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT,
        INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF
        SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
        THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING
        IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    (
        "Apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
        on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for
        the specific language governing permissions and limitations under the License.""",
    ),
    (
        "GPL-3.0-or-later",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
        any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
        without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General
        Public License for more details. You should have received a copy of the GNU General Public License along with
        this program. If not, see <https://www.gnu.org/licenses/>.""",
    ),
    (
        "MPL-2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
        not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    ),
    (
        "Unlicense",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for
        any purpose, commercial or non-commercial, and by any means.""",
    ),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
)


def _word_gap() -> str:
    """White space with what punctuation surrounds it. A match begins where a run of
    punctuation does, so that no run is tried from each of its places."""
    mark = "".join(f"\\x{{{ord(c):x}}}" for c in PUNCTUATION)
    return rf"(?<![{mark}])[{mark}]*+[{_WHITE_CODES}][{_WHITE_CODES}{mark}]*+"


def _words(text: Column) -> Column:
    lower = F.lower(F.coalesce(text, F.lit("")))
    trimmed = F.btrim(lower, F.lit(_WHITE_CHARS + PUNCTUATION))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _word_gap()))


def _shingles(words: Column, make) -> Column:
    n = F.size(words)
    each = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: make([F.get(words, i + k) for k in range(SHINGLE)]))
    return F.when(n >= SHINGLE, each)


def _values(hashes: Column) -> Column:
    """MinHash values of a set of shingle hashes, one for each seed."""
    seeds = F.sequence(F.lit(1), F.lit(HASHES))
    return F.transform(seeds, lambda s: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, s))))


def notices(spark: SparkSession, texts: Sequence[tuple[str, str]] | DataFrame = NOTICES) -> DataFrame:
    """(notice, license, shingles, hashes, span) of each notice of at least five words, from
    pairs (license, text), numbered in order, or a table (notice, license, text). ``span`` is
    a power of two from the number of its shingles to less than twice that."""
    if isinstance(texts, DataFrame):
        rows = only(texts, "notice", "license", "text").repartition("notice")
    else:
        rows = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "notice int, license string, text string")
    worded = rows.withColumn("words", _words(F.col("text")))
    made = worded.select(
        "notice",
        "license",
        F.array_distinct(_shingles(F.col("words"), lambda w: F.concat_ws(" ", *w))).alias("shingles"),
        # Word by word, as in the texts.
        F.array_distinct(_shingles(F.transform("words", lambda w: F.xxhash64(w)), lambda h: F.xxhash64(*h))).alias("hashes"),
    ).where("shingles IS NOT NULL")
    return made.withColumn("span", F.pow(F.lit(2), F.ceil(F.log2(F.size("shingles")))).cast("int"))


def scan(
    docs: DataFrame,
    texts: Sequence[tuple[str, str]] | DataFrame = NOTICES,
    containment: float = CONTAINMENT,
    id_col: str = "doc_id",
    text_col: str = "text",
    most_shingles: int = MOST_SHINGLES,
) -> DataFrame:
    """(id, license, notice, containment) for each row and notice some window of whose text
    holds at least that share of the notice's word shingles; the greatest share counts.

    Case and punctuation around words are ignored. Null and empty texts hold nothing, notices
    of fewer than five words are never found; of rows equal in id and text one counts, others
    are documents of their own, also without an id. A collection of over ``most_shingles``
    shingles gives the same result by a shuffle, without the look ahead at shingles.
    """
    known = notices(docs.sparkSession, texts)
    if isinstance(texts, DataFrame):
        known = Workspace(docs.sparkSession, "licences").store(known)
    size = known.agg(F.sum(F.size("shingles")).alias("shingles"), F.collect_set("span").alias("spans")).first()
    spans = sorted(size.spans)
    few = (size.shingles or 0) <= most_shingles
    rows = only(docs, id_col, text_col).toDF("id", "text").withColumn("words", _words(F.col("text")))
    hashed = rows.select(
        "id", F.xxhash64("text").alias("copy"), "words", F.transform("words", lambda w: F.xxhash64(w)).alias("each")
    )
    found = hashed.select(
        "id", "copy", "words", _shingles(F.col("each"), lambda h: F.xxhash64(*h)).alias("hashes")
    )
    if not spans:
        empty = found.select("id", F.lit("").alias("license"), F.lit(0).alias("notice"), F.lit(0.0).alias("containment"))
        return empty.where(F.lit(False)).withColumnRenamed("id", id_col)
    if few:
        kept = known.collect()
        held = docs.sparkSession.createDataFrame([tuple(row) for row in kept], known.schema)
        here = F.arrays_overlap("hashes", F.lit(sorted({h for row in kept for h in row.hashes})))
    else:
        held, here = known, F.size("hashes") > 0
    # Exploding nothing drops a row. A filter would be pushed below the shingles and make them
    # again for every place in the text.
    sized = found.select("id", "copy", "words", "hashes", F.explode(F.when(here, F.lit(spans))).alias("span"))
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.size("hashes") - 1, F.lit(0)), F.col("span")))
    windows = sized.select("id", "copy", "span", "words", "hashes", starts.alias("start")).select(
        "id",
        "copy",
        "span",
        F.slice("words", F.col("start") + 1, 2 * F.col("span") + SHINGLE - 1).alias("words"),
        F.slice("hashes", F.col("start") + 1, 2 * F.col("span")).alias("hashes"),
    )
    values = F.when(here, _values(F.col("hashes")))
    signed = windows.select("id", "copy", "span", "words", F.posexplode(values).alias("seed", "value"))
    signs = held.select("notice", "license", "shingles", "span", F.posexplode(_values(F.col("hashes"))).alias("seed", "value"))
    # Few are at most MOST_SHINGLES notices of HASHES rows each.
    met = signed.join(F.broadcast(signs) if few else signs, ["span", "seed", "value"])
    inside = _shingles(F.col("words"), lambda w: F.concat_ws(" ", *w))
    share = F.size(F.array_intersect("shingles", inside)) / F.size("shingles")
    return (
        met.select("id", "copy", "license", "notice", share.alias("containment"))
        .groupBy("id", "copy", "license", "notice")
        .agg(F.max("containment").alias("containment"))
        .where(F.col("containment") >= containment)
        .drop("copy")
        .withColumnRenamed("id", id_col)
    )
