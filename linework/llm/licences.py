"""Licence scanning by diagonal voting, with DataFrame functions alone."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linework.llm.common import BETWEEN, PREFIX_BITS, UPPER, checked_broadcast, in_bitmap, let, prefix_bitmap, word_count, words
from linework.sources.scratch import save

#: The base phrases and their labels (fixed values).
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: What the method labels besides: short notices, then whole public licence texts and standard headers (fixed values).
NOTICES = (
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("licensed under the gnu general public license version 2", "gpl-2.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under cc by 4 0", "cc-by-4.0"),
    ("released under the mit license", "mit-notice"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "mit-text"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("This is free and unencumbered software released into the public domain.", "unlicense"),
    (
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING
BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE
USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        "mit-text",
    ),
    (
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright
notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE
USE OR PERFORMANCE OF THIS SOFTWARE.""",
        "isc",
    ),
    (
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must
reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT,
INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
        "bsd-2-clause",
    ),
    (
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must
reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior
written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY
DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE,
DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
        "bsd-3-clause",
    ),
    (
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use
of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely,
subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this
software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such,
and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.""",
        "zlib",
    ),
    (
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the
License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
limitations under the License.""",
        "apache-2.0",
    ),
    (
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
        "gpl-3.0-or-later",
    ),
    (
        """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
        "gpl-2.0-or-later",
    ),
    (
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain
one at https://mozilla.org/MPL/2.0/.""",
        "mpl-2.0",
    ),
)
#: Words of a gram that votes: of a phrase, and of a notice.
SHORT, LONG = 2, 3
#: Words on either side of a shared gram that are compared with the template as well.
REACH = 4
#: Diagonals at most a tenth of the template, and eight words, apart are one match with words put in or left out.
DRIFT, MOST_DRIFT = 10, 8
#: A match drifts by an eighth of the template at most, or twice MOST_DRIFT words: so its words stand in order, but for that, in a span of about its length.
SPREAD = 8
#: The share of a notice's words that must agree.
COVERAGE = 0.8


def template_words(text: str) -> list[str]:
    """The words of a template, as those of a document."""
    return [w for w in re.split("[" + re.escape(BETWEEN) + "]+", text.translate(str.maketrans(UPPER, UPPER.lower()))) if w]


def least_words(size: int) -> int:
    """Words that a diagonal must agree in to count: a sixteenth of the template, at least a gram."""
    return max(LONG, size // 16)


def _hash(of: list[Column]) -> Column:
    """The hash of a gram: of two words, or of the hashes of its two pairs."""
    return F.xxhash64(*of) if len(of) == SHORT else F.xxhash64(F.xxhash64(*of[:2]), F.xxhash64(*of[1:]))


def templates(spark: SparkSession, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """One row per gram of each template: template, label, base, size, apart, least, numbers (places of its numbers), at, tw (its words), h.

    A phrase has SHORT to 63 words, a notice at least five, however long.
    """
    rows = []
    for n, (text, label, base) in enumerate([*((t, x, True) for t, x in phrases), *((t, x, False) for t, x in notices)]):
        w = template_words(text)
        k = SHORT if base else LONG
        if not (SHORT if base else 5) <= len(w):
            raise ValueError(f"template {label} has {len(w)} words")
        numbers = [i for i, x in enumerate(w) if x.isdigit()]
        rows += [(n, label, base, len(w), min(len(w) // DRIFT, MOST_DRIFT), least_words(len(w)), numbers, i, w) for i in range(len(w) - k + 1)]
    table = spark.createDataFrame(rows, "template int, label string, base boolean, size int, apart int, least int, numbers array<int>, at int, tw array<string>")
    at = [F.get("tw", F.col("at") + i) for i in range(LONG)]
    return table.withColumn("h", F.when(F.col("base"), _hash(at[:SHORT])).otherwise(_hash(at)))


def _prefix(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - PREFIX_BITS)


def _grams(docs: DataFrame, short: Column, long: Column) -> DataFrame:
    """id, th, base, pos (from 0), h, before and around of each gram of two or three words whose hash the
    bitmaps know: around has the words about it, before of them stand before it."""
    after = lambda c, k: F.slice(c, k + 1, F.greatest(F.size(c) - k, F.lit(0)))
    pair = lambda a, b: F.xxhash64(a, b)

    def found(w: Column, hashes: Column, k: int, bitmap: Column, reach: int, base: bool) -> Column:
        at = F.filter(F.transform(hashes, lambda h, i: F.struct(i.alias("pos"), h.alias("h"))), lambda x: in_bitmap(_prefix(x["h"]), bitmap))

        def row(x: Column) -> Column:
            before = F.least(x["pos"], F.lit(reach))
            return F.struct(F.lit(base).alias("base"), x["pos"].alias("pos"), x["h"].alias("h"), before.alias("before"), F.slice(w, x["pos"] - before + 1, before + k + reach).alias("around"))

        return F.transform(at, row)

    def all_of(w: Column) -> Column:
        pairs = F.slice(F.zip_with(w, after(w, 1), pair), 1, F.greatest(F.size(w) - 1, F.lit(0)))
        triples = lambda g: F.slice(F.zip_with(g, after(g, 1), pair), 1, F.greatest(F.size(g) - 1, F.lit(0)))
        return let(pairs, lambda g: F.concat(found(w, g, SHORT, short, 0, True), found(w, triples(g), LONG, long, REACH, False)))

    return docs.select("id", "th", F.explode(let(words(F.col("text")), all_of)).alias("g")).select("id", "th", "g.*")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """(id_col, n_words, n_base, first_word, last_word, base_labels, labels, score) per row of docs.

    Grams of the documents join the template positions by hash (those whose hash no template has are
    left out by a bitmap before), and their words must be the template's.  A shared gram votes
    for its diagonal with the template words that agree there, its own and those up to REACH beside
    it, so repeated rows don't count twice.  Diagonals with few votes are dropped, neighbouring ones
    merge, but only so far apart as SPREAD allows (two spans that overlap by half hold every match that is not wider).  A phrase stands where its diagonal has all its words.  A notice's label is given where
    COVERAGE of its words agree, all its numbers (versions) among them; score is the best
    coverage (1 for a phrase).  Templates are constants of the code or of the caller; their table is
    broadcast if it fits.  Texts are read once and never shuffled.

    Null and empty texts have no words, no labels (empty strings) and score 0; rows with the same id
    and text get the same result each; other columns are ignored, so their names can't clash.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    t = save(templates(docs.sparkSession, phrases, notices), "licence-templates")
    prefixes = lambda base: [r[0] for r in t.where(F.col("base") == base).select(_prefix(F.col("h"))).distinct().collect()]
    widest = t.agg(F.max(F.size("tw") * 24)).first()[0] or 0
    grams = _grams(docs, prefix_bitmap(prefixes(True)), prefix_bitmap(prefixes(False)))
    met = grams.join(checked_broadcast(t, 64 + widest), ["base", "h"])
    size = F.when(F.col("base"), SHORT).otherwise(LONG)
    met = met.where(F.slice("around", F.col("before") + 1, size) == F.slice("tw", F.col("at") + 1, size))
    agreed = F.filter(F.transform("around", lambda w, i: F.when(w == F.get("tw", F.col("at") - F.col("before") + i), F.col("at") - F.col("before") + i)), lambda p: p.isNotNull())
    agreed = F.when(F.col("base"), F.sequence("at", F.col("at") + SHORT - 1)).otherwise(agreed)
    voted = met.select("id", "th", "template", "label", "base", "size", "apart", "least", "numbers", (F.col("pos") - F.col("at")).alias("diagonal"), F.explode(agreed).alias("place"))
    key = ["id", "th", "template", "label", "base", "size", "apart", "least", "numbers"]
    lines = save(voted.groupBy(*key, "diagonal").agg(F.collect_set("place").alias("held")), "licence-votes")
    order = Window.partitionBy("id", "th", "template").orderBy("diagonal")
    strong = lines.where(~F.col("base") & (F.size("held") >= F.col("least"))).withColumn("step", F.col("diagonal") - F.lag("diagonal").over(order))
    runs = strong.withColumn("run", F.sum((F.col("step").isNull() | (F.col("step") > F.col("apart"))).cast("int")).over(order)).withColumn("first", F.min("diagonal").over(Window.partitionBy("id", "th", "template", "run")))
    half = F.greatest(F.floor(F.col("size") / SPREAD), F.lit(2 * MOST_DRIFT))
    nth = F.floor((F.col("diagonal") - F.col("first")) / half)
    runs = runs.withColumn("span", F.explode(F.array(nth, nth - 1))).groupBy(*key, "run", "span").agg(F.array_distinct(F.flatten(F.collect_list("held"))).alias("held"))
    share = F.when(F.size(F.array_except("numbers", "held")) == 0, F.size("held") / F.col("size")).otherwise(0.0)
    noted = runs.select("id", "th", "label", share.alias("coverage")).groupBy("id", "th").agg(F.collect_set(F.when(F.col("coverage") >= COVERAGE, F.col("label"))).alias("more"), F.max("coverage").alias("best"))
    whole = lines.where("base").where(F.size("held") == F.col("size"))
    based = whole.groupBy("id", "th").agg(F.count("*").alias("n_base"), F.min("diagonal").cast("long").alias("first_word"), F.max("diagonal").cast("long").alias("last_word"), F.collect_set("label").alias("base"))
    none = F.array().cast("array<string>")
    found = noted.withColumnsRenamed({"id": "nid", "th": "nth"})
    found = based.join(found, based["id"].eqNullSafe(found["nid"]) & (based["th"] == found["nth"]), "full").select(F.coalesce("id", "nid").alias("fid"), F.coalesce("th", "nth").alias("fth"), "n_base", "first_word", "last_word", F.coalesce("base", none).alias("base"), F.coalesce("more", none).alias("more"), "best")
    n = docs.select("id", "th", word_count(F.col("text")).alias("n_words"))
    out = n.join(found, n["id"].eqNullSafe(found["fid"]) & (n["th"] == found["fth"]), "left")
    listed = lambda a: F.coalesce(F.concat_ws(",", F.array_sort(a)), F.lit(""))
    return out.select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        listed(F.col("base")).alias("base_labels"), listed(F.array_union("base", "more")).alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
