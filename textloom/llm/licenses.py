"""License scans by diagonal voting.

All rolling word k-grams of all texts are joined to the positions at which license templates have them. Hits vote for
their offset diagonal (place in the text minus place in the template), neighbouring diagonals of a template are merged,
so that a few inserted or dropped words don't split a span, and each span is verified on its words. Merging is bounded
by a share of the template's length, so that words that come back all the time don't chain into one span.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import ascii_lower, materialize, NO_ID, row_keys, same_row, small, table


@dataclass(frozen=True)
class LicenseSettings:
    k: int = 3
    #: Diagonals of a template that differ by so many words or fewer are one span, ...
    slack: int = 4
    #: ... if the span's diagonals differ by no more than this share of the template's words, or by ``slack`` words.
    spread: float = 0.25
    #: Share of a template's k-grams that a span must have.
    similarity: float = 0.8


# Label and notice.
TEMPLATES = (
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Released under the BSD License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc0", "To the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the
        Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
        substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
        WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source
        code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
        list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND
        CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
        DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT
        LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT,
        STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this
        permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF
        USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either
        version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
        warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public
        License along with this program. If not, see https://www.gnu.org/licenses/."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this
        software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the
        following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product,
        an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented
        as being the original software. 3. This notice may not be removed or altered from any source distribution."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in
        source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
)
# Base phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Score of a base phrase that stands in no span of a template; a span's is its similarity.
MENTION = 0.5

_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _BREAK), lambda w: w != "")


def _grams(words: Column, k: int) -> Column:
    """Hashes of all rolling k-grams; none for fewer words than k."""
    n = F.size(words)
    grams = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))
    return F.when(n >= k, grams).otherwise(F.array().cast("array<bigint>"))


def template_table(spark: SparkSession, templates: tuple[tuple[str, str], ...], k: int) -> DataFrame:
    """(template, label, t_words, t_grams) of each template."""
    rows = [(i, label, text) for i, (label, text) in enumerate(templates)]
    df = spark.createDataFrame(rows, "template int, label string, text string").withColumn("t_words", words_of(F.col("text")))
    return df.withColumn("t_grams", _grams(F.col("t_words"), k)).drop("text")


def _phrase_at(words: Column, i: Column, phrase: str) -> Column:
    out = F.lit(True)
    for j, w in enumerate(phrase.split()):
        out = out & F.coalesce(F.get(words, i + j) == w, F.lit(False))
    return out


def scan_licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, settings: LicenseSettings = LicenseSettings()) -> tuple[DataFrame, DataFrame]:
    """Base facts of each row of ``docs`` (doc_id, text), and verified template spans.

    The first: doc_id, n_words, starts (first words of base phrases, in order) and base (labels, sorted). The second:
    doc_id, label, first, end (words from the first to the last that meet the template), similarity; one row for each
    place of a template in a text. Null and blank texts
    have no words. Rows are told apart by doc_id, null or repeated, and text (columns __id and __row of both results);
    of rows equal in both each gets the same, spans stand once. Other columns aren't read.
    """
    spark, s = docs.sparkSession, settings
    worded = docs.select(*row_keys("text"), "doc_id", F.coalesce("text", F.lit("")).alias("text"), words_of(F.col("text")).alias("words"))
    found = lambda i: F.array_compact(F.array(*[F.when(_phrase_at(F.col("words"), i, p), F.struct(i.alias("at"), F.lit(label).alias("label"))) for p, label in PHRASES]))
    none = F.array().cast("array<struct<at:int,label:string>>")
    places = F.when(F.lower("text").contains("license"), F.flatten(F.transform(F.sequence(F.lit(0), F.size("words")), found))).otherwise(none)
    base = worded.select(*same_row, "doc_id", F.size("words").cast("long").alias("n_words"), places.alias("places"))
    base = base.select(*same_row, "doc_id", "n_words", F.transform("places", lambda p: p["at"].cast("long")).alias("starts"), F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"]))).alias("base"))

    known = template_table(spark, templates, s.k)  # a table of the program, a few dozen rows
    positions = known.select("template", F.posexplode("t_grams").alias("t_pos", "gram"))
    rolling = worded.select(*same_row, F.posexplode(_grams(F.col("words"), s.k)).alias("pos", "gram"))
    hits = rolling.join(F.broadcast(positions), "gram")
    diagonal = (F.col("pos") - F.col("t_pos")).alias("diagonal")
    votes = hits.groupBy(*same_row, "template", diagonal).agg(F.count("*").alias("votes"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    order = Window.partitionBy(*same_row, "template").orderBy("diagonal")
    new = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > s.slack).cast("int"), F.lit(1))
    runs = votes.withColumn("run", F.sum(new).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # a run is cut into cells as wide as a span may be, twice, half a cell apart, so that every span is whole in one of them
    width = F.greatest(F.lit(s.slack + 1), F.ceil(F.size("t_words") * s.spread)).cast("int")
    runs = runs.join(F.broadcast(known.select("template", width.alias("width"))), "template")
    runs = runs.withColumn("off", F.col("diagonal") - F.min("diagonal").over(Window.partitionBy(*same_row, "template", "run")))
    cells = F.array(F.floor(F.col("off") / F.col("width")) * 2, F.floor((F.col("off") + F.floor(F.col("width") / 2)) / F.col("width")) * 2 + 1)
    spans = runs.withColumn("cell", F.explode(cells)).groupBy(*same_row, "template", "run", "cell").agg(
        F.min("first").alias("first"), (F.max("last") + s.k).alias("end"), F.sum("votes").alias("votes")
    )
    spans = spans.join(F.broadcast(known), "template").filter(F.col("votes") >= s.similarity * F.size("t_grams"))
    spans = materialize(spans)
    ids = spans.select(*same_row).distinct()
    texts = docs.select(*row_keys("text"), "text").join(small(ids, ids.count()), same_row, "left_semi").dropDuplicates(same_row)
    texts = texts.select(*same_row, words_of(F.col("text")).alias("words"))
    checked = spans.join(texts, same_row).withColumn("own", F.slice("words", F.col("first") + 1, F.col("end") - F.col("first")))
    triples = lambda w: F.when(F.size(w) >= s.k, F.transform(F.sequence(F.lit(0), F.size(w) - s.k), lambda i: F.concat_ws(" ", *[F.get(w, i + j) for j in range(s.k)]))).otherwise(F.array().cast("array<string>"))
    own, theirs = triples(F.col("own")), triples(F.col("t_words"))
    similar = F.size(F.array_intersect(own, theirs)) / F.size(F.array_distinct(theirs))
    checked = checked.withColumn("similarity", similar).filter(F.col("similarity") >= s.similarity)
    # of cells that share words the one most like the template stays, the first of equals
    place = Window.partitionBy(*same_row, "template", "run").orderBy("first", "end")
    reach = F.max("end").over(place.rowsBetween(Window.unboundedPreceding, -1))
    found = checked.withColumn("part", F.coalesce((F.col("first") >= reach).cast("int"), F.lit(1))).withColumn("part", F.sum("part").over(place.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.row_number().over(Window.partitionBy(*same_row, "template", "run", "part").orderBy(F.desc("similarity"), "first", "end"))
    found = found.withColumn("place", best).filter("place = 1")
    doc_id = F.when(F.col("__id") != NO_ID, F.col("__id")).alias("doc_id")
    return base, found.select(*same_row, doc_id, "label", F.col("first").cast("long").alias("first"), F.col("end").cast("long").alias("end"), "similarity")


def op4_diagonal_license_scan(spark, sf_dir: str) -> DataFrame:
    base, spans = scan_licenses(table(spark, sf_dir, "documents"))
    by_doc = spans.groupBy(*same_row).agg(F.collect_set("label").alias("more"), F.max("similarity").alias("similarity"), F.count("*").alias("n_spans"))
    d = base.join(small(by_doc, by_doc.count()), same_row, "left")
    both = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    n = F.size("starts")
    return d.select(
        "doc_id", "n_words", n.cast("long").alias("n_base"), F.array_min("starts").alias("first_word"), F.array_max("starts").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"), F.array_join(both, ",").alias("labels"),
        F.greatest(F.coalesce("similarity", F.lit(0.0)), F.when(n > 0, F.lit(MENTION)).otherwise(0.0)).alias("score"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
    )
