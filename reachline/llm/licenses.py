"""License scans: MinHash bands over text windows retrieve templates, then exact containment."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIZE = 5
"""Words of a shingle; a template of fewer words is one shingle of all of them."""

LEAST_CONTAINED = 0.8
BANDS = 64
"""One-row bands. A window that holds a template has a similarity to it of 0.19 or more, so it
shares a band with probability above 1 - 0.81 ** 64, which is above 0.99999."""

MOST_BROADCAST = 20_000
"""Shingles of all templates up to which they and their bands, 512 bytes a shingle, go to every
task; beyond it Spark decides, and shuffles what is large. The steps are the same."""

# Sentences of well-known license notices.
TEMPLATES = [
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT-permission", "Permission is hereby granted, free of charge, to any person obtaining a "
     "copy of this software and associated documentation files, to deal in the Software without "
     "restriction"),
    ("BSD-conditions", "Redistribution and use in source and binary forms, with or without "
     "modification, are permitted provided that the following conditions are met"),
    ("GPL-notice", "This program is free software: you can redistribute it and/or modify it "
     "under the terms of the GNU General Public License as published by the Free Software "
     "Foundation"),
    ("Apache-notice", "Unless required by applicable law or agreed to in writing, software "
     "distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR "
     "CONDITIONS OF ANY KIND, either express or implied."),
    ("CC-BY-SA", "This work is licensed under a Creative Commons Attribution-ShareAlike "
     "International License."),
]

# Whole license texts.
WHOLE_TEXTS = [
    ("MIT-text", """Permission is hereby granted, free of charge, to any person obtaining a copy of
this software and associated documentation files (the "Software"), to deal in the Software without
restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions: The above copyright notice and
this permission notice shall be included in all copies or substantial portions of the Software. THE
SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC-text", """Permission to use, copy, modify, and/or distribute this software for any purpose
with or without fee is hereby granted, provided that the above copyright notice and this permission
notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL
WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION
OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-text", """Redistribution and use in source and binary forms, with or without modification,
are permitted provided that the following conditions are met: 1. Redistributions of source code must
retain the above copyright notice, this list of conditions and the following disclaimer. 2.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions
and the following disclaimer in the documentation and/or other materials provided with the
distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY
EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT
HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH
DAMAGE."""),
]

# Notices of fewer words than ``SIZE``.
SHORT_TEMPLATES = [("All-rights-reserved", "All rights reserved.")]


def scan_words(text: Column) -> Column:
    """Runs of letters and digits, lower-cased, as an array; null gives an empty one."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    return F.array_remove(F.split(plain, " "), "")


def shingles(words: Column, sizes: list[int]) -> Column:
    """For each of ``sizes`` the hashes of all runs of so many words, in order; none for shorter
    texts.

    The array of word hashes is bound to a lambda variable, so it is computed once per text and
    not again for every position.
    """
    def runs(hashes: Column, size: int) -> Column:
        starts = F.sequence(F.lit(0), F.size(hashes) - size)
        return F.when(F.size(hashes) >= size, F.transform(
            starts, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(size)]))
        ).otherwise(F.array().cast("array<bigint>"))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.get(F.transform(F.array(hashed), lambda h: F.array(*[
        F.struct(F.lit(size).alias("size"), runs(h, size).alias("all")) for size in sizes])),
        F.lit(0))


def minhash(hashes: Column, bands: int = BANDS) -> Column:
    """The smallest hash under each of ``bands`` hash functions."""
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda band: F.array_min(
        F.transform(hashes, lambda h: F.xxhash64(h, band))))


def template_table(spark: SparkSession, templates: list[tuple[str, str]] | None = None
                   ) -> DataFrame:
    """(license, size, shingles, reach): size, the words of a shingle, is ``SIZE`` or the words of
    a shorter notice; reach, a power of two, is above half the shingles.

    Without ``templates`` all known notices are taken. A notice without words is an error.
    """
    if templates is None:
        templates = TEMPLATES + SHORT_TEMPLATES
    rows = (spark.createDataFrame(templates, "license string, notice string")
            .withColumn("words", scan_words(F.col("notice"))))
    bare = [r.license for r in rows.where(F.size("words") == 0).select("license").collect()]
    if bare:
        raise ValueError(f"templates without words: {bare}")
    of_size = F.get(shingles(F.col("words"), list(range(1, SIZE + 1))), F.col("size") - 1)
    return (rows.withColumn("size", F.least(F.size("words"), F.lit(SIZE)))
            .withColumn("shingles", F.array_distinct(of_size["all"]))
            .select("license", "size", "shingles", F.pow(
                F.lit(2), F.floor(F.log2(F.size("shingles")))).cast("int").alias("reach")))


def _windows(docs: DataFrame, known: DataFrame, reaches: dict[int, list[int]]) -> DataFrame:
    """(doc_id, text, size, reach, start, held): the windows with a shingle of a template, from
    a join of all shingles with those of the templates.

    ``held`` has the window's shingles that some template has. Others are in no template, so
    containment is the same and the bands agree at least as often.
    """
    runs = docs.select("doc_id", F.xxhash64("text").alias("text"), F.explode(
        shingles(scan_words(F.col("text")), sorted(reaches))).alias("r"))
    met = runs.select("doc_id", "text", F.col("r.size").alias("size"),
                      F.posexplode("r.all").alias("at", "shingle")).join(known,
                                                                        ["size", "shingle"])
    rows = F.coalesce(*[F.when(F.col("size") == size, F.array(*[F.lit(r) for r in reaches[size]]))
                        for size in sorted(reaches)])
    last = F.floor(F.col("at") / (2 * F.col("reach"))).cast("int")
    starts = F.transform(F.sequence(F.greatest(last - 1, F.lit(0)), last),
                         lambda n: n * 2 * F.col("reach"))
    return (met.withColumn("reach", F.explode(rows)).withColumn("start", F.explode(starts))
            .groupBy("doc_id", "text", "size", "reach", "start")
            .agg(F.collect_set("shingle").alias("held")))


def scan_licenses(docs: DataFrame, templates: DataFrame,
                  contained: float = LEAST_CONTAINED) -> DataFrame:
    """(doc_id, license, containment, first_word, windows): the templates in each text.

    ``templates`` comes from ``template_table``. For each shingle size and each reach r (a power
    of two with r <= number of shingles < 2r) a text is seen in windows of 4r shingles that begin
    every 2r, so each occurrence lies in one of them whole. Windows without any shingle of a
    template hold none and are passed over. The MinHash of a window retrieves the templates of
    its size and reach that agree in a band, and a template counts if at least ``contained`` of
    its distinct shingles are in the window. A row gives the best containment in the text, the
    first word of the first such window and their number.

    Nothing is joined by document: shingles of texts meet those of templates, and templates meet
    windows on (size, reach, band, value). What templates bring is broadcast up to
    ``MOST_BROADCAST`` shingles, 10 MB; beyond that Spark chooses the joins. Null and empty texts hold nothing, nor do texts shorter
    than the template. Rows that repeat doc_id and text count once. Other columns are not read.
    """
    sizes = templates.groupBy("size").agg(
        F.array_sort(F.collect_set("reach")).alias("reaches")).collect()
    if not sizes:
        return docs.select("doc_id").where("false").withColumns({
            "license": F.lit(""), "containment": F.lit(0.0), "first_word": F.lit(0),
            "windows": F.lit(0).cast("bigint")})
    reaches = {r["size"]: r["reaches"] for r in sizes}
    known = templates.select("size", F.explode("shingles").alias("shingle")).distinct()
    few = known.count() <= MOST_BROADCAST
    seen = _windows(docs, F.broadcast(known) if few else known, reaches)
    banded = seen.select("doc_id", "text", "size", "reach", "start", "held",
                         F.posexplode(minhash(F.col("held"))).alias("band", "value"))
    keys = templates.select("license", "size", "reach", F.col("shingles").alias("template"),
                            F.posexplode(minhash(F.col("shingles"))).alias("band", "value"))
    if few:
        keys = F.broadcast(keys)
    share = (F.size(F.array_intersect("held", "template")) / F.size("template"))
    return (banded.join(keys, ["size", "reach", "band", "value"])
            .select("doc_id", "text", "license", "start", share.alias("share"))
            .where(F.col("share") >= contained)
            .groupBy("doc_id", "text", "license")
            .agg(F.max("share").alias("containment"), F.min("start").alias("first_word"),
                 F.count_distinct("start").alias("windows"))
            .drop("text"))


def op5_licenses(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    return scan_licenses(docs, template_table(
        spark, TEMPLATES + SHORT_TEMPLATES + WHOLE_TEXTS))


def plain_words(text: str | None) -> list[str]:
    """The words of ``scan_words`` in Python, for tests."""
    return re.findall(r"[^\W_]+", (text or "").lower())
