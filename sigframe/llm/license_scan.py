"""Licence passages by diagonal voting.

Every run of two and of three words of every text is hashed and joined with the same runs of the templates. A hit at word ``p`` of a text
and ``q`` of a template votes for diagonal ``p - q``. Votes are summed by (text, template, diagonal), diagonals a few words apart are
merged (words were put in or left out), and a merged span is verified: the runs are compared as words, not only as hashes, and the
template's words that they cover must be a given share of it, within a span not much longer than the template. A template
with all its runs on one diagonal stands there word for word.

Null and empty texts, and those without a hit, give a row with counts of zero, no places, empty labels and score 0. Rows that
repeat both document id and text are looked at together and give a row each: their votes are summed where they lie before they meet, and their rows are dealt out again. An empty table gives no rows. No column but the id and the text is read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lower_ascii, repeated, stored, whole_text

#: Phrases that stand for a licence by themselves.
PHRASES = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]
#: Notices as the licences' own texts word them.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright"),
    ("reserved", "all rights reserved"),
]
#: Whole licence texts, or the parts of them that do not change.
TEXTS = [
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
        in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
        Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
        shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING
        BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE
        FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
        OTHER DEALINGS IN THE SOFTWARE."""),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of
        the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is
        distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions
        and limitations under the License."""),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
        Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
        WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions
        of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above
        copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice
        and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
        IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this
        software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
]
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words by which diagonals may differ and be merged; the share of a template to be covered; length of a span against its template.
DRIFT, COVERED, STRETCH = 3, 0.8, 1.3


def template_runs(phrases: list[tuple[str, str]], notices: list[tuple[str, str]]) -> list[tuple]:
    """(template, label, phrase, q, length, k, run): the runs of every template."""
    words = [(label, re.findall(WORD, text.lower())) for label, text in [*phrases, *notices]]
    return [(i, label, i < len(phrases), q, len(w), k, w[q : q + k]) for i, (label, w) in enumerate(words) for k in [min(3, len(w))] for q in range(len(w) - k + 1)]


def templates(spark: SparkSession, phrases: list[tuple[str, str]], notices: list[tuple[str, str]]) -> DataFrame:
    """A bounded table, as templates are a list in code."""
    rows = template_runs(phrases, notices)
    df = spark.createDataFrame(rows, "template int, label string, phrase boolean, q int, length int, k int, run array<string>")
    return df.select("*", *[F.try_element_at("run", F.lit(j + 1)).alias(f"t{j}") for j in range(3)])


def _hits(docs: DataFrame, known: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row for each vote, and one without a template for each text."""
    words = F.regexp_extract_all(lower_ascii(whole_text(text_col)), F.lit(WORD), F.lit(0))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(whole_text(text_col)).alias("text"), words.alias("w"))
    # The row's own mark comes before its runs, as a run without words.
    own = F.concat(F.array(F.lit(None).cast("string")), "w")
    after = F.arrays_zip(own.alias("a"), F.slice(own, 2, F.size(own)).alias("b"), F.slice(own, 3, F.size(own)).alias("c"))
    runs = rows.select("doc_id", "text", F.size("w").cast("long").alias("n_words"), F.posexplode(after).alias("p", "r"))
    runs = runs.select("doc_id", "text", "n_words", (F.col("p") - 1).alias("p"), "r.a", "r.b", "r.c")
    for k in (2, 3):
        run = ["a", "b", "c"][:k]
        own = known.where(F.col("k") == k).select(F.xxhash64(*[f"t{j}" for j in range(k)]).alias(f"h{k}"), *[F.col(f"t{j}").alias(f"x{k}{j}") for j in range(k)], F.struct("template", "label", "phrase", "q", "length", "k").alias(f"hit{k}"))
        same = [F.col(x) == F.col(f"x{k}{j}") for j, x in enumerate(run)]
        on: Column = F.xxhash64(*run) == F.col(f"h{k}")
        for x in same:
            on &= x
        runs = runs.join(F.broadcast(own), on, "left")
    runs = runs.where("hit2 IS NOT NULL OR hit3 IS NOT NULL OR p = -1")
    hit = F.explode_outer(F.array_compact(F.array("hit2", "hit3"))).alias("hit")
    return runs.select("doc_id", "text", "n_words", "p", hit).select("doc_id", "text", "n_words", "p", "hit.*")


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: list[tuple[str, str]] | None = None, notices: list[tuple[str, str]] | None = None,
    drift: int = DRIFT, covered: float = COVERED, stretch: float = STRETCH,
) -> DataFrame:
    """Per text: the phrases' places, labels, and ``spans`` (template, label, first word, end, share covered) that were verified."""
    known = templates(docs.sparkSession, PHRASES if phrases is None else phrases, [*NOTICES, *TEXTS] if notices is None else notices)
    text = ["doc_id", "text"]
    hits = _hits(docs, known, id_col, text_col)
    template = ["template", "label", "phrase", "length", "k"]
    diagonal = (F.col("p") - F.col("q")).alias("diagonal")
    votes = hits.groupBy(*text, *template, diagonal).agg(F.max("n_words").alias("n_words"), F.count("*").alias("n"), F.collect_set("q").alias("qs"))
    votes = votes.repartition(*text)  # all that follows needs a text's votes together
    order = Window.partitionBy(*text, "template").orderBy("diagonal")
    fresh = F.when(F.col("diagonal") - F.lag("diagonal").over(order) <= drift, 0).otherwise(1)
    merged = votes.withColumn("fresh", fresh).withColumn("span", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = F.size("qs") == F.col("length") - F.col("k") + 1
    covers = F.array_distinct(F.flatten(F.transform("qs", lambda q: F.sequence(q, q + F.col("k") - 1))))
    spans = (
        merged.withColumn("covers", covers)
        .groupBy(*text, *template, "span")
        .agg(
            F.max("n_words").alias("n_words"), F.max(F.when(F.col("template").isNull(), F.col("n"))).alias("rows"), F.count(F.when(whole, 1)).alias("exact"), F.min(F.when(whole, F.col("diagonal"))).alias("first_exact"), F.max(F.when(whole, F.col("diagonal"))).alias("last_exact"),
            F.min(F.col("diagonal") + F.array_min("qs")).alias("first"), F.max(F.col("diagonal") + F.array_max("qs") + F.col("k")).alias("end"),
            F.size(F.array_distinct(F.flatten(F.collect_list("covers")))).alias("covered"),
        )
    )
    share = F.col("covered") / F.col("length")
    good = (F.col("exact") > 0) | (~F.col("phrase") & (share >= covered) & (F.col("end") - F.col("first") <= stretch * F.col("length")))
    base = F.col("phrase") & (F.col("exact") > 0)
    found = spans.withColumn("good", good).withColumn("base", base)
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(F.col(c), F.col("label")))), ",")
    out = found.groupBy(*text).agg(
        F.max("rows").alias("rows"), F.max("n_words").alias("n_words"), F.coalesce(F.sum(F.when(F.col("base"), F.col("exact"))), F.lit(0)).alias("n_base"),
        F.min(F.when(F.col("base"), F.col("first_exact"))).cast("long").alias("first_word"), F.max(F.when(F.col("base"), F.col("last_exact"))).cast("long").alias("last_word"),
        joined("base").alias("base_labels"), joined("good").alias("labels"), F.coalesce(F.max(F.when(F.col("good"), share)), F.lit(0.0)).alias("score"),
        F.collect_list(F.when(F.col("good") & ~F.col("phrase"), F.struct("template", "label", "first", "end", share.alias("share")))).alias("spans"),
    )
    return repeated(stored(out, "scanned"), "rows", text)
