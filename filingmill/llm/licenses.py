"""License scan by diagonal voting, by built-in functions only.

Every k-word gram of every document is joined with the grams of the templates. A hit of document place i and template
place p votes for the diagonal i - p. A base phrase stands at a diagonal on which all its grams vote. Of longer notices,
neighbouring diagonals (words put in or left out) are merged, and a merged span is verified by the share of the
template's grams that it holds, word for word, and by its length. Templates are openings and whole bodies of notices, so an
edited body is found by its body, and a lone opening by its opening.

Licences of a family share most of their words and differ in their names and duties. So a span must hold the words that name
its licence, and of verified spans of several licences at one place the one that holds the greatest share stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, staged
from .native import literal_rows

# What is no word, and the base phrases with their labels.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]

# The method's own templates, openings and whole bodies of well-known notices.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("lgpl-3", "this work is licensed under the gnu lesser general public license version 3"),
    ("agpl-3", "this work is licensed under the gnu affero general public license version 3"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc-sa", "licensed under a creative commons attribution noncommercial sharealike"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("boost", "distributed under the boost software license version 1 0"),
    ("epl-2", """
        This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at
        https://www.eclipse.org/legal/epl-2.0/"""),
    ("mpl-2", """
        This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one
        at https://mozilla.org/MPL/2.0/."""),
    ("lgpl", """
        This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software
        Foundation, either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT
        ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.
        You should have received a copy of the GNU Lesser General Public License along with this library. If not, see https://www.gnu.org/licenses/."""),
    ("agpl", """
        This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software
        Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT
        ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.
        You should have received a copy of the GNU Affero General Public License along with this program. If not, see https://www.gnu.org/licenses/."""),
    ("0bsd", """
        Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR
        DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY
        SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE
        OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("unlicense", """
        This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either
        in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
    ("zlib", """
        This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this
        software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject
        to the following restrictions"""),
    ("mit", """
        Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in
        the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of
        the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
        permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
        EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
        AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR
        IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("apache-2", """
        Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the
        License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is
        distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
        permissions and limitations under the License."""),
    ("gpl", """
        This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
        Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT
        ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You
        should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."""),
    ("bsd", """
        Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions
        of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the
        above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS
        SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES
        OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
        INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS;
        OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING
        IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("isc", """
        Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and
        this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER
        RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
        PERFORMANCE OF THIS SOFTWARE."""),
]
GRAM = 3

# The words that name a licence of a family; every span of such a label holds each of them once at least.
NAMED = {
    "apache-2": ["apache license version"],
    "gpl": ["gnu general public"],
    "gpl-3": ["gnu general public", "license version 3"],
    "lgpl": ["gnu lesser general"],
    "lgpl-3": ["gnu lesser general", "license version 3"],
    "agpl": ["gnu affero general"],
    "agpl-3": ["gnu affero general", "license version 3"],
    "mpl-2": ["mozilla public license"],
    "epl-2": ["eclipse public license"],
    "cc-by": ["commons attribution 4"],
    "cc-by-sa": ["commons attribution sharealike"],
    "cc-by-nc": ["cc by nc"],
    "cc-by-nc-sa": ["attribution noncommercial sharealike"],
}


def words(text: Column) -> Column:
    """The words of a text as an array; ['']: none."""
    seps = "".join(chr(c) for c in range(128) if not (48 <= c <= 57 or 97 <= c <= 122))
    return F.split(F.btrim(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(seps)), NO_WORD, -1)


def _grams(df: DataFrame, place: str) -> DataFrame:
    """A row for each gram of df.words, with its place, hash and words."""
    last = F.size("words") - GRAM
    df = df.withColumn(place, F.explode(F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))))
    return df.withColumn("gram", F.xxhash64(*(F.get("words", F.col(place) + k) for k in range(GRAM))))


def templates(spark: SparkSession) -> DataFrame:
    """(template, label, base, grams_n, words_n, names_n, p, gram, t0, t1, t2, name) of all grams of the templates: a table of fixed size. name: the gram, if it names the licence."""
    rows = [{"template": k, "label": label, "base": k < len(BASE), "names": "|".join(NAMED.get(label, [])), "text": text} for k, (label, text) in enumerate([*BASE, *NOTICES])]
    df = literal_rows(spark, rows).withColumn("words", words(F.col("text"))).withColumn("names", F.array_remove(F.split("names", "[|]"), ""))
    df = _grams(df, "p").withColumn("grams_n", F.size("words") - GRAM + 1).withColumn("words_n", F.size("words"))
    said = F.concat_ws(" ", *(F.get("words", F.col("p") + k) for k in range(GRAM)))
    df = df.withColumn("names_n", F.size("names")).withColumn("name", F.when(F.array_contains("names", said), said))
    return df.select("template", "label", "base", "grams_n", "words_n", "names_n", "p", "gram", *(F.get("words", F.col("p") + k).alias(f"t{k}") for k in range(GRAM)), "name")


def _best(spans: DataFrame, reach: int) -> DataFrame:
    """spans less those that another label's span beats: one on the same place, which holds a greater share of its template, or as great a share of more grams.

    On the same place: they share more than half of the shorter one's words. reach: no span is longer. What a span is compared
    with begins within reach of its own beginning, so it is bounded, as each verified span needs words of its own.
    """
    near = Window.partitionBy("doc_id", "version").orderBy("start").rangeBetween(-reach, reach)
    rivals = F.collect_list(F.struct("label", "start", "end", "share", "held")).over(near)
    common = lambda x: F.least(x["end"], F.col("end")) - F.greatest(x["start"], F.col("start"))
    shorter = lambda x: F.least(x["end"] - x["start"], F.col("end") - F.col("start"))
    better = lambda x: (x["share"] > F.col("share")) | ((x["share"] == F.col("share")) & (x["held"] > F.col("held")))
    beaten = F.exists("rivals", lambda x: (x["label"] != F.col("label")) & better(x) & (common(x) * 2 > shorter(x)))
    return spans.withColumn("rivals", rivals).where(~beaten).drop("rivals")


SPAN = "struct<start:bigint,end:bigint,label:string,template:int,share:double>"


def license_scan(docs: DataFrame, least: float = 0.8, near: int = 2) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of every row of docs (doc_id, text).

    least: share of a notice's grams that a verified span holds; near: diagonals this far apart are merged. score: 1 if
    a base phrase stands in the text, else the best share of a verified span, else 0. spans: the verified spans, in
    order, as words from start up to end, with their template's number and the share that they hold.

    Null or wordless text: no words, no labels, no spans, score 0. Rows that repeat a doc_id and a text get the same result
    each. Spans that tie at one place all stay. Other columns are ignored. An empty table: no rows.
    """
    spark = docs.sparkSession
    keyed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("version"), words(F.col("text")).alias("words"))
    grams = _grams(keyed, "i")
    hits = grams.join(F.broadcast(templates(spark)), "gram")  # as many rows as the templates have grams
    hits = hits.where(" and ".join(f"get(words, i + {k}) = t{k}" for k in range(GRAM)))
    by = ["doc_id", "version", "template", "label", "base", "grams_n", "words_n", "names_n"]
    votes = hits.select(*by, "i", "p", "name", (F.col("i") - F.col("p")).alias("diagonal")).distinct()
    lines = votes.groupBy(*by, "diagonal").agg(F.count("*").alias("votes"), F.collect_set("p").alias("ps"), F.collect_set("name").alias("names"), F.min("i").alias("i0"), F.max("i").alias("i1"))
    lines = staged(lines)

    places = lines.where("base and votes = grams_n").groupBy("doc_id", "version")
    places = places.agg(F.count("*").alias("n_base"), F.min("diagonal").alias("first_word"), F.max("diagonal").alias("last_word"), F.collect_set("label").alias("base_set"))
    order = Window.partitionBy("doc_id", "version", "template").orderBy("diagonal")
    merged = lines.where("not base").withColumn("fresh", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > near).cast("int"), F.lit(1)))
    every = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(c))))
    merged = merged.withColumn("run", F.sum("fresh").over(order)).groupBy(*by, "run")
    merged = merged.agg(every("ps").alias("held"), every("names").alias("named"), F.min("i0").cast("long").alias("start"), (F.max("i1") + GRAM).cast("long").alias("end"))
    sure = merged.where((F.col("held") >= least * F.col("grams_n")) & (F.col("named") == F.col("names_n")) & (F.col("end") - F.col("start") <= 2 * F.col("words_n")))
    longest = max(len(text.split()) for _, text in NOTICES) * 4  # a span has at most twice a template's words; a written word may be two
    spans = _best(sure.withColumn("share", F.col("held") / F.col("grams_n")), longest).groupBy("doc_id", "version")
    spans = spans.agg(F.collect_set("label").alias("span_set"), F.max("share").alias("best"), F.array_sort(F.collect_list(F.struct("start", "end", "label", "template", "share"))).alias("all"))

    key = lambda df, n: df.withColumnsRenamed({"doc_id": f"_id{n}", "version": f"_version{n}"})
    same = lambda n: F.col("doc_id").eqNullSafe(F.col(f"_id{n}")) & (F.col("version") == F.col(f"_version{n}"))
    n_words = F.when(F.get("words", F.lit(0)) == "", 0).otherwise(F.size("words")).cast("long")
    out = keyed.select("doc_id", "version", n_words.alias("n_words")).join(key(places, 1), same(1), "left").join(key(spans, 2), same(2), "left")
    none = F.array().cast("array<string>")
    joined = lambda a: F.array_join(F.array_sort(a), ",")
    base, more = F.coalesce("base_set", none), F.coalesce("span_set", none)
    return out.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long"), F.col("last_word").cast("long"),
        joined(base).alias("base_labels"), joined(F.array_union(base, more)).alias("labels"), F.when(F.size(base) > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
        F.coalesce("all", F.array().cast(f"array<{SPAN}>")).cast(f"array<{SPAN}>").alias("spans"),
    )
