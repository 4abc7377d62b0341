"""Licence scans by diagonal voting.

Every rolling run of ``K`` words of a text (all words of a phrase that has fewer) is hashed and joined to the places of equal runs in the
templates. A hit votes for its diagonal (word place in the text less place in the template). There are two kinds of template:

* Phrases and notices are short and name a licence; every word counts. They stand where one diagonal holds all their runs.
* ``TEXTS`` are whole licence texts and file headers. Diagonals that neighbour each other are merged in bands of twice ``DRIFT`` of the
  template's words, which overlap by half, so a band is never longer than its template and the drift, however often a text
  repeats a few words. A band's votes count once for each place of the template. Its span is then verified: the runs
  that follow each other in the text in the template's order (the longest such chain) must be at least ``SHARE`` of the template's.

Runs are compared by their words, too, so a hash alone is never a hit. Only DataFrame functions are used. The templates are a parameter and a
fixed list, so their runs are broadcast; a text's runs are tested against the template's words before they are exploded, and one
shuffle, of hits only, follows.

Cases: null text is empty; a text of fewer than two words has no hits; empty tables give no rows; repeated rows each give their
own; very long texts are read whole; further columns of any name are not read; places count words from 0; the score is the largest verified share of a template that one span holds (1 for a whole phrase).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

K = 3
DRIFT = 0.1
SHARE = 0.7
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: The phrases whose places are counted, with their labels.
PHRASES = [
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
]

#: Phrases that name a licence, with their labels.
NOTICES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "under the Apache License, Version 2.0"),
    ("mit", "under the MIT License"),
    ("gpl-3.0", "GNU General Public License, version 3"),
    ("gpl-3.0", "either version 3 of the License"),
    ("gpl-2.0", "GNU General Public License, version 2"),
    ("gpl-2.0", "either version 2 of the License"),
    ("lgpl", "GNU Lesser General Public License"),
    ("agpl", "GNU Affero General Public License"),
    ("mpl-2.0", "subject to the terms of the Mozilla Public License"),
    ("cc-by-nc", "under CC BY-NC"),
    ("cc-by-sa", "under CC BY-SA"),
    ("cc-by-nd", "under CC BY-ND"),
    ("cc0", "dedicated to the public domain under CC0"),
    ("creative-commons", "under a Creative Commons Attribution"),
    ("proprietary", "proprietary and confidential"),
]

#: Public licence texts and file headers, with their labels.
TEXTS = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to
        deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
        copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
        this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY
        KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
        SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING
        FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "bsd",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary
        form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided
        with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
        LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
        CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF
        SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT,
        STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF
        SUCH DAMAGE.""",
    ),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright
        notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
        INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
        DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING
        OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the
        License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is
        distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
        permissions and limitations under the License.""",
    ),
    (
        "gpl",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
        Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT
        ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You
        should have received a copy of the GNU General Public License along with this program.""",
    ),
    (
        "mpl-2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain
        one at""",
    ),
    (
        "unlicense",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this
        software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    ),
]


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), BETWEEN), "")


def _words(text: str) -> list[str]:
    return [w for w in re.split(BETWEEN, text.translate(str.maketrans(UPPER, LOWER))) if w]


#: (label, kind, text): a base phrase, a notice or a whole text.
Template = tuple[str, str, str]
TEMPLATES: list[Template] = [*[(a, "base", t) for a, t in PHRASES], *[(a, "notice", t) for a, t in NOTICES], *[(a, "text", t) for a, t in TEXTS]]


def run_rows(templates: list[Template] = TEMPLATES) -> list[tuple[int, str, str, int, int, int, int, str]]:
    """(template, label, kind, words to a run, its number of runs, band width or 0, place, run) of all templates' runs."""
    out = []
    for tid, (label, kind, text) in enumerate(templates):
        w = _words(text)
        k = min(K, len(w))
        width = max(1, round(DRIFT * len(w))) if kind == "text" else 0
        out += [(tid, label, kind, k, len(w) - k + 1, width, i, " ".join(w[i : i + k])) for i in range(len(w) - k + 1)]
    return out


def known_runs(spark: SparkSession, templates: list[Template] = TEMPLATES) -> DataFrame:
    rows = spark.createDataFrame(run_rows(templates), "tid int, label string, kind string, k int, runs int, width int, place int, run string")
    return rows.withColumn("h", F.xxhash64("run"))


def chain(hits: Column) -> Column:
    """The most of the (place, -at) hits, in order, that ascend in both: the length of the longest ascending chain of ``at``."""

    def put(tails: Column, hit: Column) -> Column:
        at = -hit["neg"]
        p = F.size(F.filter(tails, lambda v: v < at))
        return F.when(p == F.size(tails), F.concat(tails, F.array(at))).otherwise(F.transform(tails, lambda v, i: F.when(i == p, at).otherwise(v)))

    return F.aggregate(hits, F.array().cast("array<bigint>"), put, F.size)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: list[Template] = TEMPLATES) -> DataFrame:
    """Per row: ``key``, n_words, n_base, first_word, last_word, base_labels, labels, score, spans."""
    known = known_runs(docs.sparkSession, templates)
    runs = run_rows(templates)
    firsts, seconds = sorted({r[7].split()[0] for r in runs}), sorted({r[7].split()[1] for r in runs if r[3] > 1})
    rows = docs.select(docs[key].alias("id"), words(F.coalesce(docs[text], F.lit(""))).alias("w"))
    rows = rows.select("id", F.size("w").cast("long").alias("n_words"), "w").withColumn("rid", F.monotonically_increasing_id())
    # All rolling runs; those whose words are in no template can't join.
    begun = F.filter(F.transform("w", lambda w, i: F.when(w.isin(firsts), i)), lambda i: i.isNotNull())
    if all(r[3] > 1 for r in runs):
        begun = F.filter(begun, lambda i: F.coalesce(F.get("w", i + 1).isin(seconds), F.lit(False)))
    sizes = sorted({r[3] for r in runs})
    each = F.flatten(F.transform(begun, lambda i: F.array(*[F.struct(i.cast("long").alias("at"), F.when(i + k <= F.size("w"), F.array_join(F.slice("w", i + 1, k), " ")).alias("run")) for k in sizes])))
    some = F.filter(each, lambda x: F.coalesce(x["run"].isin(sorted({r[7] for r in runs})), F.lit(False)))
    hits = rows.select("rid", "id", "n_words", F.explode_outer(some).alias("x")).select("rid", "id", "n_words", "x.at", F.col("x.run").alias("own"), F.xxhash64("x.run").alias("hash"))
    votes = hits.join(F.broadcast(known), (F.col("hash") == F.col("h")) & (F.col("own") == F.col("run")), "left")  # a fixed list
    template = ["rid", "id", "n_words", "tid", "label", "kind", "k", "runs", "width"]
    votes = votes.select(*template, "at", "place", (F.col("at") - F.col("place")).alias("diagonal")).repartition("rid")
    # A phrase's and a notice's diagonals stay apart; a text's are in two overlapping bands each.
    band = F.floor(F.col("diagonal") / F.greatest("width", F.lit(1)))
    region = F.when(F.col("width") > 0, F.array(band, band - 1)).otherwise(F.array(F.col("diagonal")))
    merged = votes.withColumn("region", F.explode(region)).groupBy(*template, "region").agg(
        F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("place", (-F.col("at")).alias("neg"))))).alias("hits"), F.min("at").alias("low"), F.max("at").alias("high")
    )
    verified = merged.withColumn("share", F.when(F.col("tid").isNotNull(), chain(F.col("hits")) / F.col("runs")).otherwise(F.lit(0.0)))
    whole = (F.col("kind") == "base") & (F.col("share") == 1)
    match = F.col("share") >= F.when(F.col("kind") == "text", SHARE).otherwise(1.0)
    found = verified.groupBy("rid", "id", "n_words").agg(
        F.coalesce(F.sum(whole.cast("long")), F.lit(0).cast("long")).alias("n_base"),
        F.min(F.when(whole, F.col("low"))).alias("first_word"),
        F.max(F.when(whole, F.col("low"))).alias("last_word"),
        F.collect_set(F.when(whole, F.col("label"))).alias("b"),
        F.collect_set(F.when(match, F.col("label"))).alias("m"),
        F.max("share").alias("score"),
        F.array_sort(F.collect_set(F.when(match, F.struct(F.col("low").alias("start"), (F.col("high") + F.col("k")).alias("end"), "label")))).alias("spans"),
    )
    names = lambda c: F.array_join(F.array_sort(c), ",")
    return found.select(F.col("id").alias(key), "n_words", "n_base", "first_word", "last_word", names("b").alias("base_labels"), names("m").alias("labels"), "score", "spans")


def oracle_sql() -> str:
    """The same scan in DuckDB SQL over ``documents``, without the spans; it joins without the words' pre-selection."""
    values = ", ".join(f"({t}, '{label}', '{kind}', {k}, {n}, {width}, {p}, '{run}')" for t, label, kind, k, n, width, p, run in run_rows())
    between = BETWEEN.replace("[", "[^", 1)
    sizes = sorted({r[3] for r in run_rows()})
    chained = "list_reduce(list_prepend([]::BIGINT[], list(spot ORDER BY place, spot DESC)), lambda t, x: CASE WHEN len(list_filter(t, lambda v: v < x[1])) = len(t) THEN list_concat(t, x) ELSE list_concat(t[1:len(list_filter(t, lambda v: v < x[1]))], x, t[len(list_filter(t, lambda v: v < x[1])) + 2:]) END)"
    return f"""
WITH k(tid, label, kind, k, runs, width, place, run) AS (VALUES {values}),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{between}') AS w FROM documents),
p AS (SELECT rid, i - 1 AS pos, w[i:i + s - 1] AS run FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM d), unnest({sizes}) z(s) WHERE i + s <= len(w) + 1),
hits AS (SELECT rid, tid, label, kind, runs, width, place, [pos] AS spot, pos - place AS diagonal FROM p JOIN k ON array_to_string(p.run, ' ') = k.run),
bands AS (SELECT *, unnest(CASE WHEN width > 0 THEN [floor(diagonal / greatest(width, 1)), floor(diagonal / greatest(width, 1)) - 1] ELSE [diagonal::DOUBLE] END) AS region FROM hits),
regions AS (SELECT rid, tid, label, kind, min(spot[1]) AS low, len({chained})::DOUBLE / runs AS share FROM bands GROUP BY rid, tid, label, kind, runs, region),
judged AS (SELECT *, kind = 'base' AND share = 1 AS whole, share >= CASE WHEN kind = 'text' THEN {SHARE} ELSE 1.0 END AS match FROM regions),
found AS (SELECT rid, count(*) FILTER (whole) AS n_base, min(low) FILTER (whole) AS first_word, max(low) FILTER (whole) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (whole) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (match) AS labels, max(share) AS score FROM judged GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN found USING (rid)
"""
