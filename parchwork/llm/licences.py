"""Licence families of paragraphs by a trained n-gram classifier.

A paragraph is a line, or a run of neighbouring lines that all hold a word of
the model: notices are often wrapped.

Sparse logistic regression over words and pairs of words, trained on variants
of short licence notices and on other sentences, gives every paragraph a
probability for each family and for none. A family is predicted where its
probability reaches a level calibrated on held-out variants, and confirmed
where the paragraph also holds most of the pairs of one of the family's
notices; likely but uncalibrated paragraphs are of unknown family.

Training is plain arithmetic on the bundled notices. Scoring uses DataFrame
expressions only: paragraphs without any word of the model (which score as
none whatever else they hold) are left out before pairs are made.
"""

from __future__ import annotations

import functools
import math
import random
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchwork.llm.scratch import stash

NONE = "none"
# Short notices of common licences.
NOTICES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "This project is released under the Apache License 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "License: Apache-2.0",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
    ],
    "bsd": [
        "Released under the BSD 3-Clause License.",
        "Licensed under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "License: BSD-2-Clause",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ],
    "cc": [
        "Licensed under CC BY 4.0.",
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.",
        "Content is available under CC BY-SA 3.0 unless otherwise noted.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "Released under the GNU Affero General Public License.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "License: GPL v2 or later",
        "either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
        "License: MIT",
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "public-domain": [
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright under CC0 1.0 Universal.",
        "This work is dedicated to the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "reserved": [
        "All rights reserved.",
        "Copyright by the authors. All rights reserved.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited.",
    ],
}
# Sentences that are not notices, some of them close to one.
OTHER = [
    "The driver must carry a valid license at all times.",
    "She released the bird into the open field.",
    "Public transport is free for students in this city.",
    "The general opinion of the public was divided.",
    "He reserved a table for two at the restaurant.",
    "You may use the back door if the front door is locked.",
    "The software was slow and the documentation was poor.",
    "Attribution of the painting to the master is uncertain.",
    "Apache helicopters were seen near the border.",
    "The commons met to discuss the new law.",
    "Students of MIT presented their work.",
    "A copy of the letter was found in the archive.",
    "The version of events given by the witness was different.",
    "The terms of the agreement were not published.",
    "This file contains the results of the survey.",
    "Permission to land was granted late at night.",
    "Copyright law is taught in the second year.",
    "The foundation supports free concerts in the park.",
    "The university (MIT) released version 2.0 of its report.",
    "The general secretary published a version of the public report.",
    "The software comes without warranty, the seller said.",
    "Copies of the book were distributed without charge.",
    "He asked for permission to copy the documents.",
    "The source of the river is in the mountains.",
    "A licence to sell alcohol is required by law in this state.",
    "All seats are reserved for the guests of the festival.",
    "The rights of the workers were reserved in the contract.",
    "Version 3 of the program was slower than version 2.",
    "The Apache people lived in the south of the country.",
    "Mozilla and other companies presented their browsers.",
    "The conditions of the sale and the warranty are in the contract.",
    "You should have received a copy of the letter by now.",
    "The law applies to all software that is sold in the union.",
    "The public domain of the king was divided among his sons.",
    "Contributors to the journal are paid by the page.",
    "The distribution of the species is limited to the islands.",
    "Neither the name nor the address of the holder was known.",
]
# Words that are no feature of their own.
STOP = (
    "a all and any are as at by for in into is it may not of on or that the this to under use with you be we he she was "
    "work file source person conditions met following extent author unless except can 0 1 2 3 4 "
    "an among but do either even from given has have his if its more must near neither new non nor now one other second see seen should so than their two via were will your"
).split()
_SPLIT = re.compile("[^a-z0-9]+")


def grams(text: str) -> set[str]:
    """The words of a text that aren't stop words, and its pairs of neighbouring words that aren't both."""
    words = [w for w in _SPLIT.split(text.lower()) if w]
    pairs = {f"{a} {b}" for a, b in zip(words, words[1:]) if a not in STOP or b not in STOP}
    return {w for w in words if w not in STOP} | pairs


@dataclass(frozen=True)
class Classifier:
    """Weights of each n-gram for each class (the first is none), and the calibrated level."""

    classes: tuple[str, ...]
    bias: tuple[float, ...]
    weights: dict[str, tuple[float, ...]]
    level: float
    words: tuple[str, ...]

    def probabilities(self, found: set[str]) -> list[float]:
        scores = list(self.bias)
        for g in found:
            for k, w in enumerate(self.weights.get(g, ())):
                scores[k] += w
        top = max(scores)
        odds = [math.exp(s - top) for s in scores]
        return [x / sum(odds) for x in odds]


def _variants(text: str, rng: random.Random, count: int) -> list[str]:
    """The text with words left out and others around it."""
    filler = [w for s in OTHER for w in _SPLIT.split(s.lower()) if w in STOP]
    out = [text]
    for _ in range(count - 1):
        words = [w for w in text.split() if rng.random() > 0.08]
        out.append(" ".join(rng.choices(filler, k=rng.randrange(4)) + words + rng.choices(filler, k=rng.randrange(4))))
    return out


@functools.cache
def train(*, variants: int = 12, rounds: int = 300, rate: float = 0.5, shrink: float = 2e-3, accept: float = 0.95, seed: int = 41) -> Classifier:
    """Multinomial logistic regression by gradient descent with an L1 penalty.

    Every fourth variant is held out; the level is the probability that the
    share ``accept`` of held-out notices gives to its family. The first round's
    weights are zero, so that each training gives the same numbers (rounded to
    six places).
    """
    rng = random.Random(seed)
    classes = (NONE, *sorted(NOTICES))
    rows = [(grams(v), classes.index(c)) for c in sorted(NOTICES) for t in NOTICES[c] for v in _variants(t, rng, variants)]
    rows += [(grams(v), 0) for t in OTHER for v in _variants(t, rng, variants // 2)]
    taught, held = [r for k, r in enumerate(rows) if k % 4], rows[::4]
    seen = sorted({g for found, _ in taught for g in found})
    place = {g: k for k, g in enumerate(seen)}
    found_in = np.zeros((len(taught), len(seen)))
    for k, (found, _) in enumerate(taught):
        found_in[k, [place[g] for g in found]] = 1.0
    is_class = np.eye(len(classes))[[c for _, c in taught]]
    weights, bias = np.zeros((len(seen), len(classes))), np.zeros(len(classes))
    for _ in range(rounds):
        scores = found_in @ weights + bias
        odds = np.exp(scores - scores.max(axis=1, keepdims=True))
        wrong = odds / odds.sum(axis=1, keepdims=True) - is_class
        bias -= rate * wrong.mean(axis=0)
        weights -= 20 * rate * (found_in.T @ wrong) / len(taught)
        weights = np.copysign(np.maximum(0.0, np.abs(weights) - 20 * rate * shrink / 100), weights)
    weights, bias = weights.tolist(), bias.tolist()
    bias[0] += max(0.0, max(bias[1:]) - bias[0] + 1.0)  # without any n-gram the answer is none
    kept = {g: tuple(round(w, 6) for w in weights[place[g]]) for g in seen}
    kept = {g: w for g, w in kept.items() if any(w)}
    model = Classifier(classes, tuple(round(b, 6) for b in bias), kept, 0.0, tuple(sorted({w for g in kept for w in g.split() if w not in STOP})))
    scores = sorted(model.probabilities(found)[c] for found, c in held if c)
    level = round(min(0.9, max(0.5, scores[int((1 - accept) * len(scores))])), 6)
    return Classifier(model.classes, model.bias, kept, level, model.words)


def templates() -> list[tuple[str, int, str]]:
    """(family, number of the notice, n-gram) of every notice."""
    out, n = [], 0
    for family in sorted(NOTICES):
        for text in NOTICES[family]:
            out += [(family, n, g) for g in sorted(grams(text))]
            n += 1
    return out


def scan(docs: DataFrame, model: Classifier, *, id_col: str = "doc_id", text_col: str = "text", overlap: float = 0.6) -> DataFrame:
    """One row per input row: id, n_paragraphs, n_confirmed, n_unconfirmed, n_unknown, families.

    n_paragraphs counts lines that aren't blank. Lines with a word of the model
    are scored, and runs of two or more neighbouring ones as a whole, so that a
    wrapped notice is one paragraph. A paragraph counts as confirmed or
    unconfirmed if a family reaches the model's level, by whether ``overlap`` of
    the n-grams of one of the family's notices are in it; as unknown if none of
    the classes reaches it and the class ``none`` isn't the likeliest.
    families lists the confirmed ones, sorted and joined by commas; empty if
    there are none.

    A null or empty text has no paragraphs. Null and repeated ids are rows of
    their own; other columns are ignored; an empty table gives an empty result;
    every paragraph of a text, however long, is scored.
    """
    spark = docs.sparkSession
    words = lambda x: F.split(F.lower(x), "[^a-z0-9]+")
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), lines.alias("lines"))
    told = F.transform("lines", lambda x: F.when(F.exists(words(x), lambda w: w.isin(*model.words)), x).otherwise(""))
    full = F.size(F.filter("lines", lambda x: F.trim(x) != "")).cast("long").alias("n_paragraphs")
    rows = rows.select("row", "id", full, told.alias("lines"))
    runs = F.filter(F.split(F.array_join("lines", "\n"), "\n{2,}"), lambda x: F.contains(F.trim(x, F.lit("\n")), F.lit("\n")))
    rows = rows.select("row", "id", "n_paragraphs", F.concat(F.filter("lines", lambda x: x != ""), runs).alias("told"))
    rows = stash(rows, "lines")

    clean = F.filter(words(F.col("line")), lambda w: w != "")
    stop = lambda w: w.isin(*STOP)
    pairs = F.zip_with(F.slice(F.col("w"), 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice(F.col("w"), 2, F.size("w")), lambda a, b: F.when(~stop(a) | ~stop(b), F.concat_ws(" ", a, b)))
    found = F.array_distinct(F.filter(F.concat(F.filter("w", lambda w: ~stop(w)), pairs), lambda g: g.isNotNull()))
    each = (
        rows.select("row", F.posexplode("told").alias("at", "line"))
        .select("row", "at", clean.alias("w")).select("row", "at", F.explode(found).alias("gram"))
    )
    # Both tables are as large as the bundled notices make them.
    weights = ", ".join(f"('{g}', {', '.join(f'{w!r}D' for w in ws)})" for g, ws in sorted(model.weights.items()))
    table = spark.sql(f"SELECT * FROM VALUES {weights} AS t(gram, {', '.join(f'w{k}' for k in range(len(model.classes)))})")
    grams_ = ", ".join(f"('{f}', {n}, '{g}')" for f, n, g in templates())
    notices = spark.sql(f"SELECT * FROM VALUES {grams_} AS t(family, notice, gram)")
    totals = notices.groupBy("notice").agg(F.count("*").alias("all"))
    scored = (
        each.join(F.broadcast(table), "gram").groupBy("row", "at")
        .agg(*(F.round(F.sum(f"w{k}") + b, 6).alias(f"s{k}") for k, b in enumerate(model.bias)))
    )
    scores = [F.col(f"s{k}") for k in range(len(model.classes))]
    top = F.greatest(*scores)
    whole = sum((F.exp(s - top) for s in scores[1:]), F.exp(scores[0] - top))
    likely = F.coalesce(*(F.when(s == top, F.lit(c)) for s, c in zip(scores, model.classes)))
    scored = scored.select("row", "at", likely.alias("family"), (F.lit(1.0) / whole).alias("p"))
    matched = (
        each.join(F.broadcast(notices), "gram").groupBy("row", "at", "family", "notice").agg(F.count("*").alias("own"))
        .join(F.broadcast(totals), "notice").groupBy("row", "at", "family").agg(F.max(F.col("own") / F.col("all")).alias("held"))
    )
    sure = F.col("p") >= model.level
    confirmed = F.coalesce(F.col("held") >= overlap, F.lit(False))
    named = (
        scored.where(F.col("family") != NONE).join(matched, ["row", "at", "family"], "left").groupBy("row")
        .agg(
            F.count_if(sure & confirmed).alias("n_confirmed"), F.count_if(sure & ~confirmed).alias("n_unconfirmed"), F.count_if(~sure).alias("n_unknown"),
            F.array_join(F.sort_array(F.collect_set(F.when(sure & confirmed, F.col("family")))), ",").alias("families"),
        )
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.select("row", "id", "n_paragraphs").join(named, "row", "left").select(
        F.col("id").alias(id_col), "n_paragraphs", zero("n_confirmed"), zero("n_unconfirmed"), zero("n_unknown"), F.coalesce("families", F.lit("")).alias("families")
    )


def sql(model: Classifier, overlap: float = 0.6) -> str:
    """What ``scan`` gives for the table documents, as DuckDB SQL."""
    text = lambda x: "'" + x.replace("'", "''") + "'"
    stop, known = ", ".join(map(text, STOP)), ", ".join(map(text, model.words))
    weights = ", ".join(f"({text(g)}, {', '.join(map(repr, w))})" for g, w in sorted(model.weights.items()))
    notices = ", ".join(f"({text(f)}, {n}, {text(g)})" for f, n, g in templates())
    sums = ", ".join(f"round(sum(w{k}) + {b!r}, 6) AS s{k}" for k, b in enumerate(model.bias))
    columns = [f"s{k}" for k in range(len(model.classes))]
    likely = " ".join(f"WHEN {s} = top THEN {text(c)}" for s, c in zip(columns, model.classes))
    return f"""
WITH d AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), o AS (
  SELECT doc_id, list_transform(lines, lambda x: CASE WHEN list_has_any(regexp_split_to_array(lower(x), '[^a-z0-9]+'), [{known}]) THEN x ELSE '' END) AS lines FROM d
), r AS (
  SELECT doc_id, list_concat(list_filter(lines, lambda x: x <> ''),
    list_filter(regexp_split_to_array(array_to_string(lines, chr(10)), '\\n{{2,}}'), lambda x: contains(trim(x, chr(10)), chr(10)))) AS lines FROM o
), l AS (
  SELECT doc_id, unnest(range(1, len(lines) + 1)) AS at_, unnest(lines) AS line FROM r
), w AS (
  SELECT doc_id, at_, list_filter(regexp_split_to_array(lower(line), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM l
), p AS (
  SELECT doc_id, at_, unnest(w) AS a, unnest(list_append(w[2:], NULL)) AS b FROM w
), g AS (
  SELECT DISTINCT doc_id, at_, gram FROM (
    SELECT doc_id, at_, a AS gram FROM p WHERE a NOT IN ({stop})
    UNION ALL SELECT doc_id, at_, a || ' ' || b FROM p WHERE b IS NOT NULL AND (a NOT IN ({stop}) OR b NOT IN ({stop})))
), t(gram, {", ".join(f"w{k}" for k in range(len(columns)))}) AS (VALUES {weights}),
n(family, notice, gram) AS (VALUES {notices}),
s AS (SELECT doc_id, at_, {sums} FROM g JOIN t USING (gram) GROUP BY doc_id, at_),
b AS (SELECT *, greatest({", ".join(columns)}) AS top FROM s),
c AS (SELECT doc_id, at_, CASE {likely} END AS family, 1.0 / ({" + ".join(f"exp({s} - top)" for s in columns)}) AS p FROM b),
m AS (
  SELECT doc_id, at_, family, max(own / all_) AS held FROM (
    SELECT doc_id, at_, family, notice, count(*) AS own FROM g JOIN n USING (gram) GROUP BY ALL)
  JOIN (SELECT notice, count(*) AS all_ FROM n GROUP BY notice) USING (notice) GROUP BY doc_id, at_, family
), f AS (
  SELECT doc_id, count(*) FILTER (p >= {model.level!r} AND coalesce(held, 0) >= {overlap}) AS n_confirmed,
    count(*) FILTER (p >= {model.level!r} AND coalesce(held, 0) < {overlap}) AS n_unconfirmed, count(*) FILTER (p < {model.level!r}) AS n_unknown,
    string_agg(DISTINCT family, ',' ORDER BY family) FILTER (p >= {model.level!r} AND coalesce(held, 0) >= {overlap}) AS families
  FROM c LEFT JOIN m USING (doc_id, at_, family) WHERE family <> '{NONE}' GROUP BY doc_id
)
SELECT doc_id, CAST(len(list_filter(lines, lambda x: trim(x) <> '')) AS BIGINT) AS n_paragraphs, coalesce(n_confirmed, 0) AS n_confirmed, coalesce(n_unconfirmed, 0) AS n_unconfirmed,
  coalesce(n_unknown, 0) AS n_unknown, coalesce(families, '') AS families FROM d LEFT JOIN f USING (doc_id)
"""
