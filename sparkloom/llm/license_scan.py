"""Licence scan: a trained paragraph classifier, applied in DataFrame functions only.

Classified are the paragraphs of a text (runs of lines between blank ones, joined, so that a notice
wrapped over lines is seen as a whole) and their single lines, as notices often stand in running text.
Each is a sparse vector of its word n-grams, n up to 3. Multinomial logistic regression over them names
a licence family or "unknown"; a temperature fitted on held-out examples, among them licences that the
model never saw, calibrates the probabilities, and what is under `least` for every family is unknown.

A prediction is confirmed by comparison with the family's templates, over all their n-grams: `similar` or
more of one template stand in the paragraph, or PART or more of the paragraph's n-grams, WHOLE at least,
are features of one template (a notice that is cut off). A paragraph of several lines is a finding of its own,
at its first line, unless a template of the same family stands in a line of it. Where it is confirmed,
lines that hold no template are a part of it and no findings.

The scan first looks for anchors: words, one of each of the n-grams without which the weights cannot
lift a family above unknown (`anchors`, computed from the weights). What holds none is unknown, so
nothing is lost. N-grams of function words and numbers alone are no features. The model is trained on the
driver from the texts below; its weights, whole thousandths, are a table of bounded size (the n-grams of
those texts), which is broadcast.

Nulls count as empty texts, which have no licence; texts are read whole, however long; a document is
known by doc_id (null included) and the digest of its text, repeated rows being reported once; of equal
logits the family first in order of names wins; two equal paragraphs of a text are two findings; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LEAST, SIMILAR, PART, WHOLE, SIZE, SPARSE, RATE = 0.5, 0.75, 0.6, 12, 3, 0.001, 0.1
UNKNOWN = "unknown"

#: Notices by family, in the words that their publishers ask for (fixed values).
TEMPLATES = {
    "agpl": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Released under the AGPL. AGPLv3. SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "Distributed under the terms of the Apache License 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "bsd": [
        "Released under the BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This article is distributed under the terms of the Creative Commons Attribution License, which permits unrestricted use, provided the original author and source are credited.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
    ],
    "cc0": [
        "Dedicated to the public domain under CC0 1.0.",
        "CC0 1.0 Universal Public Domain Dedication",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ],
    "epl": [
        "Licensed under the Eclipse Public License 2.0.",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 2 or later.",
        "Released under GPLv3.",
        "Licensed under the GPL.",
        "SPDX-License-Identifier: GPL-2.0-only",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "isc": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "Released under the LGPL. LGPLv3. SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright. All rights reserved.",
        "Proprietary and confidential. All rights reserved.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
}
#: Licences of none of the families, for the unknown class; every other one is held out.
OTHERS = [
    "Licensed under the Boost Software License, Version 1.0.", "This program is licensed under the Artistic License 2.0.",
    "Licensed under the Common Development and Distribution License (CDDL), version 1.0.", "Licensed under the Open Software License version 3.0.",
    "Distributed under the terms of the Server Side Public License, version 1.", "Released under the terms of the Academic Free License.",
    "Licensed under the Microsoft Public License.", "This work is licensed under the Open Data Commons Attribution License.",
    "Released under the Python Software Foundation License Version 2.", "The code is licensed under the Business Source License 1.1.",
    "Licensed under the IBM Public License, version 1.0.", "This documentation is licensed under the GNU Free Documentation License.",
    "This file is distributed under the same license as the project.", "The software is licensed under the NASA Open Source Agreement version 1.3.",
]
#: Sentences of ordinary prose with words of the templates, for the unknown class.
PROSE = [
    "His driving license was lost in the mail.", "They argued about human rights all night.", "The warranty of the kettle had expired.", "She studied at MIT before the war.",
    "The apache helicopter landed on the field.", "A gnu and a zebra crossed the common.", "The domain of the function is the set of reals.", "The House of Commons met again.",
    "It was released under the terms of the contract.", "You can use it for any purpose, with or without a permit.", "The river moves to the sea and the people are free to use the work of the city.",
    "They say that it has been so for years, as those who are with us may know, and that not all can see it.", "What are you to do with a house that has not been lived in for so long as this?",
    "As for that, so far it has not rained and the roads are dry with dust.", "You may see that there are so many of them, as it has not been for a while with us.",
    "Copyright is a matter for the courts.", "Please cc the editor.", "The fishing license costs ten dollars.", "All animals have rights.", "Modern redistribution of income is a subject of the book.",
    "All seats are reserved for the guests.", "She reserves the right to refuse.", "The table was reserved and all the rights were sold.", "The eclipse was visible to the public in the north.",
    "General conditions of the public health service were poor.", "The author was granted permission to copy the letters.", "Permission to enter was denied.", "A free version of the program is available at the door.",
    "The source of the river is in the mountains, and the form of it is a fork.", "The foundation published a free report.", "The library is free and open to any person.", "They modified the terms and distributed copies to the members.",
    "The public domain of the king was wide.", "Creative people made the commons green.", "Mozilla is the name of a lizard in the film.", "Er kam mit dem Zug und fuhr mit seiner Frau nach Hause.", "Wir sprechen mit ihm.", "Das Haus mit Garten wurde verkauft.", "Kaffee mit Milch, bitte.", "A person obtained a copy of the documents without charge.",
]
#: Words that say nothing by themselves; n-grams of these and of numbers alone are no features.
FUNCTION_WORDS = {
    "a", "an", "and", "any", "all", "are", "as", "at", "be", "been", "but", "by", "can", "do", "either", "even", "for", "from", "has", "have", "he", "if", "in", "into", "is", "it", "its", "may", "more", "must",
    "no", "nor", "not", "of", "on", "one", "or", "other", "own", "per", "see", "shall", "should", "so", "such", "than", "that", "the", "their", "them", "then", "there", "these", "they", "this", "those", "to",
    "under", "us", "use", "used", "via", "v", "was", "we", "were", "which", "who", "whom", "will", "with", "without", "you", "your", "above", "along", "c",
}
_SPLIT = r"[^a-z0-9]+"


def _counts(gram: str) -> bool:
    return any(w not in FUNCTION_WORDS and not w.isdigit() for w in gram.split(" "))


def grams(text: str) -> set[str]:
    """The distinct n-grams of a paragraph."""
    words = [w for w in re.split(_SPLIT, text.lower()) if w]
    return {" ".join(words[i : i + n]) for n in range(1, SIZE + 1) for i in range(len(words) - n + 1)}


def _examples(rng: random.Random, classes: list[str]) -> list[tuple[str, int, bool]]:
    """Texts with their class, and whether they are held out."""
    noise = ["see", "file", "data", "note", "2024", "inc", "project", "john", "smith", "by", "ltd"]
    out = []
    for family, texts in TEMPLATES.items():
        for text in texts:
            words = text.split()
            for k in range(12 if len(words) <= 12 else 36):
                part = [w for w in words if k < 4 or rng.random() > 0.1]
                if len(words) > 12 and k % 12 > 2:  # a part of a notice: wrapped, or cut off
                    at = rng.randrange(len(words) - 8) if k % 2 else 0
                    part = words[at : at + rng.randint(8, 24)]
                extra = [rng.choice(noise) for _ in range(rng.randrange(4))]
                out.append((" ".join(extra + part if k % 2 else part + extra), classes.index(family), k % 6 == 5))
    for i, text in enumerate([*PROSE, *OTHERS]):
        out += [(text if k < 2 else " ".join(w for w in text.split() if rng.random() > 0.1), len(classes) - 1, i % 2 == 1) for k in range(8)]
    vocabulary = sorted({w for texts in TEMPLATES.values() for t in texts for w in t.split()})
    for k in range(300):  # words of the templates in no order
        out.append((" ".join(rng.sample(vocabulary, rng.randint(3, 9) if k % 2 else rng.randint(10, 60))), len(classes) - 1, k % 4 == 3))
    for k in range(150):  # a made-up licence
        name = " ".join("".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(rng.randint(1, 2)))
        start = rng.choice(["Licensed under the", "Released under the", "Distributed under the terms of the", "This work is licensed under the", "Redistribution is subject to the"])
        out.append((f"{start} {name} {rng.choice(['License', 'Public License', 'Software License', 'General License', 'Open License'])} {rng.choice(['', 'version 1.0', '2.0', 'v3', 'or later'])}", len(classes) - 1, k % 2 == 1))
    return out


@lru_cache(1)
def trained(epochs: int = 40, seed: int = 11) -> tuple[list[str], dict[str, list[int]], list[int]]:
    """Classes, weights by n-gram and biases, in thousandths, the temperature divided in already."""
    rng = random.Random(seed)
    classes = [*sorted(TEMPLATES), UNKNOWN]
    every = [t for texts in TEMPLATES.values() for t in texts] + PROSE + OTHERS
    learned = sorted(g for g in set().union(*map(grams, every)) if _counts(g))
    place = {g: i for i, g in enumerate(learned)}
    examples = [(np.array([place[g] for g in sorted(grams(t)) if g in place], int), y, h) for t, y, h in _examples(rng, classes)]
    learn, held = [e for e in examples if not e[2]], [e for e in examples if e[2]]
    weights, bias = np.zeros((len(learned), len(classes))), np.array([0.0] * (len(classes) - 1) + [3.0])

    def softmax(z):
        e = np.exp(z - z.max())
        return e / e.sum()

    seen, seen_bias = np.full(weights.shape, 1e-6), np.full(len(classes), 1e-6)
    for _ in range(epochs):
        rng.shuffle(learn)
        for x, y, _ in learn:  # steps by the gradients that an n-gram has met (AdaGrad)
            g = softmax(bias + weights[x].sum(0)) - (np.arange(len(classes)) == y)
            seen[x] += g * g
            step = RATE / np.sqrt(seen[x])
            moved = weights[x] - step * g
            weights[x] = np.sign(moved) * np.maximum(np.abs(moved) - SPARSE * step, 0)  # L1
            seen_bias += g * g
            bias -= RATE / np.sqrt(seen_bias) * g
    loss = lambda t: -sum(np.log(softmax((bias + weights[x].sum(0)) / t)[y] + 1e-12) for x, y, _ in held)
    heat = min((t / 4 for t in range(2, 33)), key=loss)
    whole = lambda a: np.rint(1000 * a / heat).astype(int).tolist()
    return classes, {g: w for g, w in zip(learned, whole(weights), strict=True) if any(w) or any(g in grams(t) for texts in TEMPLATES.values() for t in texts)}, whole(bias)


@lru_cache(1)
def anchors() -> list[str]:
    """Words, one of which every text holds whose best class is a family: taken until, for each family,
    the n-grams without any of them cannot outweigh the bias of unknown; those that gain most first."""
    classes, weights, bias = trained()
    gains = [Counter() for _ in classes[:-1]]
    for g, w in weights.items():
        for k, gain in enumerate(gains):
            if w[k] > w[-1]:
                gain[g] += w[k] - w[-1]
    words: dict[str, list[str]] = {}
    for g in weights:
        for word in {w for w in g.split(" ") if _counts(w)}:
            words.setdefault(word, []).append(g)
    out: set[str] = set()
    room = [bias[-1] - bias[k] for k in range(len(gains))]
    while True:
        short = [k for k, gain in enumerate(gains) if sum(gain.values()) >= room[k]]
        if not short:
            return sorted(out)
        best = max(sorted(words), key=lambda w: (sum(gains[k][g] for k in short for g in words[w]), len(w)))
        out.add(best)
        for g in words[best]:
            for gain in gains:
                gain.pop(g, None)


def places(n: int) -> int:
    """How many n-grams of up to SIZE words stand in n words."""
    return sum(max(0, n - k) for k in range(SIZE))


def _grams(paragraph):
    """places, grams: the number of n-grams, and the distinct ones that the model knows. They begin at
    words that some known n-gram begins with, so that no others are formed."""
    known = sorted(trained()[1])
    first = _list(sorted({g.split(" ")[0] for g in known}))
    words = F.filter(F.split(paragraph, _SPLIT), lambda w: w != "")

    def of(ws):
        starts = _bound(F.array_intersect(ws, first), lambda some: F.filter(F.sequence(F.lit(1), F.greatest(F.size(ws), F.lit(1))), lambda i: F.array_contains(some, F.try_element_at(ws, i))))
        every = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(SIZE), F.size(ws) - i + 1)), lambda n: F.array_join(F.slice(ws, i, n), " "))))
        n = F.size(ws)
        return F.struct(sum((F.greatest(n - k, F.lit(0)) for k in range(SIZE)), F.lit(0)).alias("places"), F.array_intersect(every, _list(known)).alias("grams"))

    return _bound(words, of)


def _list(values: list[str]):
    """A constant array."""
    return F.split(F.lit("|".join(values)), r"\|")


def _bound(value, then):
    """`then` of a column that is computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _paragraphs(low):
    """first, lines: each run of lines that are not blank, and the number of its first line, from 1."""
    def runs(ls):
        blank = lambda i: F.get(ls, i).rlike(r"^\s*$")
        begins = F.filter(F.transform(ls, lambda x, i: F.when(~blank(i) & ((i == 0) | F.coalesce(blank(i - 1), F.lit(True))), i + 1)), lambda i: i.isNotNull())
        ends = F.filter(F.transform(ls, lambda x, i: F.when(~blank(i) & F.coalesce(blank(i + 1), F.lit(True)), i + 1)), lambda i: i.isNotNull())
        return F.zip_with(begins, ends, lambda a, b: F.struct(a.alias("first"), F.slice(ls, a, b - a + 1).alias("lines")))

    return _bound(F.split(low, "\n", -1), runs)


def _holds(low):
    """Whether a text in lower case holds an anchor."""
    return F.arrays_overlap(F.split(low, _SPLIT), _list(anchors()))


def _templates(classes: list[str]) -> list[tuple[int, set[str]]]:
    return [(k, {g for g in grams(t) if _counts(g)}) for k, c in enumerate(classes) for t in TEMPLATES.get(c, [])]


def license_scan(docs: DataFrame, least: float = LEAST, similar: float = SIMILAR, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, paragraph (number of its first line, from 1), family, probability, similarity, confirmed:
    the lines and the paragraphs of several lines that the classifier assigns to a family."""
    spark = docs.sparkSession
    classes, weights, bias = trained()
    low = F.lower(F.col(f"`{text}`").cast("string"))
    docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), low.alias("text")).filter(_holds(F.col("text")))
    blocks = docs.select("doc_id", F.xxhash64("text").alias("digest"), F.explode(_paragraphs(F.col("text"))).alias("p")).select("doc_id", "digest", F.col("p.first").alias("first"), F.col("p.lines").alias("lines"))

    def units(marked):  # an anchor never spans lines
        single = F.transform(F.filter(marked, lambda m: m["some"]), lambda m: F.struct(m["paragraph"].alias("paragraph"), F.lit(False).alias("joined"), m["line"].alias("line")))
        whole = F.array(F.struct(F.col("first").alias("paragraph"), F.lit(True).alias("joined"), F.array_join("lines", " ").alias("line")))
        return F.when((F.size(single) > 0) & (F.size("lines") > 1), F.concat(single, whole)).otherwise(single)

    marked = F.transform("lines", lambda x, i: F.struct((F.col("first") + i).alias("paragraph"), x.alias("line"), _holds(x).alias("some")))
    units = blocks.select("doc_id", "digest", "first", F.explode(_bound(marked, units)).alias("u")).select("doc_id", "digest", "first", "u.*")
    key = ["doc_id", "digest", "first", "paragraph", "joined"]
    ordered, held = sorted(weights), _templates(classes)
    found = units.select(*key, _grams(F.col("line")).alias("g")).filter(F.size("g.grams") > 0)
    # the gram "" stands in each paragraph once, so that rows that occur twice can be told from one
    found = found.select(*key, F.col("g.places").alias("places"), F.explode(F.concat(F.array(F.lit("")), "g.grams")).alias("gram"))
    rows = [("", 1, *bias, *[0] * len(held))] + [(g, 0, *weights[g], *(int(g in x) for _, x in held)) for g in ordered]
    w, t = ([f"{x}{k}" for k in range(n)] for x, n in (("w", len(classes)), ("t", len(held))))
    table = spark.createDataFrame(rows, ", ".join(["gram string", "copies int", *(f"{c} int" for c in w + t)]))  # n-grams of the texts above, by class and template
    summed = found.join(F.broadcast(table), "gram").groupBy(*key, "places").agg(*(F.sum(c).alias(c) for c in ["copies", *w, *t]))
    copies = F.col("copies")

    def alike(k, over):
        return F.greatest(F.lit(0.0), F.lit(0.0), *(F.col(t[j]) / copies / over(x) for j, (c, x) in enumerate(held) if c == k))

    options = F.array(*(F.struct((F.col(w[k]) / copies / 1000).alias("z"), F.lit(-k).alias("k"), alike(k, len).alias("entire"), alike(k, lambda _: F.col("places")).alias("part")) for k in range(len(classes))))
    best = summed.select(*key, "places", options.alias("options")).withColumn("best", F.array_max("options"))
    total = F.aggregate("options", F.lit(0.0), lambda sum_, o: sum_ + F.exp(o["z"] - F.col("best.z")))
    near = F.greatest("best.entire", F.when(F.col("places") >= WHOLE, F.col("best.part")).otherwise(0.0))
    best = best.select(*key, F.element_at(F.array(*map(F.lit, classes)), 1 - F.col("best.k")).alias("family"), (1 / total).alias("probability"), near.alias("similarity"), (F.col("best.entire") >= similar).alias("entire"), ((F.col("places") >= WHOLE) & (F.col("best.part") >= PART)).alias("part"))
    best = best.filter((F.col("family") != UNKNOWN) & (F.col("probability") >= least)).withColumn("confirmed", F.col("entire") | F.col("part"))
    block = ["doc_id", "digest", "first"]
    best = best.withColumn("told", F.max(~F.col("joined") & F.col("entire")).over(Window.partitionBy(*block, "family"))).filter(~F.col("joined") | ~F.col("told"))
    best = best.withColumn("whole", F.max(F.col("joined") & F.col("confirmed")).over(Window.partitionBy(*block))).filter(F.col("joined") | F.col("entire") | ~F.col("whole"))
    return best.select("doc_id", "paragraph", "family", F.round("probability", 6).alias("probability"), F.round("similarity", 6).alias("similarity"), "confirmed")


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@lru_cache(1)
def op7_sql() -> str:
    """The same with the weights as a table of values."""
    classes, weights, bias = trained()
    held = _templates(classes)
    quoted = lambda g: "'" + g + "'"  # noqa: E731  n-grams hold letters, digits and blanks
    loads = ",".join(f"({quoted(g)},{k},{x})" for g, w in sorted(weights.items()) for k, x in enumerate(w) if x)
    marks = ",".join(f"({j},{quoted(g)})" for j, (_, x) in enumerate(held) for g in sorted(x))
    names = ",".join(f"({k},'{c}',{bias[k]})" for k, c in enumerate(classes))
    of = ",".join(f"({j},{k},{len(x)})" for j, (k, x) in enumerate(held))
    runs = " UNION ".join(f"SELECT u, array_to_string(ws[i:i + {n - 1}], ' ') AS gram FROM (SELECT u, ws, unnest(range(1, len(ws) - {n - 2})) AS i FROM words WHERE len(ws) >= {n})" for n in range(1, SIZE + 1))
    return rf"""
WITH loads(gram, k, x) AS (VALUES {loads}), marks(j, gram) AS (VALUES {marks}), names(k, family, bias) AS (VALUES {names}), templates(j, k, size) AS (VALUES {of}),
docs AS (SELECT DISTINCT doc_id, lower(text) AS text FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS no FROM docs),
solid AS (SELECT *, no - row_number() OVER (PARTITION BY doc_id, text ORDER BY no) AS block FROM lines WHERE NOT regexp_full_match(line, '[ \t\x0B\f\r]*')),
blocks AS (SELECT doc_id, text, min(no) AS first, string_agg(line, ' ' ORDER BY no) AS line, count(*) AS n, block FROM solid GROUP BY doc_id, text, block),
every AS (SELECT s.doc_id, s.text, b.first, no AS paragraph, false AS joined, s.line FROM solid s JOIN blocks b ON b.doc_id IS NOT DISTINCT FROM s.doc_id AND b.text = s.text AND b.block = s.block
  UNION ALL SELECT doc_id, text, first, first, true, line FROM blocks WHERE n > 1),
units AS (SELECT *, row_number() OVER () AS u FROM every),
words AS (SELECT u, list_filter(regexp_split_to_array(line, '{_SPLIT}'), lambda w: w <> '') AS ws FROM units),
grams AS ({runs}),
sizes AS (SELECT u, greatest(len(ws), 0) + greatest(len(ws) - 1, 0) + greatest(len(ws) - 2, 0) AS n FROM words),
sums AS (SELECT u, k, sum(x) AS z FROM grams JOIN loads USING (gram) GROUP BY u, k),
met AS (SELECT DISTINCT u FROM sums),
logits AS (SELECT u, k, family, (bias + coalesce(z, 0)) / 1000 AS z FROM met CROSS JOIN names LEFT JOIN sums USING (u, k)),
ranked AS (SELECT u, k, family, z, row_number() OVER (PARTITION BY u ORDER BY z DESC, k) AS n, 1 / sum(exp(z - top)) OVER (PARTITION BY u) AS probability FROM (SELECT *, max(z) OVER (PARTITION BY u) AS top FROM logits)),
best AS (SELECT u, k, family, probability FROM ranked WHERE n = 1 AND family <> '{UNKNOWN}' AND probability >= {LEAST}),
alike AS (SELECT u, k, max(c / size) AS entire, max(greatest(c / size, CASE WHEN n >= {WHOLE} THEN c / n ELSE 0 END)) AS similarity, max(CASE WHEN n >= {WHOLE} THEN c / n ELSE 0 END) AS part FROM
  (SELECT g.u, m.j, count(*) AS c FROM grams g JOIN best USING (u) JOIN marks m USING (gram) GROUP BY g.u, m.j) JOIN templates USING (j) JOIN sizes USING (u) GROUP BY u, k),
near AS (SELECT doc_id, text, first, paragraph, joined, family, probability, coalesce(similarity, 0) AS similarity, coalesce(entire, 0) >= {SIMILAR} OR coalesce(part, 0) >= {PART} AS confirmed, coalesce(entire, 0) >= {SIMILAR} AS entire
  FROM best JOIN units USING (u) LEFT JOIN alike USING (u, k)),
lone AS (SELECT *, max(NOT joined AND entire) OVER (PARTITION BY doc_id, text, first, family) AS told FROM near),
last AS (SELECT *, max(joined AND confirmed) OVER (PARTITION BY doc_id, text, first) AS whole FROM lone WHERE NOT joined OR NOT told)
SELECT doc_id, paragraph::INTEGER AS paragraph, family, round(probability, 6) AS probability, round(similarity, 6) AS similarity, confirmed FROM last WHERE joined OR entire OR NOT whole
"""
