"""Licence scan: a trained paragraph classifier over word n-grams, confirmed by comparison with notices. Scanning uses DataFrame expressions only."""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulewright.llm.common import with_row_ids

#: Notices by family, as works carry them.
NOTICES = {
    "MIT": [
        "Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT", "This software is available under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    ],
    "Apache": [
        "Licensed under the Apache License, Version 2.0.", "Released under the Apache License 2.0.", "SPDX-License-Identifier: Apache-2.0", "Apache Software License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-3.0-or-later", "Released under the GPL, version 3 or later.",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    ],
    "LGPL": ["Licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-2.1", "Released under the LGPL.", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "AGPL": ["Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0", "Released under the AGPL.", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "BSD": [
        "Licensed under the BSD 3-Clause License.", "Released under the 2-clause BSD license.", "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "ISC": ["Released under the ISC License.", "SPDX-License-Identifier: ISC", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted"],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "Released under the Unlicense.", "SPDX-License-Identifier: Unlicense"],
    "CC0": ["Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related rights to this work.", "Dedicated to the public domain under CC0."],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Available under the Creative Commons Attribution license."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Text is available under the Creative Commons Attribution-ShareAlike License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC-SA 4.0.", "Licensed under CC BY-NC-ND 4.0."],
    "Reserved": ["All rights reserved.", "Copyright 2020. All rights reserved.", "No part of this publication may be reproduced without the prior written permission of the publisher."],
}
#: Paragraphs that share words with notices and are none.
OTHERS = [
    "He lost his driving license on the way to the office.", "The license plate of the car was covered with mud.", "All rights and duties of the members are set out below.", "The public domain of the park lies to the north.", "She has a fishing license and a general interest in birds.",
    "The software was released last week to the public.", "This work is hard and the conditions are poor.", "You may obtain a copy of the map at the desk.", "The apache helicopter landed near the village.", "They study at MIT and publish their source code.", "The foundation gives free copies of the book to schools.",
    "A permission slip is needed for any person under ten.", "The commons were open to all without restriction.", "Version 2 of the plan was accepted without modification.", "The attribution of the painting to the master is doubtful.", "Subject to the terms agreed, the sale goes ahead.", "General rules for public buildings and their use.",
    "The author has waived the fee for this talk.", "It was reserved for all guests of the house.", "In compliance with the rules the file was closed.", "Binary stars and their forms.", "The following conditions are met by few.", "Mozilla makes a browser.", "The gnu is an antelope.", "A clause in the contract was struck out.", "Related rights of way were discussed.",
]
#: Function words: an n-gram of these alone is no feature, so a paragraph without any other word of the notices has only the intercepts.
FUNCTION_WORDS = frozenset("a an and any are as at be by can for from has have he i if in into is it its may no not of on or part she that the their they this to under was were which with without you".split())
#: What parts two blocks of lines.
_BLANK = r"\n(?:[^\S\n]*\n)+"
_FILL = "the report shows that results of many years were seen as good by most people in town and later work came to other ends with some new plans for a better way".split()


def tokens(text: str) -> list[str]:
    return re.findall("[0-9a-z]+", text.lower())


def grams(words: list[str], longest: int = 3) -> set[str]:
    """N-grams of 1 to longest words, each with a word other than a function word or a number in it."""
    out = set()
    for n in range(1, longest + 1):
        for i in range(len(words) - n + 1):
            part = words[i : i + n]
            if any(w not in FUNCTION_WORDS and not w.isdigit() for w in part):
                out.add(" ".join(part))
    return out


@dataclass(frozen=True)
class Model:
    families: tuple[str, ...]  # the last is unknown
    features: tuple[str, ...]
    weights: np.ndarray  # features x families
    intercepts: np.ndarray
    temperature: float


def _examples(seed: int, copies: int) -> tuple[list[list[str]], list[int]]:
    """Notices with words lost or put around them, and paragraphs that are none: the others and mixed words."""
    rng = np.random.default_rng(seed)
    texts, classes = [], []
    pick = lambda words, n: [words[i] for i in rng.integers(0, len(words), n)]
    families = list(NOTICES)
    every = [w for notices in NOTICES.values() for n in notices for w in tokens(n)]
    for k, family in enumerate(families):
        for notice in NOTICES[family]:
            for _ in range(copies):
                words = tokens(notice)
                if len(words) > 5 and rng.random() < 0.4:
                    del words[int(rng.integers(0, len(words)))]
                texts.append(pick(_FILL, int(rng.integers(0, 8))) * int(rng.random() < 0.5) + words + pick(_FILL, int(rng.integers(0, 8))) * int(rng.random() < 0.5))
                classes.append(k)
    for _ in range(copies):
        for other in OTHERS:
            texts.append(tokens(other) + pick(_FILL, int(rng.integers(0, 10))))
            classes.append(len(families))
        for _ in range(30):
            texts.append(pick(_FILL, 10) + pick(every, int(rng.integers(1, 5))))
            classes.append(len(families))
    return texts, classes


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@functools.cache
def train(penalty: float = 2e-4, rounds: int = 400) -> Model:
    """Multinomial logistic regression with an L1 penalty, by accelerated proximal gradients, and a temperature that calibrates it on examples that it has not seen. The examples are those above: a few thousand, whatever the corpus."""
    texts, classes = _examples(1, 8)
    features = sorted(set().union(*(grams(tokens(n)) for notices in NOTICES.values() for n in notices)))
    number = {g: i for i, g in enumerate(features)}

    def matrix(texts: list[list[str]]) -> np.ndarray:
        x = np.zeros((len(texts), len(features) + 1))
        x[:, -1] = 1
        for i, words in enumerate(texts):
            x[i, [number[g] for g in grams(words) if g in number]] = 1
        return x

    x, y = matrix(texts), np.eye(len(NOTICES) + 1)[classes]
    step = len(x) / (0.5 * np.linalg.norm(x, 2) ** 2)
    w = ahead = np.zeros((x.shape[1], y.shape[1]))
    t = 1.0
    for _ in range(rounds):
        new = ahead - step * (x.T @ (_softmax(x @ ahead) - y)) / len(x)
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * penalty, 0)
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead, w = new + (last - 1) / t * (new - w), new
    held, held_classes = _examples(2, 3)
    z = matrix(held) @ w
    rows = np.arange(len(z))
    loss = {c: -np.log(_softmax(z / c)[rows, held_classes] + 1e-12).mean() for c in np.linspace(0.3, 3, 28)}
    used = np.abs(w[:-1]).sum(1) > 0
    return Model((*NOTICES, "unknown"), tuple(np.array(features)[used].tolist()), w[:-1][used], w[-1], float(min(loss, key=loss.get)))


def _split(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^0-9a-z]+"), lambda w: w != "")


def _grams(words: Column, n: int) -> Column:
    starts = F.sequence(F.lit(1), F.size(words) - (n - 1))
    return F.when(F.size(words) >= n, F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))


@functools.cache
def key_words(similarity: float) -> tuple[str, ...]:
    """Words of which a text has one if it holds this share of some notice's bigrams: enough of each notice's bigrams have one of them."""
    left = {n: [set(p) for p in zip(tokens(n), tokens(n)[1:])] for notices in NOTICES.values() for n in notices}
    size = {n: len({tuple(p) for p in zip(tokens(n), tokens(n)[1:])}) for n in left}
    out: list[str] = []
    while True:
        open_ = {n: pairs for n, pairs in left.items() if len(pairs) >= similarity * size[n]}
        counts: dict[str, int] = {}
        for n, pairs in open_.items():
            for w in set().union(*pairs):
                counts[w] = counts.get(w, 0) + (w not in FUNCTION_WORDS and not w.isdigit())
        if not counts:
            return tuple(sorted(out))
        word = max(sorted(counts), key=lambda w: counts[w])
        out.append(word)
        left = {n: [p for p in pairs if word not in p] for n, pairs in left.items()}


def scan(docs: DataFrame, *, probability: float = 0.5, similarity: float = 0.6) -> DataFrame:
    """Columns doc_id, n_paragraphs, n_found, licences, findings, n_unknown: a row for each row of docs (doc_id, text).

    A paragraph is a line, and also the lines between two blank ones together, as notices are often wrapped; such a block has the number of its first line, and is a finding only where none of its lines is one of that family. n_paragraphs and n_unknown count lines. A line that holds a word of the notices (other than function words and numbers) is classified by its distinct word n-grams; it is a finding if a family's
    probability is highest and at least `probability`, and if its bigrams hold at least `similarity` of those of one of the family's notices. findings lists
    paragraph:family:probability in per cent:similarity in per cent, by paragraph; n_unknown counts the classified paragraphs that are none. All other paragraphs have the intercepts'
    class, unknown. The weights and notices are joined by broadcast: their size is that of the lists above, whatever the corpus.

    Null and empty texts have one empty paragraph and no finding. Repeated rows and null doc_ids are rows of their own. Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    model = train()
    k = len(model.families)
    words_known = F.array(*[F.lit(w) for w in sorted({w for notices in NOTICES.values() for n in notices for w in tokens(n) if w not in FUNCTION_WORDS and not w.isdigit()})])
    weights = spark.createDataFrame([(g, [float(x) for x in row]) for g, row in zip(model.features, model.weights, strict=True)], "gram string, w array<double>")
    bigrams = [(f, i, sorted({" ".join(p) for p in zip(tokens(n), tokens(n)[1:])})) for f in NOTICES for i, n in enumerate(NOTICES[f])]
    notices = spark.createDataFrame([(f, i, len(g), x) for f, i, g in bigrams for x in g], "family string, notice int, size int, gram string")

    rows = with_row_ids(docs)
    some = rows.filter(F.arrays_overlap(_split(F.col("text")), words_known)).select("uid", F.posexplode(F.split("text", "\n")).alias("paragraph", "line"))
    lines = some.select("uid", "paragraph", F.lit(1).alias("n"), _split(F.col("line")).alias("words")).filter(F.arrays_overlap("words", words_known))
    has_key = lambda c: F.lower(c).rlike("(?<![0-9a-z])(?:" + "|".join(key_words(similarity)) + ")(?![0-9a-z])")
    rows_of = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    before = lambda parts: F.aggregate(F.slice(parts, F.lit(1), F.col("i")), F.lit(0), lambda s, x: s + rows_of(x))
    blocks = rows.filter(F.contains("text", F.lit("\n")) & has_key(F.col("text"))).select("uid", "text", F.posexplode(F.split("text", _BLANK)).alias("i", "block"))
    blocks = blocks.filter(F.contains("block", F.lit("\n")) & has_key(F.col("block")))
    at = before(F.split("text", _BLANK)) + before(F.regexp_extract_all("text", F.lit(_BLANK), F.lit(0)))
    lines = lines.unionAll(blocks.select("uid", at.alias("paragraph"), (rows_of(F.col("block")) + 1).alias("n"), _split(F.col("block"))))
    every = F.array_distinct(F.concat(*[_grams(F.col("words"), n) for n in (1, 2, 3)]))
    exploded = lines.select("uid", "paragraph", "n", F.explode(every).alias("gram"))
    scored = exploded.join(F.broadcast(weights), "gram", "left").groupBy("uid", "paragraph", "n").agg(*[F.coalesce(F.sum(F.col("w")[i]), F.lit(0.0)).alias(f"z{i}") for i in range(k)])
    scaled = [(F.col(f"z{i}") + float(model.intercepts[i])) / model.temperature for i in range(k)]
    top = F.greatest(*scaled)
    total = sum((F.exp(z - top) for z in scaled), F.lit(0.0))
    family = F.coalesce(*[F.when(z == top, F.lit(f)) for z, f in zip(scaled, model.families, strict=True)])
    said = scored.select("uid", "paragraph", "n", family.alias("family"), (1 / total).alias("probability"))
    shared = lines.select("uid", "paragraph", "n", F.explode(F.array_distinct(_grams(F.col("words"), 2))).alias("gram")).join(F.broadcast(notices), "gram")
    shared = shared.groupBy("uid", "paragraph", "n", "family", "notice").agg((F.count(F.lit(1)) / F.first("size")).alias("share")).groupBy("uid", "paragraph", "n", "family").agg(F.max("share").alias("similarity"))
    judged = said.join(shared, ["uid", "paragraph", "n", "family"], "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
    good = (F.col("family") != "unknown") & (F.col("probability") >= probability) & (F.col("similarity") >= similarity)
    entry = F.struct("paragraph", "family", F.round(F.col("probability") * 100).cast("int").alias("p"), F.round(F.col("similarity") * 100).cast("int").alias("s"), "n")
    found = judged.groupBy("uid").agg(F.array_sort(F.collect_list(F.when(good, entry))).alias("found"), F.count_if(~good & (F.col("n") == 1)).alias("n_unknown"))
    said_by_line = lambda e: F.exists("found", lambda x: (x["n"] == 1) & (x["family"] == e["family"]) & x["paragraph"].between(e["paragraph"], e["paragraph"] + e["n"] - 1))
    found = found.withColumn("found", F.filter("found", lambda e: (e["n"] == 1) | ~said_by_line(e)))
    base = rows.select("uid", "doc_id", F.size(F.split("text", "\n")).cast("long").alias("n_paragraphs")).join(found, "uid", "left")
    listed = F.transform("found", lambda e: F.concat_ws(":", e["paragraph"].cast("string"), e["family"], e["p"].cast("string"), e["s"].cast("string")))
    return base.select(
        "doc_id", "n_paragraphs", F.coalesce(F.size("found"), F.lit(0)).cast("long").alias("n_found"), F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.col("found.family"))), ","), F.lit("")).alias("licences"),
        F.coalesce(F.array_join(listed, ","), F.lit("")).alias("findings"), F.coalesce("n_unknown", F.lit(0)).cast("long").alias("n_unknown"),
    )
