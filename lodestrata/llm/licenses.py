"""Licence scan: a trained paragraph classifier, confirmed against templates.

A paragraph goes on over wrapped lines. A multinomial logistic regression over sparse word n-grams (one to
three words) tells licence families, licences of no known family, and other text apart. It is trained on
the driver, on the templates below, on cut and reworded forms of them, on forms that have lost what names
their family, and on a bounded sample of paragraphs of the corpus as counter-examples. Every feature holds a
cue word (a template word that is rare in the sample), so a paragraph without cue words has no feature and
cannot be a licence: Spark finds those with a cue word while it reads, and only they are scored, by a join
of their n-grams with the weights. One with a single cue word is no licence either. A temperature fitted on templates that were kept back calibrates the
probabilities; below ``least`` the family is unknown. The predicted family is confirmed if a template of it
shares its three-word sequences with the paragraph.

Bounds: ``SAMPLE`` counter-examples of ``EXAMPLE_WORDS`` words; weights have at most (templates' n-grams) rows.

Edge cases: null, empty and blank texts have no licence. A document with several licences reports all
families. Texts of any length are scanned whole. A null id is kept; rows that repeat are each reported. Extra
columns are neither read nor carried, so their names do not matter. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize

SAMPLE, EXAMPLE_WORDS = 2000, 400
NONE, UNKNOWN = "none", "unknown"
#: Notices by family (fixed values).
TEMPLATES: dict[str, list[str]] = {
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        "This project is licensed under the terms of the MIT license.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Use of this source code is governed by an MIT-style license.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ],
    "apache": [
        "You may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org/licenses/LICENSE-2.0.",
        "Distributed on an as is basis, without warranties or conditions of any kind, under the Apache License 2.0.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ],
    "agpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at mozilla.org/MPL/2.0.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the terms of the ISC license.",
    ],
    "cc-by": [
        "This text is available under the Creative Commons Attribution license.",
    ],
    "cc-by-nc": [
        "Available under the Creative Commons Attribution NonCommercial license.",
    ],
    "cc-by-sa": [
        "Text is available under the Creative Commons Attribution ShareAlike license.",
    ],
    "public-domain": [
        "This work has been dedicated to the public domain under CC0 1.0 Universal.",
        "This is free and unencumbered software released into the public domain.",
        "The author has waived all copyright and related rights to this work and dedicated it to the public domain.",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright. All rights reserved. No part of this publication may be reproduced without prior written permission.",
        "Proprietary and confidential. Unauthorized copying is prohibited.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited.",
    ],
}
#: Names by family, and how notices say them (fixed values).
NAMES: dict[str, list[str]] = {
    "mit": ["MIT License", "MIT license"],
    "bsd": ["BSD 3-Clause License", "BSD 2-Clause License", "BSD license"],
    "apache": ["Apache License, Version 2.0", "Apache 2.0 license", "Apache License"],
    "gpl": ["GNU General Public License, version 3", "GNU General Public License, version 2", "GNU GPL", "GPL v3"],
    "lgpl": ["GNU Lesser General Public License, version 3", "GNU LGPL", "LGPL 2.1"],
    "agpl": ["GNU Affero General Public License, version 3", "GNU AGPL", "AGPL v3"],
    "mpl": ["Mozilla Public License 2.0", "Mozilla Public License, v. 2.0", "MPL 2.0"],
    "isc": ["ISC License", "ISC license"],
    "cc-by": ["Creative Commons Attribution 4.0 International License", "Creative Commons Attribution license", "CC BY 4.0", "CC BY 3.0"],
    "cc-by-nc": ["Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0", "CC BY-NC 3.0"],
    "cc-by-sa": ["Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0", "CC BY-SA 3.0"],
    "public-domain": ["CC0 1.0 Universal", "Unlicense"],
}
SAID = ["Licensed under the {}.", "Licensed under {}.", "Released under the {}.", "This work is licensed under {}.", "This software is distributed under the terms of the {}.", "SPDX-License-Identifier: {}"]
for _family, _names in NAMES.items():
    TEMPLATES[_family] += [said.format(name) for said in SAID for name in _names]
SPLIT, SPLIT_CUES = "[^a-z0-9.]+", "[^a-z0-9]+"


def tokens(text: str) -> list[str]:
    return [w.strip(".") for w in re.split(SPLIT, text.lower()) if w.strip(".")]


def ngrams(ws: list[str], cues: set[str]) -> set[str]:
    return {" ".join(ws[i : i + n]) for n in (1, 2, 3) for i in range(len(ws) - n + 1) if cues & set(ws[i : i + n])}


def resembles(text: str, templates: dict[str, list[str]] = TEMPLATES, share: float = 0.6) -> bool:
    """Whether a paragraph holds a template's notice or is a piece of one: ``share`` of a template's words
    (three at least) stand within twice its length, or a run of four words and ``share`` of the
    paragraph's words are a template's."""
    ws = tokens(text)
    has = set(ws)
    for t in (tokens(t) for ts in templates.values() for t in ts):
        own = set(t)
        need = max(3, share * len(own))
        if len(own & has) >= need and any(len(own & set(ws[i : i + 2 * len(t)])) >= need for i in range(0, len(ws), len(t))):
            return True
        if len(own & has) >= max(4, share * len(has)) and {tuple(t[i : i + 4]) for i in range(len(t) - 3)} & {tuple(ws[i : i + 4]) for i in range(len(ws) - 3)}:
            return True
    return False


def _examples(templates: dict[str, list[str]], others: list[str], cues: set[str], rng: np.random.Generator) -> list[tuple[list[str], int, int]]:
    """(words, class, template): templates, cut and reworded forms of them, and what is like them but is not.

    Classes are the families, then licences of no known family, then other text. For the first of those two
    every word that stands in at most three families (some share a part of their names) gives way to words
    of other text.
    """
    fill = lambda n: tokens(others[int(rng.integers(len(others)))])[:n] if others and n else []
    unknown, none = len(templates), len(templates) + 1
    families_of: dict[str, set[int]] = {}
    for y, ts in enumerate(templates.values()):
        for t in ts:
            for w in tokens(t):
                families_of.setdefault(w, set()).add(y)
    rows = [(tokens(t), none, -1) for t in others]
    number = 0
    for y, ts in enumerate(templates.values()):
        for t in ts:
            ws = tokens(t)
            rows += [(ws, y, number)] * 3
            for k in range(12):  # cut at the ends, with a few words lost or put around
                cut = len(ws) // 4 if len(ws) > 7 else 0
                a, b = int(rng.integers(0, cut + 1)), len(ws) - int(rng.integers(0, cut + 1))
                part = [w for w in ws[a:b] if rng.random() > 0.05 or len(families_of[w]) <= 3]
                around = fill(int(rng.integers(0, 12)))
                rows.append((around + part if rng.random() < 0.5 else part + around, y, number))
                if k % 3 == 0:
                    strange = [x for w in part for x in (fill(1) or ["x"] if len(families_of[w]) <= 3 else [w])]
                    rows.append((strange, unknown, number))
            number += 1
    # a few cue words here and there in other text are no licence
    pool = sorted(cues)
    for _ in range(len(rows) // 2):
        ws = fill(30)
        for _ in range(int(rng.integers(1, 4))):
            ws.insert(int(rng.integers(len(ws) + 1)), pool[int(rng.integers(len(pool)))])
        rows.append((ws, none, -1))
    return rows


def _regression(x: np.ndarray, y: np.ndarray, k: int, rounds: int, rate: float, decay: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights and intercepts of a multinomial logistic regression, classes weighing the same."""
    w, b = np.zeros((x.shape[1], k), np.float32), np.zeros(k, np.float32)
    gw, gb = np.full_like(w, 1e-8), np.full_like(b, 1e-8)
    wanted = np.eye(k, dtype=np.float32)[y]
    weight = 1 / np.maximum(np.bincount(y, minlength=k), 1)[y]
    weight = (weight / weight.sum()).astype(np.float32)
    for _ in range(rounds):
        miss = (wanted - _softmax(x @ w + b)) * weight[:, None]
        g = x.T @ miss - decay * w
        gw += g * g
        w += rate * g / np.sqrt(gw)
        g = miss.sum(0)
        gb += g * g
        b += rate * g / np.sqrt(gb)
    return w, b


def train(others: list[str], templates: dict[str, list[str]] = TEMPLATES, rounds: int = 300, rate: float = 0.5, decay: float = 1e-5, seed: int = 3) -> dict:
    """Cue words, classes, weights by n-gram, intercepts (divided by the temperature).

    The temperature comes from a model that has not seen a fifth of the templates (nor any form of them): it is
    the one with which that model's probabilities suit those templates' forms best.
    """
    rng = np.random.default_rng(seed)
    plain: dict[str, int] = {}
    for t in others:
        for w in set(tokens(t)):
            plain[w] = plain.get(w, 0) + 1
    limit = max(2, len(others) // 200)
    ours = {w for ts in templates.values() for t in ts for w in tokens(t)}
    cues = {w for w in ours if plain.get(w, 0) <= limit and (len(w) > 2 or w in ("cc", "by", "nc", "sa"))}
    classes = [*templates, UNKNOWN, NONE]
    rows = _examples(templates, others, cues, rng)
    grams = [sorted(ngrams(ws, cues)) for ws, _, _ in rows]
    known = sorted({g for f, (_, y, _) in zip(grams, rows) if y < len(templates) for g in f if ours.issuperset(g.split())})
    number = {g: i for i, g in enumerate(known)}
    x = np.zeros((len(rows), len(known)), np.float32)
    for i, f in enumerate(grams):
        x[i, [number[g] for g in f if g in number]] = 1
    y, template = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    back = np.where(template < 0, np.arange(len(rows)) % 5 == 0, template % 5 == 2)
    w, b = _regression(x[~back], y[~back], len(classes), rounds, rate, decay)
    z = x[back] @ w + b
    heat = min((math.exp(k / 8) for k in range(-8, 25)), key=lambda t: -np.log(_softmax(z / t)[np.arange(len(z)), y[back]] + 1e-12).mean())
    w, b = _regression(x, y, len(classes), rounds, rate, decay)
    return {"cues": sorted(cues), "classes": classes, "grams": known, "weights": w / heat, "bias": b / heat, "templates": templates, "temperature": heat}


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _words(text: Column) -> Column:
    cut = F.transform(F.split(F.lower(text), SPLIT), lambda w: F.btrim(w, F.lit(".")))
    return F.filter(cut, lambda w: w != "")


def paragraphs(text: Column) -> Column:
    """Paragraphs of a text. A blank line ends one, and so does a line that ends a sentence; other lines are
    wrapped and go on in the next."""
    blank = F.regexp_replace(text, "\\n[ \\t\\x0B\\f\\r]*(?=\\n)", "\n\n")
    joined = F.regexp_replace(blank, "(?<=[^.!?\\n \\t\\x0B\\f\\r])[ \\t\\x0B\\f\\r]*\\n(?=[^\\n])", " ")
    return F.filter(F.split(joined, "\n"), lambda p: p.rlike("[^ \\t\\n\\x0B\\f\\r]"))


def counter_examples(docs: DataFrame, text_col: str = "text", n: int = SAMPLE, n_words: int = EXAMPLE_WORDS) -> list[str]:
    """At most n_words consecutive words of one paragraph of each of the n distinct texts with the least
    hashes. The hashes are found first, so that tasks send no texts but those."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.xxhash64(text).alias("h"), text.alias("t")).where("t <> ''")
    last = rows.select("h").distinct().orderBy("h").limit(n).agg(F.max("h")).first()[0]
    if last is None:
        return []
    picked = rows.where(F.col("h") <= last).select("h", paragraphs(F.col("t")).alias("ps")).where(F.size("ps") > 0)
    ws = F.split(F.get("ps", F.pmod("h", F.size("ps"))), " +")
    start = F.pmod(F.shiftright("h", 16), F.greatest(F.lit(1), F.size(ws) - (n_words - 1))) + 1
    chosen = picked.select("h", F.array_join(F.slice(ws, start.cast("int"), n_words), " ").alias("p")).groupBy("h").agg(F.first("p").alias("p"))
    return sorted(r[0] for r in chosen.select("p").collect() if r[0])


def fit(docs: DataFrame, text_col: str = "text") -> dict:
    """A model whose counter-examples are paragraphs of these documents. Those that name a licence or
    resemble a template are left out: they may be notices, and a notice may be as common as it likes."""
    return train([t for t in counter_examples(docs, text_col) if not {"license", "licence", "licensed"} & set(tokens(t)) and not resembles(t)])


def scan(docs: DataFrame, least: float = 0.6, share: float = 0.6, id_col: str = "doc_id", text_col: str = "text", model: dict | None = None) -> DataFrame:
    """One row per document: id, licenses (sorted families, ``unknown`` among them), n_paragraphs (licence
    paragraphs), best (the confirmed or else most probable family; among equals the last by name),
    probability, confirmed (a template of the family agrees with its paragraph)."""
    spark = docs.sparkSession
    model = model or fit(docs, text_col)
    cues = F.array(*[F.lit(w) for w in model["cues"]])
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    has_cue = lambda x: F.arrays_overlap(F.split(F.lower(x), SPLIT_CUES), cues)
    hits = F.when(has_cue(text), F.filter(paragraphs(text), has_cue)).otherwise(F.array().cast("array<string>"))
    rows = materialize(docs.select(F.col(f"`{id_col}`").alias("id"), F.monotonically_increasing_id().alias("rid"), hits.alias("hits")), "licence-paragraphs")
    para = rows.where(F.size("hits") > 0).select("rid", F.posexplode("hits").alias("p", "line")).select("rid", "p", _words(F.col("line")).alias("w"))

    def grams(n: int, ws="w") -> Column:
        upto = F.size(ws) - (n - 1)
        return F.when(upto > 0, F.transform(F.sequence(F.lit(1), upto), lambda i: F.array_join(F.slice(ws, i, n), " "))).otherwise(F.array().cast("array<string>"))

    k = len(model["classes"])
    table = spark.createDataFrame([(g, [float(v) for v in row]) for g, row in zip(model["grams"], model["weights"])], "gram string, v array<double>")
    found = para.select("rid", "p", F.explode(F.array_distinct(F.concat(grams(1), grams(2), grams(3)))).alias("gram")).join(F.broadcast(table), "gram")
    # a lone cue word says nothing, whatever its weight
    sums = found.groupBy("rid", "p").agg(*[F.sum(F.col("v")[j]).alias(f"z{j}") for j in range(k)], F.count_if(~F.contains("gram", F.lit(" "))).alias("cues")).where("cues > 1")
    z = sums.select("rid", "p", F.array(*[F.col(f"z{j}") + float(model["bias"][j]) for j in range(k)]).alias("z")).select("rid", "p", "z", F.array_max("z").alias("top"))
    exps = z.select("rid", "p", F.transform("z", lambda x: F.exp(x - F.col("top"))).alias("e")).select("rid", "p", "e", F.aggregate("e", F.lit(0.0), lambda a, x: a + x).alias("total"))
    prob = exps.select("rid", "p", (1 - F.col("e")[k - 1] / F.col("total")).alias("licence"), (F.array_max(F.slice("e", 1, k - 1)) / F.col("total")).alias("other"), F.slice("e", 1, k - 2).alias("f"), "total")
    prob = prob.select("rid", "p", "licence", "other", (F.array_max("f") / F.col("total")).alias("sure"), F.element_at(F.array(*[F.lit(f) for f in model["classes"]]), F.array_position("f", F.array_max("f")).cast("int")).alias("family"))
    named = F.col("sure") >= least
    prob = prob.where((F.col("licence") >= least) & (F.col("other") > 1 - F.col("licence"))).select("rid", "p", F.when(named, F.col("sure")).otherwise(F.col("licence")).alias("probability"), F.when(named, F.col("family")).otherwise(UNKNOWN).alias("family"))
    # the order of words counts: a template agrees by its three-word sequences
    threes = [(f, [sorted({" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))}) for ws in map(tokens, ts)]) for f, ts in model["templates"].items()]
    template = spark.createDataFrame(threes, "family string, templates array<array<string>>")
    judged = para.join(prob, ["rid", "p"]).join(F.broadcast(template), "family", "left").select("rid", "family", "probability", "templates", F.concat(grams(3), F.array(F.array_join("w", " "))).alias("g"))
    like = F.array_max(F.transform("templates", lambda t: F.size(F.array_intersect("g", t)) / F.size(t)))
    judged = judged.select("rid", "family", "probability", F.coalesce(like >= share, F.lit(False)).alias("confirmed"))
    by_doc = judged.groupBy("rid").agg(
        F.array_sort(F.collect_set("family")).alias("licenses"), F.count(F.lit(1)).alias("n_paragraphs"), F.max(F.struct("confirmed", "probability", "family")).alias("b")
    )
    return rows.select("id", "rid").join(by_doc, "rid", "left").select(
        "id", F.coalesce("licenses", F.array().cast("array<string>")).alias("licenses"), F.coalesce("n_paragraphs", F.lit(0)).alias("n_paragraphs"),
        F.col("b.family").alias("best"), F.round("b.probability", 6).alias("probability"), F.coalesce("b.confirmed", F.lit(False)).alias("confirmed"),
    )


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its licence families, as one string, with the best one's probability."""
    return scan(documents(spark, sf_dir).select("doc_id", "text")).select(
        F.col("id").alias("doc_id"), F.array_join("licenses", ",").alias("licenses"), "n_paragraphs", "best", "probability", "confirmed"
    )
