"""Licence scan: a trained paragraph classifier with a template check, in DataFrame functions only.

A sparse multinomial logistic regression over word uni- and bigrams is fitted on perturbed template notices and on an
unknown class; its temperature is calibrated on perturbations it has not seen. Every paragraph is cut into n-grams that
are joined to the weight table (its size is that of the templates' vocabulary), summed, and turned into calibrated
probabilities. Bigrams of templates are marked in bit sets on the way, so that a family is reported only if the
paragraph also resembles one of that family's templates; everything else is unknown.
"""

from __future__ import annotations

import functools
import json
import random
import re

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Notices by which the families are told.
TEMPLATES = {
    "agpl": ["Licensed under the GNU Affero General Public License, version 3", "You can redistribute it and modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "Licensed under the AGPL v3", "Licensed under AGPLv3", "AGPL-3.0", "AGPLv3", "SPDX-License-Identifier: AGPL-3.0-only"],
    "apache": ["Licensed under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied", "This project is released under the Apache 2.0 license", "Apache-2.0", "Apache License 2.0", "SPDX-License-Identifier: Apache-2.0"],
    "bsd": ["Released under the BSD License", "Licensed under the BSD 3-Clause License", "BSD-3-Clause", "BSD-2-Clause", "SPDX-License-Identifier: BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "cc-by": ["Licensed under CC BY 4.0", "CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", "https://creativecommons.org/licenses/by/4.0/"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "Available under CC-BY-NC 4.0", "CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License", "https://creativecommons.org/licenses/by-nc/4.0/"],
    "cc-by-nc-sa": ["Licensed under CC BY-NC-SA 4.0", "CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution NonCommercial ShareAlike 4.0 International License"],
    "cc-by-nd": ["Licensed under CC BY-ND 4.0", "CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution NoDerivatives 4.0 International License"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License", "https://creativecommons.org/licenses/by-sa/4.0/"],
    "cc0": ["Released under CC0 1.0", "CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal"],
    "epl": ["Licensed under the Eclipse Public License 2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License", "EPL-2.0"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3", "This program is free software: you can redistribute it and modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or at your option any later version", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details", "Licensed under the GPL v3", "Distributed under the terms of the GNU GPL, version 3", "Licensed under GPLv3", "Released under the GPL", "GPL-3.0", "GPL-2.0", "GPLv3", "GPLv2", "SPDX-License-Identifier: GPL-3.0-only"],
    "isc": ["Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "Released under the ISC License"],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version 2.1", "You can redistribute it and modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "Licensed under the LGPL v3", "LGPL-2.1", "LGPLv3", "SPDX-License-Identifier: LGPL-3.0-only"],
    "mit": ["Released under the MIT License", "Licensed under the MIT License", "Released under MIT", "Licensed under MIT", "MIT License", "The MIT License (MIT)", "SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and sell copies of the Software", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/", "Licensed under the Mozilla Public License 2.0", "Licensed under MPL 2.0", "MPL-2.0", "SPDX-License-Identifier: MPL-2.0"],
    "proprietary": ["Copyright. All rights reserved", "All rights reserved", "Unauthorized copying of this file is strictly prohibited, proprietary and confidential"],
    "unlicense": ["This is free and unencumbered software released into the public domain", "Released under the Unlicense"],
}
#: A paragraph with one of these terms (lower case) has a row even if no licence is seen in it.
KEY_TERMS = ["licen", "copyright", "permission is hereby", "redistribut", "public domain", "creative commons", "cc by", "cc0", "rights reserved", "proprietary"]
#: Ordinary sentences, many of them with words of licences, for the unknown class.
UNKNOWN = ["the driver lost his licence after the accident in the city", "a fishing license is required on the lake in spring", "a fishing license is sold at the harbour", "copyright law was discussed in parliament for the first time", "permission is hereby requested to enter the garden", "the grain was redistributed among the villages", "the letters are old and the paintings are in the public domain of memory", "licensed professionals repaired the roof of the school", "she has a proprietary interest in the outcome of the vote", "the general of the army and the public were not informed of the version", "the end of the day and the work of the night", "the terms of the contract are under review by the library", "all of the rights of the people are reserved for later", "it was released into the wild under the bridge", "the mit campus is in the state of massachusetts", "the software of the project was published in the open", "the apache were a people of the plains", "the above is a copy of this list without any warranty for the reader", "er kam mit der bahn und mit dem rad in die stadt", "sie ist mit ihm im haus und nicht in der schule", "das ist die version von mir mit allen", "le travail de la ville et les droits de la maison sont dans le livre", "la casa de la ciudad y los derechos de las personas", "version 2 0 of the plan was not used in 2020", "the copyright holder spoke of the conditions in the north", "use of this road is permitted in summer only", "you can use it for any purpose you like", "the foundation was published as a book by the free press", "mozilla is a company and the eclipse was seen by all", "license", "licensed", "copyright", "see the license plate", "the commons are open to the public"]
UNKNOWN_CLASS = "unknown"
#: Least probability, and least share of the template's or paragraph's bigrams in common, for a family to be reported.
MIN_PROBABILITY, MIN_RESEMBLANCE = 0.5, 0.6
#: Copies of each notice (one as it is, the others perturbed) to fit on, and fresh ones to calibrate on.
COPIES, FRESH = 24, 6
#: Weights are whole numbers of 1/UNIT.
UNIT = 10_000
_WORD = r"[\p{L}\p{N}]+"
#: Between the lines of one paragraph.
_WRAP = "\x01"


def words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def bigrams(w: list[str]) -> list[str]:
    """Neighbouring words, the first after a start and the last before an end."""
    return [f"{a} {b}" for a, b in zip(["^", *w], [*w, "$"], strict=True)]


def _perturbed(rng: random.Random, n: int) -> list[tuple[str, list[str]]]:
    """Notices with words dropped, cut at either end, broken as wrapped lines are, or put among filler words."""
    filler = [w for s in UNKNOWN for w in words(s)]
    out = []
    for family, sentences in TEMPLATES.items():
        for s in sentences:
            for k in range(n):
                w = words(s)
                if k:
                    if len(w) > 12 and k % 2:
                        at = rng.randrange(len(w) - 8)
                        w = w[at : at + rng.randrange(6, 15)]
                    if len(w) > 4:
                        w = [x for x in w if rng.random() > 0.08] or w
                    w = rng.choices(filler, k=rng.choice([0, 0, 0, 1, 3, 8])) + w + rng.choices(filler, k=rng.choice([0, 0, 0, 1, 3, 8, 15]))
                out.append((family, w))
    shared = [w for s in TEMPLATES.values() for x in s for w in words(x) if not any(w in f.lower() for f in ("gpl lgpl agpl mpl epl gnu bsd cc0 spdx gplv3 gplv2 lgplv3 agplv3 agplv apache mozilla creativecommons unlicense creative noncommercial sharealike noderivatives affero isc".split()))]
    out += [(UNKNOWN_CLASS, words(s)) for s in UNKNOWN for _ in range(n)]
    for k in range(n * 40):
        out.append((UNKNOWN_CLASS, rng.choices(filler + (shared if k % 3 == 0 else []), k=rng.choice([1, 2, 4, 8, 12, 20, 40]))))
    return out


@functools.lru_cache(maxsize=1)
def model() -> tuple[list[str], dict[str, list[float]], list[float]]:
    """(classes, weights of each n-gram, intercepts), divided by the calibrated temperature."""
    rng = random.Random(5)
    rows, fresh = _perturbed(rng, COPIES), _perturbed(rng, FRESH)
    classes = sorted(TEMPLATES) + [UNKNOWN_CLASS]
    features = lambda w: {*w, *bigrams(w)}
    vocabulary = {g: i for i, g in enumerate(sorted({g for s in [*TEMPLATES.values(), UNKNOWN] for x in s for g in features(words(x))}))}

    def matrix(data):
        x, y = np.zeros((len(data), len(vocabulary)), np.float32), np.zeros(len(data), int)
        for r, (c, w) in enumerate(data):
            y[r] = classes.index(c)
            x[r, [vocabulary[g] for g in features(w) if g in vocabulary]] = 1
        return x, y

    x, y = matrix(rows)
    onehot = np.eye(len(classes), dtype=np.float32)[y]
    w, b = np.zeros((x.shape[1], len(classes)), np.float32), np.zeros(len(classes), np.float32)
    gw, gb = np.full(w.shape, 1e-8, np.float32), np.full(b.shape, 1e-8, np.float32)

    def soft(z):
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    for _ in range(200):
        g = (soft(x @ w + b) - onehot) / len(x)
        dw, db = x.T @ g + 1e-5 * w, g.sum(0)
        gw += dw * dw
        gb += db * db
        w -= 0.2 * dw / np.sqrt(gw)
        b -= 0.2 * db / np.sqrt(gb)
    x, truth = matrix(fresh)
    z = (x @ w + b).astype(float)
    loss = lambda t: -np.log(soft(z / t)[np.arange(len(truth)), truth] + 1e-12).mean()
    heat = min((0.5 + 0.1 * i for i in range(30)), key=loss)
    return classes, {g: (w[i].astype(float) / heat).round(4).tolist() for g, i in vocabulary.items()}, (b.astype(float) / heat).round(4).tolist()


@functools.lru_cache(maxsize=1)
def marks() -> tuple[dict[str, int], list[tuple[str, set[str]]]]:
    """(number of each bigram of a template, family and bigrams of each template)."""
    templates = [(family, set(bigrams(words(s)))) for family, sentences in TEMPLATES.items() for s in sentences]
    return {g: i for i, g in enumerate(sorted(set().union(*(two for _, two in templates))))}, templates


def _table(spark, rows: list[dict], schema: str) -> DataFrame:
    """A small table from one literal, without leaving the JVM."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _packed(v: list[float], number: int | None, sets: int) -> dict[str, int]:
    """The weights of an n-gram in whole units, two in a long, and its bit in the sets. Sums of them are exact in any order;
    as each n-gram counts once in a paragraph, 32 bits hold them."""
    w = [round(x * UNIT) for x in v] + [0]
    return {f"p{i}": (w[2 * i + 1] << 32) + w[2 * i] for i in range(len(v) + 1 >> 1)} | {f"b{k}": _signed(1 << number % 64) if number is not None and number // 64 == k else 0 for k in range(sets)}


def _templates(spark, sets: int) -> DataFrame:
    """family, size, m0, m1, …: how many bigrams each template has, and their bits."""
    number, templates = marks()
    rows = []
    for family, two in templates:
        whole = sum(1 << number[g] for g in two)
        rows.append({"family": family, "size": len(two)} | {f"m{k}": _signed(whole >> 64 * k & (1 << 64) - 1) for k in range(sets)})
    return _table(spark, rows, ", ".join(f"{c} {'string' if c == 'family' else 'long'}" for c in rows[0]))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph (from 0), line (from 0 in it; null: all of it), n_words, family, probability, resemblance.

    A paragraph is a line with the lines it is wrapped onto: a line without a closing .!?:; goes on in the next one that
    is not blank. Every line is scored, and every paragraph of several lines as a whole. There is a row for each that
    the model gives to a family with the least probability and that shares a word pair with a template of that family,
    or that has a key term; a whole paragraph only if none of its lines has a family. family is ``unknown`` where no
    family reaches the least probability and resemblance. Null and empty texts have no paragraphs, very long ones are
    read whole; each row is scanned, so repeated rows have repeated results. Further columns are not looked at.
    """
    spark = docs.sparkSession
    classes, weights, intercepts = model()
    number, _ = marks()
    sets = -(-len(number) // 64)
    wrapped = F.regexp_replace("text", r"(?<![.!?:;\s])[ \t\r]*\n(?=\S)", _WRAP)
    blocks = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.posexplode(F.split(wrapped, "\n")).alias("paragraph", "block"))
    lines = F.split("block", _WRAP)
    units = blocks.select("rid", "doc_id", "paragraph", F.size(lines).alias("of"), F.posexplode(F.when(F.size(lines) > 1, F.concat(lines, F.array(F.translate("block", _WRAP, " ")))).otherwise(lines)).alias("line", "unit"))
    low = F.lower("unit")
    term = functools.reduce(lambda a, b: a | b, [low.contains(t) for t in KEY_TERMS])
    found = units.select("rid", "doc_id", "paragraph", "of", "line", term.alias("term"), F.regexp_extract_all(low, F.lit(_WORD), F.lit(0)).alias("w"))
    two = F.zip_with(F.concat(F.array(F.lit("^")), "w"), F.concat("w", F.array(F.lit("$"))), lambda a, b: F.concat_ws(" ", a, b))
    # vocabulary of the templates: a proven bound; the empty gram gives every paragraph a row
    rows = [{"g": g, **_packed(v, number.get(g), sets)} for g, v in {"": [0.0] * len(classes), **weights}.items()]
    table = F.broadcast(_table(spark, rows, ", ".join(f"{c} {'string' if c == 'g' else 'long'}" for c in rows[0])))
    keys = ["rid", "doc_id", "paragraph", "of", "line", "term", "n_words"]
    grams = found.select("rid", "doc_id", "paragraph", "of", "line", "term", F.size("w").alias("n_words"), F.explode(F.concat(F.array(F.lit("")), F.array_distinct("w"), F.array_distinct(two))).alias("g")).join(table, "g")
    packs = -(-len(classes) // 2)
    sums = grams.groupBy(*keys).agg(*[F.sum(f"p{i}").alias(f"p{i}") for i in range(packs)], *[F.bit_or(f"b{k}").alias(f"b{k}") for k in range(sets)])
    lower = [((F.col(f"p{i}") + 2**31).bitwiseAND(F.lit(2**32 - 1))) - 2**31 for i in range(packs)]
    points = [x for i in range(packs) for x in (lower[i], F.call_function("shiftright", F.col(f"p{i}") - lower[i], F.lit(32)))][: len(classes)]
    sums = sums.select(*keys, *[f"b{k}" for k in range(sets)], *[(p / UNIT).alias(f"z{i}") for i, p in enumerate(points)])
    z = F.array(*[F.struct((F.col(f"z{i}") + F.lit(intercepts[i])).alias("z"), F.lit(c).alias("c")) for i, c in enumerate(classes)])
    marked = [f"b{k}" for k in range(sets)]
    scored = sums.select(*keys, *marked, z.alias("z")).select("*", F.array_max("z").alias("top"))
    share = F.aggregate("z", F.lit(0.0), lambda a, x: a + F.exp(x["z"] - F.col("top")["z"]))
    scored = scored.select(*keys, *marked, F.col("top")["c"].alias("c"), F.round(1 / share, 6).alias("probability"))
    likely = (F.col("c") != UNKNOWN_CLASS) & (F.col("probability") >= MIN_PROBABILITY)
    common = functools.reduce(lambda a, b: a + b, [F.bit_count(F.col(f"b{k}").bitwiseAND(F.col(f"m{k}"))) for k in range(sets)])
    like = common / F.greatest(F.least(F.col("n_words") + 1, F.col("size")), F.lit(1))
    met = scored.filter(F.col("term") | likely).join(F.broadcast(_templates(spark, sets)), F.col("c") == F.col("family"), "left")
    out = met.groupBy(*keys, "c", "probability").agg(F.round(F.coalesce(F.max(like), F.lit(0.0)), 6).alias("resemblance"))
    sure = likely & (F.col("resemblance") >= MIN_RESEMBLANCE)
    out = out.filter(F.col("term") | (F.col("resemblance") > 0)).withColumn("family", F.when(sure, F.col("c")).otherwise(UNKNOWN_CLASS))
    told = F.max((F.col("family") != UNKNOWN_CLASS) & (F.col("line") < F.col("of"))).over(Window.partitionBy("rid", "paragraph"))
    whole = F.col("line") == F.col("of")
    out = out.withColumn("told", told).filter(~whole | ~F.col("told") & (F.col("family") != UNKNOWN_CLASS))
    return out.select("doc_id", "paragraph", F.when(~whole, F.col("line")).alias("line"), "n_words", "family", "probability", "resemblance")
