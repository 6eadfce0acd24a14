"""Licence scans: a trained paragraph classifier, in DataFrame functions only.

A paragraph is a line; a line of more than ``WINDOW`` words is classified in
windows that overlap by half, so that a statement counts as much in a long line
as in a short one, and the line's surest known window speaks for it.  Sparse word n-grams (one and two words) feed a
multinomial logistic regression over licence families and the class ``none``.
Its temperature is calibrated on held-out variants, and so is the probability
below which a paragraph counts as ``unknown``.  A prediction stands only if the
paragraph is close enough to one of the family's templates and has an n-gram
that no other family's templates have; otherwise it is ``unknown`` too: a licence statement of no known family.

``unknown`` is a trained class as well, of statements with invented names.

Training sees only the fixed templates, varied by a seeded generator, so it is
bounded and small.  The weights enter the plan as constants.  Scanning is one
pass over the documents without a shuffle, a join or Python; a cheap gate (one
of a few words) spares lines that cannot be licence statements.

Defined cases: null and empty texts have no findings.  Repeated rows are scanned
each.  Lines without a gate word are ``none``.
"""

from __future__ import annotations

import json
import re
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnql.llm import common

#: Hash buckets of n-grams.
BUCKETS = 2048
#: Least overlap of a paragraph's n-grams with a template's, in the smaller of the two.
LEAST_SIMILARITY = 0.6
VARIANTS = 24
#: Words of a window, and from one window's beginning to the next.
WINDOW, STEP = 48, 24
#: What the calibration keeps: the share of held-out licence variants above the unknown threshold.
KEEP = 0.98

# Short notices of common licence families.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "This software is distributed under the terms of the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "SPDX-License-Identifier: MIT",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "Licensed under the GPL version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License.",
        "Licensed under the LGPL version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1",
    ],
    "agpl": [
        "Licensed under the GNU Affero General Public License version 3.",
        "This service is released under the AGPL.",
        "SPDX-License-Identifier: AGPL-3.0",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the MPL 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "public-domain": [
        "This is free and unencumbered software released into the public domain.",
        "Dedicated to the public domain under CC0 1.0 Universal.",
        "No rights reserved; this work is in the public domain.",
    ],
    "all-rights-reserved": [
        "All rights reserved.",
        "Copyright 2020 by the authors. All rights reserved.",
        "No part of this publication may be reproduced without prior written permission of the publisher.",
    ],
}
# Sentences with the same words that state no licence.
NEGATIVES = [
    "She got her driving license last summer and drove to the coast.",
    "The restaurant lost its liquor license after the inspection.",
    "The public has rights that the version of the story left out.",
    "He asked for permission to leave the room before the end of the general meeting.",
    "Copyright law was the subject of the lecture in the second term.",
    "The bill of rights was signed by the members of the commons.",
    "The warranty covers the machine for two years after the purchase.",
    "Version two of the program was released under pressure from the public.",
    "Free software was on the agenda of the international foundation.",
    "The source of the river lies in the domain of the duke.",
    "Our work is done, and the terms of use of this house are simple.",
    "All of the seats were reserved for the guests of the library.",
]
# Licence statements of no known family; x stands for an invented name.
UNKNOWN_FORMS = [
    "Licensed under the x License.",
    "Licensed under the x x license, version 3.",
    "Released under the x License, Version 2.0.",
    "This work is licensed under the x x Public License.",
    "SPDX-License-Identifier: x",
    "Permission is granted to use this under the terms of the x license.",
    "This software is distributed under the x License version 1.",
]
# Words without which no line is a licence statement.
GATE = r"(?i)licen[sc]|copyright|rights|permi[st]|spdx|public domain|redistribut|[al]?gpl|creative commons|cc0|cc[ -]by"

NONE, UNKNOWN = "none", "unknown"


def grams(text: str) -> list[str]:
    """The distinct one- and two-word n-grams of a line; ``_grams`` is the same in SQL."""
    words = [w for w in re.split(r"[^a-z0-9]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), text)) if w]
    return list(dict.fromkeys([*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]))


def marks(name: str) -> list[str]:
    """The n-grams that only this family's templates have."""
    others = {g for other, texts in (*TEMPLATES.items(), (UNKNOWN, UNKNOWN_FORMS), (NONE, NEGATIVES)) if other != name for t in texts for g in grams(t)}
    return sorted({g for t in TEMPLATES.get(name, []) for g in grams(t)} - others)


def _windows(line: Column) -> Column:
    """The line's windows that have a gate word, as arrays of words."""
    lower = F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(lower, "[^a-z0-9]+"), lambda w: w != "")
    last = lambda ws: F.greatest(F.ceil((F.size(ws) - WINDOW) / STEP), F.lit(0)).cast("int")
    cut = lambda ws: F.when(F.size(ws) <= WINDOW, F.array(ws)).otherwise(F.transform(F.sequence(F.lit(0), last(ws)), lambda i: F.slice(ws, i * STEP + 1, WINDOW)))
    # one lambda's argument is computed once
    windows = F.flatten(F.transform(F.array(words), cut))
    return F.filter(windows, lambda ws: F.array_join(ws, " ").rlike(GATE))


def _grams(words: Column) -> Column:
    # neighbours: the array and itself moved on by one
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.concat(words, F.filter(pairs, lambda p: p.isNotNull())))


def _bucket(gram: str) -> int:
    return zlib.crc32(gram.encode()) % BUCKETS


def _variants(rng: np.random.Generator, text: str, n: int) -> list[str]:
    """The text with words left out, and with other words around it."""
    words, out = text.split(), [text]
    spare = " ".join(NEGATIVES).split()
    for _ in range(n - 1):
        kept = [w for w in words if rng.random() > 0.08] or words
        around = [spare[i] for i in rng.integers(len(spare), size=rng.integers(0, 5))]
        cut = int(rng.integers(len(around) + 1))
        out.append(" ".join([*around[:cut], *kept, *around[cut:]]))
    return out


def _matrix(texts: list[str]) -> np.ndarray:
    x = np.zeros((len(texts), BUCKETS))
    for row, text in zip(x, texts, strict=True):
        for g in grams(text):
            row[_bucket(g)] += 1
    return x


@lru_cache(maxsize=1)
def train() -> dict:
    """Weights, biases, temperature and unknown threshold."""
    names = [*TEMPLATES, UNKNOWN, NONE]
    rng = np.random.default_rng(7)
    invented = lambda m: "".join(chr(97 + c) for c in rng.integers(26, size=rng.integers(3, 9)))
    spare = " ".join(NEGATIVES).split()
    sets = []
    for _ in range(2):  # one to fit, one to calibrate
        texts, y = [], []
        for k, name in enumerate(names):
            for template in {UNKNOWN: UNKNOWN_FORMS, NONE: NEGATIVES}.get(name) or TEMPLATES[name]:
                own = _variants(rng, template, VARIANTS)
                if name == UNKNOWN:
                    own = [re.sub(r"\bx\b", invented, t) for t in own]
                texts += own
                y += [k] * len(own)
        for _ in range(300):
            texts.append(" ".join(spare[i] for i in rng.integers(len(spare), size=rng.integers(3, 30))))
            y.append(len(names) - 1)
        sets.append((_matrix(texts), np.array(y)))
    (x, y), (xc, yc) = sets
    gold = np.eye(len(names))[y]
    w, b = np.zeros((BUCKETS, len(names))), np.zeros(len(names))
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, 151):
        p = _softmax(x @ w + b)
        g = x.T @ (p - gold) / len(x) + 1e-4 * w
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        w -= 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        b -= 0.5 * (p - gold).mean(axis=0)
    scores = xc @ w + b
    loss = lambda t: -np.log(_softmax(scores / t)[np.arange(len(yc)), yc] + 1e-12).mean()
    temperature = min((0.5, 0.75, 1.0, 1.25, 1.5, 2.0, 3.0), key=loss)
    right = _softmax(scores / temperature)[np.arange(len(yc)), yc][yc < len(names) - 2]
    w[np.abs(w) < 0.02] = 0  # sparse
    return {"names": names, "weights": np.round(w, 4), "bias": np.round(b, 4), "temperature": temperature, "threshold": float(max(0.5, np.quantile(right, 1 - KEEP)))}


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _numbers(x: np.ndarray) -> Column:
    """A constant array; written as text, as the planner folds it into one literal."""
    return F.split(F.lit(",".join(f"{v:g}" for v in x.ravel())), ",").cast("array<double>")


def classify(line: Column, model: dict) -> Column:
    """struct(family, probability, similarity) of a line, from its surest window of a known family, or else of an unknown one."""
    names, k = model["names"], len(model["names"])
    weights, bias = _numbers(model["weights"]), _numbers(model["bias"])
    templates = F.from_json(F.lit(json.dumps([[grams(t) for t in TEMPLATES.get(name, [])] for name in names])), "array<array<array<string>>>")
    only = F.from_json(F.lit(json.dumps([marks(name) for name in names])), "array<array<string>>")

    def scored(own: Column) -> Column:
        at = F.transform(own, lambda g: F.pmod(F.crc32(g.cast("binary")), F.lit(BUCKETS)).cast("int"))
        sums = F.aggregate(at, bias, lambda acc, h: F.zip_with(acc, F.slice(weights, h * k + 1, k), lambda a, b: a + b))
        scaled = F.transform(sums, lambda s: s / F.lit(float(model["temperature"])))
        top = F.array_max(scaled)
        best = F.array_position(scaled, top).cast("int")
        probability = 1 / F.aggregate(scaled, F.lit(0.0), lambda acc, s: acc + F.exp(s - top))
        overlap = lambda t: F.size(F.array_intersect(own, t)) / F.greatest(F.least(F.size(own), F.size(t)), F.lit(1))
        similarity = F.coalesce(F.array_max(F.transform(F.element_at(templates, best), overlap)), F.lit(0.0))
        sure = (probability >= F.lit(model["threshold"])) & (similarity >= F.lit(LEAST_SIMILARITY)) & F.arrays_overlap(own, F.element_at(only, best))
        name = F.element_at(F.array(*map(F.lit, names)), best)
        family = F.when(name == NONE, NONE).when(sure, name).otherwise(UNKNOWN)
        rank = F.when(family == NONE, 0).when(family == UNKNOWN, 1).otherwise(2)
        return F.struct(rank.alias("rank"), F.round(probability, 6).alias("probability"), F.round(similarity, 6).alias("similarity"), family.alias("family"))

    # one lambda's argument is computed once, where a column would be computed wherever it is named
    best = F.array_max(F.transform(F.transform(_windows(line), _grams), scored))
    none = F.struct(F.lit(NONE).alias("family"), F.lit(1.0).alias("probability"), F.lit(0.0).alias("similarity"))
    pick = lambda b: F.when(b.isNull(), none).otherwise(F.struct(b["family"].alias("family"), b["probability"].alias("probability"), b["similarity"].alias("similarity")))
    return F.element_at(F.transform(F.array(best), pick), 1)


def scan(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """For each document: doc_id, and its licence paragraphs as ``findings``."""
    model = model or train()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.transform(F.split(text, "\n"), lambda line, i: F.struct(i.alias("paragraph"), line.alias("line"))), lambda x: x["line"].rlike(GATE))
    found = F.transform(lines, lambda x: F.struct(x["paragraph"].alias("paragraph"), classify(x["line"], model).alias("c")))
    flat = F.transform(found, lambda x: F.struct(x["paragraph"].alias("paragraph"), x["c"]["family"].alias("family"), x["c"]["probability"].alias("probability"), x["c"]["similarity"].alias("similarity")))
    kept = F.filter(flat, lambda x: x["family"] != NONE)
    empty = F.array().cast("array<struct<paragraph:int,family:string,probability:double,similarity:double>>")
    return docs.select("doc_id", F.when(text.rlike(GATE), kept).otherwise(empty).alias("findings"))


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(common.read(spark, sf_dir, "documents"))
    known = F.filter("findings", lambda x: x["family"] != UNKNOWN)
    return found.select(
        "doc_id",
        F.size("findings").cast("long").alias("n_paragraphs"),
        (F.size("findings") - F.size(known)).cast("long").alias("n_unknown"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(known, lambda x: x["family"]))), ",").alias("families"),
        F.array_max(F.transform(known, lambda x: x["probability"])).alias("probability"),
        F.array_max(F.transform(known, lambda x: x["similarity"])).alias("similarity"),
    )
