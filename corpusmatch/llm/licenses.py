"""Licence scans: a trained paragraph classifier over word n-grams, confirmed by comparison with templates.

A softmax regression on binary unigrams and bigrams is fitted in numpy on variants of the templates and on text that
only sounds like a licence (the unknown class), and its probabilities are calibrated by a temperature. Scanning uses
DataFrame functions alone: weights and templates are constants of the plan, every document is judged within its own
row, and nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache, reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "unknown"
#: Notices by licence family.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "Released under MIT.",
        "This project is licensed under the MIT License, see the LICENSE file for details.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "SPDX-License-Identifier: MIT",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Distributed under the terms of Apache 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "BSD": (
        "Released under the BSD License.",
        "This software is distributed under the 3-clause BSD license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "Distributed under the terms of the GNU GPL version 2.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "LGPL": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "Licensed under the LGPL version 3.",
    ),
    "AGPL": ("Licensed under the GNU Affero General Public License, version 3.", "Released under the AGPL license."),
    "MPL": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "public-domain": (
        "This work is dedicated to the public domain under CC0 1.0 Universal license.",
        "This is free and unencumbered software released into the public domain under the Unlicense.",
    ),
    "all-rights-reserved": (
        "All rights reserved.",
        "Alle Rechte vorbehalten.",
        "Tous droits réservés.",
        "Todos los derechos reservados.",
        "Copyright 2020 Example Company. All rights reserved.",
        "No part of this publication may be reproduced without the prior written permission of the copyright holder.",
    ),
}
#: Sentences with the words of licences that aren't any.
OTHERS = (
    "His driving license expired in May and the office would not renew it.",
    "The license plate was found near the river.",
    "She asked for permission to enter the building.",
    "The restaurant lost its license to serve wine.",
    "Copyright law has been debated in parliament for years.",
    "The warranty of the car covers two years.",
    "A fishing license is required in this area.",
    "The teacher gave permission to use the general library.",
    "Their version of the story was published in public.",
    "Free software is a matter of liberty, the author said.",
    "The club reserved all seats in the first row.",
    "Civil rights reserved a place in his speeches.",
    "The license fee rose by ten percent under the new terms.",
    "You may not park here without a license from the city.",
    "The museum shows work from the public domain and from private collections.",
)
#: What every template has at least one of, without regard to case, and names of families in capitals. A unit
#: without any has no word that could confirm a family, so the classifier isn't asked; they keep the scan cheap.
STEMS = (
    "licen", "copyright", "rights reserved", "rechte vorbehalten", "droits réservés", "derechos reservados", "public domain", "permission", "redistribut",
    "gpl", "creative commons", "cc by", "cc0", "apache", "mozilla", "affero", "spdx", "reproduced",
)
NAMES = r"\b(?:MIT|BSD|MPL|GNU)\b"
#: A line end within a sentence is a blank; a sentence ends at its mark or at a line end after one, but not after a single letter.
_WRAPPED = r"(?<=[^\n.!?;:])[ \t]*\n(?=[^\n])"
_UNITS = r"\n+|(?<=[.!?;])(?<!\b[A-Za-z]\.)[ \t]+"
_NOT_WORDS = r"[^\p{L}\p{N}.]+|\.(?!\p{N})"


@dataclass(frozen=True)
class Model:
    classes: tuple[str, ...]  # the last is unknown
    features: tuple[str, ...]
    weights: np.ndarray  # (features, classes)
    bias: np.ndarray
    temperature: float
    least_probability: float = 0.6
    least_overlap: float = 0.6


def words_of(text: str) -> list[str]:
    """Twin of the scan's splitting: lower-case runs of letters, digits and inner points of numbers."""
    import regex

    return [w for w in regex.split(_NOT_WORDS, text.lower()) if w]


def _features(words: list[str]) -> set[str]:
    return {*words, *map(" ".join, zip(words, words[1:]))}


@cache
def train(seed: int = 11, variants: int = 60, rounds: int = 400, rate: float = 2.0, decay: float = 2e-4) -> Model:
    """Fit on variants of the templates (words lost, other words around, parts).

    The temperature comes from a fit without the last template of each family that has three or more, and without a
    quarter of the other text, on the variants of just these: wordings that fit never saw. The weights are then fitted on all.
    """
    rng = np.random.default_rng(seed)
    classes = (*TEMPLATES, UNKNOWN)
    vocabulary = sorted(set().union(*(_features(words_of(t)) for ts in TEMPLATES.values() for t in ts)))
    place = {f: k for k, f in enumerate(vocabulary)}
    pool = sorted({w for t in OTHERS for w in words_of(t)})
    terms = sorted({w for ts in TEMPLATES.values() for t in ts for w in words_of(t)})
    rows, labels, out = [], [], []

    def add(words: list[str], label: int, held: bool) -> None:
        rows.append([place[f] for f in _features(words) if f in place])
        labels.append(label)
        out.append(held)

    for label, family in enumerate(TEMPLATES):
        for text in TEMPLATES[family]:
            own = words_of(text)
            apart = len(TEMPLATES[family]) > 2 and text == TEMPLATES[family][-1]
            add(own, label, apart)
            for _ in range(variants // len(TEMPLATES[family])):
                kept = [w for w in own if rng.random() > 0.08]
                extra = [pool[k] for k in rng.integers(len(pool), size=rng.integers(0, 6))]
                add(extra + kept if rng.random() < 0.5 else kept + extra, label, apart)
    for k, text in enumerate(OTHERS):
        add(words_of(text), len(TEMPLATES), k % 4 == 0)
    for turn in range(variants * 6):
        some = [terms[k] for k in rng.integers(len(terms), size=rng.integers(1, 5))]
        rest = [pool[k] for k in rng.integers(len(pool), size=rng.integers(2, 12))]
        mixed = some + rest
        add([mixed[k] for k in rng.permutation(len(mixed))], len(TEMPLATES), turn % 4 == 0)
    x = np.zeros((len(rows), len(vocabulary)))
    for k, r in enumerate(rows):
        x[k, r] = 1
    y = np.array(labels)
    held = np.array(out)
    target = np.eye(len(classes))[y]

    def softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def descend(x: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w, b = np.zeros((len(vocabulary), len(classes))), np.zeros(len(classes))
        for _ in range(rounds):
            g = (softmax(x @ w + b) - target) / len(x)
            w -= rate * (x.T @ g + decay * w)
            b -= rate * g.sum(0)
        return w, b

    w, b = descend(x[~held], target[~held])
    scores = x[held] @ w + b
    grid = np.geomspace(0.2, 5, 40)
    loss = [-np.log(softmax(scores / t)[np.arange(held.sum()), y[held]] + 1e-12).mean() for t in grid]
    w, b = descend(x, target)
    return Model(classes, tuple(vocabulary), np.round(w, 6), np.round(b, 6), float(grid[int(np.argmin(loss))]))


def _strings(values) -> Column:
    return F.array(*map(F.lit, values))


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, n_units (sentences of paragraphs, wrapped lines joined, with a licence word), n_notices, n_unknown, families, notices.

    Whole texts are looked at. A unit is a notice if a family's calibrated probability reaches the limit and the
    words of one of its templates confirm it; other units are unknown. families: distinct, sorted, joined by commas,
    empty if there are none. notices: the units with family, probability and overlap. A null or empty text has no
    units; repeated rows each give a row; other columns are ignored; an empty table gives no rows.
    """
    model = model or train()
    numbers = lambda row: F.array(*(F.lit(float(v)) for v in row))
    weights = F.map_from_arrays(_strings(model.features), F.array(*map(numbers, model.weights)))
    sets = F.array(*(F.array(*(_strings(sorted(set(words_of(t)))) for t in TEMPLATES[c])) for c in model.classes[:-1]))
    zero = numbers(np.zeros(len(model.classes)))

    def judge(unit: Column) -> Column:
        words = F.filter(F.split(F.lower(unit), _NOT_WORDS), lambda w: w != "")
        pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
        found = F.array_distinct(F.array_compact(F.concat(words, pairs)))
        known = F.filter(found, lambda f: F.map_contains_key(weights, f))
        scores = F.aggregate(
            known, numbers(model.bias), lambda s, f: F.zip_with(s, F.coalesce(F.try_element_at(weights, f), zero), lambda a, b: a + b)
        )
        return F.struct(unit.alias("unit"), F.array_distinct(words).alias("words"), scores.alias("scores"))

    def decide(u: Column) -> Column:
        top = F.array_max(u["scores"])
        shares = F.transform(u["scores"], lambda s: F.exp((s - top) / model.temperature))
        probability = 1 / F.aggregate(shares, F.lit(0.0), lambda a, s: a + s)
        best = F.array_position(u["scores"], top).cast("int")
        templates = F.try_element_at(sets, best)
        overlap = F.array_max(
            F.transform(templates, lambda t: F.size(F.array_intersect(t, u["words"])) / F.least(F.size(t), F.size(u["words"])))
        )
        sure = (best <= len(TEMPLATES)) & (probability >= model.least_probability) & (overlap >= model.least_overlap)
        family = F.when(sure, F.element_at(_strings(model.classes), best)).otherwise(UNKNOWN)
        return F.struct(u["unit"].alias("unit"), family.alias("family"), F.round(probability, 6).alias("probability"), F.round(F.coalesce(overlap, F.lit(0.0)), 6).alias("overlap"))

    def gate(c: Column) -> Column:
        low = F.lower(c)
        return reduce(lambda a, b: a | b, (F.contains(low, F.lit(x)) for x in STEMS)) | F.rlike(c, F.lit(NAMES))

    units = F.filter(F.split(F.regexp_replace("text", _WRAPPED, " "), _UNITS), gate)
    none = F.expr("cast(array() as array<struct<unit:string,family:string,probability:double,overlap:double>>)")
    judged = docs.select("doc_id", F.when(gate(F.translate("text", "\n", " ")), F.transform(F.transform(units, judge), decide)).alias("units"))
    judged = judged.withColumn("units", F.coalesce("units", none))
    notices = F.filter("units", lambda u: u["family"] != UNKNOWN)
    return judged.select(
        "doc_id",
        F.size("units").cast("long").alias("n_units"),
        F.size(notices).cast("long").alias("n_notices"),
        (F.size("units") - F.size(notices)).cast("long").alias("n_unknown"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(notices, lambda u: u["family"]))), ",").alias("families"),
        notices.alias("notices"),
    )
