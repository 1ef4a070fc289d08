"""License scans: a trained paragraph classifier whose predictions are confirmed against templates.

Paragraphs (lines) are described by hashed word one- and two-grams; a sparse multinomial logistic regression names the
license family or "unknown". The unknown class is calibrated: a family counts only above the probability that no
ordinary paragraph of a held-back part of the sample reached. A prediction stands when the family's template agrees.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from phrasecast.llm.common import ship

BITS = 14
UNKNOWN = "unknown"
_WORD = re.compile(r"[^\W_]+")

#: How the notices of each family are commonly worded.
TEMPLATES = {
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "This project is distributed under the terms of the Apache License 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This software is available under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "SPDX-License-Identifier: MIT",
    ),
    "bsd": (
        "Licensed under the BSD License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "Released under the GPL version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "reserved": (
        "Copyright. All rights reserved.",
        "All rights reserved. No part of this publication may be reproduced without permission.",
    ),
}
FAMILIES = tuple(sorted(TEMPLATES))


def tokens(paragraph: str) -> list[str]:
    return _WORD.findall(paragraph.lower())


_FORMS = [(name, frozenset(tokens(t))) for name in FAMILIES for t in TEMPLATES[name]]
_VOCABULARY = frozenset().union(*(words for _, words in _FORMS))
#: Part of a template's words that a paragraph must hold.
MIN_OVERLAP = 0.75


def slots(words: list[str]) -> np.ndarray:
    grams = {*words, *(" ".join(p) for p in zip(words, words[1:], strict=False))}
    return np.array(sorted({xxhash.xxh3_64_intdigest(g) & ((1 << BITS) - 1) for g in grams}), dtype=np.int64)


def overlap(words: list[str], family: str) -> float:
    """Largest part of the words of one of the family's templates that the paragraph holds."""
    have = set(words)
    return max(len(form & have) / len(form) for name, form in _FORMS if name == family)


def could_be(words: list[str]) -> bool:
    """Whether enough words of some template are there for it to confirm a prediction; others need no score."""
    have = _VOCABULARY.intersection(words)
    return len(have) > 1 and any(len(form & have) >= MIN_OVERLAP * len(form) for _, form in _FORMS)


@dataclass(frozen=True)
class Classifier:
    weights: np.ndarray  # (slots + 1) x (families + unknown); the last row is the bias
    least: float

    def probabilities(self, found: np.ndarray) -> np.ndarray:
        z = self.weights[found].sum(axis=0) + self.weights[-1]
        e = np.exp(z - z.max())
        return e / e.sum()


def _variants(text: str, r: random.Random, ordinary: list[list[str]], n: int) -> Iterator[list[str]]:
    """A notice as it stands, and inside other words."""
    words = tokens(text)
    for _ in range(n):
        around = r.choice(ordinary) if ordinary else []
        cut = r.randint(0, min(len(around), 8))
        yield around[:cut] + words + (around[cut : cut + r.randint(0, 8)])


def fit(ordinary: list[list[str]], per_template: int = 20, epochs: int = 250, rate: float = 0.05, decay: float = 2e-3) -> Classifier:
    """Templates and their variants are the families, ordinary paragraphs are unknown; a third of them calibrates."""
    r = random.Random(7)
    held, used = ordinary[::3], [p for i, p in enumerate(ordinary) if i % 3]
    rows, label = [], []
    for k, name in enumerate(FAMILIES):
        for text in TEMPLATES[name]:
            for words in _variants(text, r, used, per_template):
                rows.append(slots(words))
                label.append(k)
    for words in used:
        rows.append(slots(words))
        label.append(len(FAMILIES))
    # single template words and pairs of them are no notice
    for _ in range(200):
        rows.append(slots(r.sample(sorted(_VOCABULARY), 2)))
        label.append(len(FAMILIES))
    y, k = np.array(label), len(FAMILIES) + 1
    flat = np.concatenate(rows)
    row = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    slot, flat = np.unique(flat, return_inverse=True)
    size = np.bincount(y, minlength=k).astype(float)
    share = (1 / np.maximum(size, 1))[y] / k
    w, b = np.zeros((len(slot), k)), np.zeros(k)
    m, v = np.zeros((len(slot) + 1, k)), np.zeros((len(slot) + 1, k))
    for t in range(1, epochs + 1):
        z = np.stack([np.bincount(row, weights=w[flat, j], minlength=len(rows)) for j in range(k)], axis=1) + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p *= share[:, None]
        g = np.stack([np.bincount(flat, weights=p[row, j], minlength=len(slot)) for j in range(k)], axis=1) + decay * w / len(slot)
        g = np.vstack([g, p.sum(axis=0)])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
        step = rate * np.sqrt(1 - 0.999**t) / (1 - 0.9**t) * m / (np.sqrt(v) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    weights = np.zeros(((1 << BITS) + 1, k))
    weights[slot], weights[-1] = w, b
    model = Classifier(weights, 0.5)
    top = max((float(model.probabilities(slots(p))[:-1].max()) for p in held), default=0.0)
    return Classifier(weights, min(max(0.5, top), 0.9))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 300, paragraphs: int = 3000) -> Classifier:
    """Fit on the templates and on ordinary paragraphs of at most ``sample_rows`` documents, those of smallest id hash.

    At most ``paragraphs`` paragraphs of up to 60 words are used; those that hold most of a template's words are no
    ordinary ones. Null texts teach nothing.
    """
    rows = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("i"), F.substring(text_col, 1, 4000).alias("t"))
    sample = rows.orderBy(F.xxhash64("i", "t"), "i", "t").limit(sample_rows).collect()
    lines = [tokens(x)[:60] for row in sample for x in row.t.split("\n")]
    ordinary = sorted(x for x in lines if x and not could_be(x))
    return fit(random.Random(11).sample(ordinary, min(len(ordinary), paragraphs)))


def scan(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Confirmed notices: ``doc_id, paragraph`` (0-based line), ``family, probability, overlap``.

    Every line of the whole text is looked at. Null and empty texts have none; repeated rows each give their notices;
    other columns are not read.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS rows, whatever the input
    kind = dict(docs.select(F.col(id_col).alias("i")).dtypes)["i"]
    names = ["doc_id", "paragraph", "family", "probability", "overlap"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for at, line in enumerate((text.as_py() or "").split("\n")):
                    words = tokens(line)
                    if not could_be(words):
                        continue
                    p = m.probabilities(slots(words))
                    best = int(np.argmax(p[:-1]))
                    agrees = overlap(words, FAMILIES[best])
                    if p[best] > m.least and p[best] > p[-1] and agrees >= MIN_OVERLAP:
                        out.append((doc, at, FAMILIES[best], float(p[best]), agrees))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = [batch.schema.field(0).type, pa.int32(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, paragraph int, family string, probability double, overlap double")


def report(docs: DataFrame) -> DataFrame:
    """Train on the table and scan all of it."""
    return scan(docs, train(docs))
