"""Licence scan by a trained paragraph classifier.

A paragraph is a line; a line of more than ``WINDOW`` words is read in windows of
that size, half overlapping. Its words and word pairs, as far as the training texts
use them, are the sparse features of a multinomial logistic regression over licence
families and the class ``unknown``. Training texts are made here by rule: phrases
with the families' names, the families' own sentences, the same with words left out
or between ordinary prose, and for ``unknown`` paragraphs of at most ``SAMPLE`` corpus
documents (smallest hash of their key) and phrases that name no family. A held-out
fifth sets the temperature that calibrates the probabilities. A prediction
counts if its probability reaches ``LEAST_PROBABILITY`` and a template of the family
confirms it: they share at least ``LEAST_OVERLAP`` of the smaller one's word pairs.

A paragraph without any pair of the vocabulary is unknown and not evaluated.
Defined results: null and empty texts have no paragraphs; repeated rows each get
their row; extra columns are ignored; the model depends on the sample's texts only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW = 60
SAMPLE, SAMPLE_PARAGRAPHS = 300, 2_000
LEAST_PROBABILITY, LEAST_OVERLAP = 0.6, 0.6
UNKNOWN = "unknown"

# Names and sentences of licences, fixed values.
NAMES = {
    "MIT": ("the MIT License", "MIT license", "the Expat License"),
    "Apache-2.0": ("the Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0"),
    "GPL": ("the GNU General Public License, version 3", "the GNU General Public License, version 2 or later", "GPLv3", "GPL-2.0-or-later", "the GNU GPL"),
    "LGPL": ("the GNU Lesser General Public License, version 2.1", "LGPL-3.0", "the GNU LGPL"),
    "AGPL": ("the GNU Affero General Public License, version 3", "AGPL-3.0", "the GNU AGPL"),
    "BSD": ("the BSD 3-Clause License", "the BSD 2-Clause License", "BSD-3-Clause", "the simplified BSD license"),
    "MPL-2.0": ("the Mozilla Public License, version 2.0", "MPL 2.0", "MPL-2.0"),
    "ISC": ("the ISC License", "ISC license"),
    "CC-BY": ("CC BY 4.0", "a Creative Commons Attribution 4.0 International License", "CC-BY-4.0"),
    "CC-BY-SA": ("CC BY-SA 4.0", "a Creative Commons Attribution-ShareAlike 4.0 License", "CC-BY-SA-3.0"),
    "CC-BY-NC": ("CC BY-NC 4.0", "a Creative Commons Attribution-NonCommercial 4.0 License", "CC BY-NC-SA 4.0"),
    "public-domain": ("CC0 1.0", "the Unlicense", "the CC0 public domain dedication"),
    "proprietary": ("a proprietary license", "a commercial license agreement", "a closed source license"),
}
SENTENCES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "Apache-2.0": "you may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org/licenses",
    "GPL": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "LGPL": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
    "AGPL": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "CC-BY": "You are free to share and adapt the material for any purpose, as long as you give appropriate credit",
    "CC-BY-SA": "if you remix the material you must distribute your contributions under the same license as the original",
    "CC-BY-NC": "You may not use the material for commercial purposes",
    "public-domain": "This is free and unencumbered software released into the public domain",
    "proprietary": "All rights reserved. No part of this publication may be reproduced without prior written permission",
}
PHRASES = (
    "Licensed under {}.",
    "Released under {}.",
    "This work is licensed under {}.",
    "This software is distributed under the terms of {}.",
    "This file is available under {}.",
    "Use of this source code is governed by {}.",
    "The code is published under {}; see the LICENSE file.",
    "SPDX-License-Identifier: {}",
)

_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
Features = tuple[str, ...]


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def pairs_of(words: list[str]) -> set[Features]:
    return set(zip(words, words[1:]))


def templates() -> list[tuple[str, str]]:
    """Family and text of every notice."""
    named = [(f, p.format(n)) for f, names in NAMES.items() for n in names for p in PHRASES]
    return named + list(SENTENCES.items())


def _training(prose: list[str], seed: int = 11) -> tuple[list[list[str]], list[str]]:
    """Words and class of every training text."""
    random = np.random.default_rng(seed)
    ordinary = [words_of(p)[:WINDOW] for p in prose]
    ordinary = [w for w in ordinary if w] or [["text"]]
    texts, classes = [], []

    def add(words: list[str], name: str) -> None:
        texts.append(words)
        classes.append(name)

    for family, text in templates():
        words = words_of(text)
        add(words, family)
        # Long sentences are rare among the templates; their parts make up for it.
        for _ in range(10 if text in SENTENCES.values() else len(words) > 8):
            at = int(random.integers(0, len(words) // 3 + 1))
            add(words[at : at + max(6, len(words) * 2 // 3)], family)
        around = ordinary[int(random.integers(len(ordinary)))]
        half = min(len(around), int(random.integers(1, 15)))
        add(around[:half] + words + around[half : 2 * half], family)
    for words in ordinary:
        add(words, UNKNOWN)
    for phrase in PHRASES:
        for _ in range(40):
            words = ordinary[int(random.integers(len(ordinary)))]
            at = int(random.integers(len(words)))
            name = " ".join(words[at : at + int(random.integers(1, 4))])
            add(words_of(phrase.format(name)), UNKNOWN)
            add(words_of(phrase.format("the " + name + " license")), UNKNOWN)
    return texts, classes


@dataclass
class Model:
    classes: list[str]
    number: dict[object, int]
    pairs: set[Features]
    weights: np.ndarray  # feature x class, the last row for the intercept
    temperature: float
    known: dict[str, list[set[Features]]]

    def features(self, words: list[str]) -> np.ndarray:
        """Numbers of the distinct known words and pairs."""
        number = self.number
        found = {number[w] for w in words if w in number}
        found.update(number[p] for p in zip(words, words[1:]) if p in number)
        return np.array(sorted(found), dtype="int64")

    def probabilities(self, words: list[list[str]]) -> np.ndarray:
        logits = np.stack([_logits(self.weights, self.features(w)) for w in words])
        return _softmax(logits / self.temperature)

    def overlap(self, family: str, words: list[str]) -> float:
        own = pairs_of(words)
        if not own:
            return 0.0
        return max(len(own & t) / min(len(own), len(t)) for t in self.known[family])


def _logits(weights: np.ndarray, features: np.ndarray) -> np.ndarray:
    if not len(features):
        return weights[-1]
    return weights[features].sum(axis=0) / np.sqrt(len(features)) + weights[-1]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(prose: list[str]) -> Model:
    """The classifier for the given ordinary paragraphs."""
    texts, names = _training(prose)
    classes = [*NAMES, UNKNOWN]
    vocabulary: dict[object, int] = {}
    for _, text in templates():
        words = words_of(text)
        for feature in [*words, *zip(words, words[1:])]:
            vocabulary.setdefault(feature, len(vocabulary))
    known: dict[str, list[set[Features]]] = {f: [] for f in NAMES}
    for family, text in templates():
        known[family].append(pairs_of(words_of(text)))
    model = Model(classes, vocabulary, {p for p in vocabulary if isinstance(p, tuple)}, np.zeros((len(vocabulary) + 1, len(classes))), 1.0, known)
    rows = [model.features(w) for w in texts]
    x = np.zeros((len(rows), len(vocabulary) + 1))
    for k, found in enumerate(rows):
        x[k, found] = 1 / np.sqrt(max(1, len(found)))
        x[k, -1] = 1
    y = np.eye(len(classes))[[classes.index(n) for n in names]]
    held = np.arange(len(rows)) % 5 == 4
    model.weights = _regression(x[~held], y[~held])
    logits = x[held] @ model.weights
    losses = {t: -np.log((_softmax(logits / t) * y[held]).sum(axis=1) + 1e-12).mean() for t in np.geomspace(0.1, 5, 40)}
    model.temperature = float(min(losses, key=losses.get))
    return model


def _regression(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, steps: int = 150, rate: float = 8.0) -> np.ndarray:
    """Multinomial logistic regression by gradient steps with momentum."""
    weights = np.zeros((x.shape[1], y.shape[1]))
    move = np.zeros_like(weights)
    for _ in range(steps):
        slope = x.T @ (y - _softmax(x @ weights)) / len(x) - ridge * weights
        move = 0.9 * move + rate * slope
        weights += move
    return weights


def train(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    """The model with ordinary prose from a bounded sample of ``docs``."""
    sample = docs.select(docs[key].alias("k"), docs[text].alias("t")).filter(F.length("t") > 0)
    # The keys are chosen first, so that only the chosen texts leave their tasks.
    keys = sample.select("k").orderBy(F.xxhash64("k"), "k").limit(SAMPLE).distinct()
    chosen = sample.join(F.broadcast(keys), "k")
    rows = chosen.orderBy(F.xxhash64("k"), "k", F.xxhash64("t")).limit(SAMPLE).collect()
    prose = [line for r in rows for line in r.t.split("\n") if line.strip()]
    clues = {frozenset(pairs_of(words_of(t))) for _, t in templates()}

    def notice(line: str) -> bool:
        own = pairs_of(words_of(line))
        return any(len(own & c) >= LEAST_OVERLAP * len(c) for c in clues)

    return fit([p for p in prose[:SAMPLE_PARAGRAPHS] if not notice(p)])


def paragraphs(text: str) -> Iterator[tuple[int, int, list[str]]]:
    """Begin, end (code points) and words of every paragraph or window."""
    begin = 0
    for line in text.split("\n"):
        if len(line) < 4 * WINDOW or line.count(" ") < WINDOW:
            yield begin, begin + len(line), words_of(line)
        else:
            # Lower case may change lengths, so places come from the line itself.
            places = [m.span() for m in _WORD.finditer(line)]
            words = [line[a:b].lower() for a, b in places]
            for at in range(0, max(1, len(words) - WINDOW // 2), WINDOW // 2):
                some = places[at : at + WINDOW]
                if some:
                    yield begin + some[0][0], begin + some[-1][1], words[at : at + WINDOW]
        begin += len(line) + 1


def _notices(text: str | None, model: Model) -> tuple[int, list[dict]]:
    count, candidates = 0, []
    for begin, end, words in paragraphs(text or ""):
        if words:
            count += 1
            if not model.pairs.isdisjoint(zip(words, words[1:])):
                candidates.append((begin, end, words))
    found = []
    for at in range(0, len(candidates), 4_096):
        some = candidates[at : at + 4_096]
        scores = model.probabilities([w for *_, w in some])
        for (begin, end, words), p in zip(some, scores):
            family = model.classes[int(p.argmax())]
            if family == UNKNOWN or p.max() < LEAST_PROBABILITY:
                continue
            overlap = model.overlap(family, words)
            if overlap >= LEAST_OVERLAP:
                found.append({"begin": begin, "end": end, "family": family, "probability": float(p.max()), "overlap": overlap})
    return count, found


def scan(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_paragraphs`` read and ``notices`` (place, family, probability, overlap), one row per document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.select(docs[key], docs[text])
    notice = T.StructType().add("begin", "long").add("end", "long").add("family", "string")
    notice = notice.add("probability", "double").add("overlap", "double")
    schema = T.StructType([docs.schema[key]]).add("n_paragraphs", "long").add("notices", T.ArrayType(notice))
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("family", pa.string()), ("probability", pa.float64()), ("overlap", pa.float64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_notices(t, shared.value) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array([c for c, _ in found], pa.int64()), pa.array([n for _, n in found], kind)],
                names=schema.names,
            )

    return docs.mapInArrow(work, schema)
