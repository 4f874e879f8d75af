"""License scans: a trained paragraph classifier names licence families, template comparison confirms them.

Features are word uni-, bi- and trigrams of a paragraph, only those that the trained model knows. A multinomial
logistic regression tells families apart, with a class for everything else that is trained on negative phrases and on
windows of the corpus (a bounded sample). Its probabilities are calibrated by a temperature on texts that had no part in
training: in turn, some templates of each family and some negative phrases are left out. So are whole families, which should then
be unknown; the model reports how it did on either. A prediction counts if its probability reaches ``threshold`` and the paragraph
holds enough of the word pairs of one of the family's templates. Paragraphs end at blank lines; they and their lines are looked
at, long ones in overlapping windows around words that licences use.

Defined results: null and empty texts have no licences; texts of any length are scanned whole; of overlapping windows of one
family as many as fit side by side count, then the most probable, then the shortest; rows with equal ids are scanned each on its
own; other columns are ignored whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import returns_memory, text_batches
from .quality import fit_temperature

UNKNOWN = "unknown"

# Short public notices of each family, as they stand in files and pages.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Apache License Version 2.0, January 2004",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, without warranties or conditions of any kind",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "bsd": (
        "Licensed under the BSD 3-Clause License.",
        "Released under the BSD license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike License.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC-SA 4.0.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License version 2 or later.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "This program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "lgpl": (
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.",
        "SPDX-License-Identifier: MIT",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License Version 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at mozilla.org/MPL/2.0/.",
    ),
    "proprietary": (
        "All rights reserved.",
        "Copyright 2020. All rights reserved.",
        "No part of this publication may be reproduced without the prior written permission of the publisher.",
    ),
    "public-domain": (
        "This work is dedicated to the public domain.",
        "CC0 1.0 Universal Public Domain Dedication",
        "Released into the public domain.",
    ),
}

#: Phrases with licence words that license nothing.
NEGATIVES = (
    "he lost his driving license last year",
    "the licensed driver was under the influence",
    "a table reserved for all the guests",
    "human rights and civil rights for all",
    "the version of the story released last week",
    "the general public was not admitted",
    "under the terms of the peace treaty",
    "the apache helicopter landed at dawn",
    "she studied at mit and worked on software",
    "copyright law is a matter of debate",
    "the commons debated the bill in public",
    "permission was granted to enter the building free of charge",
    "this work is hard and the conditions are met",
    "a mozilla release party in the public park",
    "the license fee for television rose again",
)

_WORD = re.compile(r"[^\W_]+")
_BLANK = re.compile(r"\n(?:[^\S\n]*\n)+")
WINDOW_WORDS, STEP_WORDS = 40, 20


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams(tokens: list[str]) -> list[str]:
    return [*tokens, *map(" ".join, zip(tokens, tokens[1:], strict=False)), *map(" ".join, zip(tokens, tokens[1:], tokens[2:], strict=False))]


def _apart(spans: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """The largest choice of (start, end, probability) without overlaps; of equally many, the most probable and shortest."""
    spans = sorted(spans, key=lambda x: (x[1], x[0]))
    ends = [x[1] for x in spans]
    best: list[tuple[int, float, int]] = [(0, 0.0, 0)]
    taken: list[int] = []  # where the choice before this span ends, or -1 if the span is left out
    for i, (a, b, p) in enumerate(spans):
        before = bisect_right(ends, a, 0, i)
        n, total, less = best[before]
        with_it = (n + 1, round(total + p, 9), less - (b - a))
        taken.append(before if with_it > best[i] else -1)
        best.append(max(with_it, best[i]))
    out, i = [], len(spans)
    while i:
        if taken[i - 1] < 0:
            i -= 1
        else:
            out.append(spans[i - 1])
            i = taken[i - 1]
    return out[::-1]


@dataclass
class LicenseModel:
    classes: list[str]
    features: dict[str, int]
    weights: np.ndarray  # features by classes
    bias: np.ndarray
    temperature: float
    telling: frozenset[str]  # single words that some family weighs
    pairs: dict[str, list[frozenset[str]]]  # word pairs of the templates
    report: dict[str, float]  # how the calibration went on texts that had no part in training

    def probabilities(self, tokens: list[str]) -> np.ndarray:
        at = sorted({self.features[g] for g in grams(tokens) if g in self.features})
        z = (self.bias + self.weights[at].sum(0) / max(1.0, len(at)) ** 0.5) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()

    def confirm(self, family: str, tokens: list[str], share: float) -> bool:
        own = set(map(" ".join, zip(tokens, tokens[1:], strict=False)))
        return any(len(own & t) >= share * len(t) for t in self.pairs[family])

    @cached_property
    def all_pairs(self) -> frozenset[str]:
        return frozenset().union(*(t for texts in self.pairs.values() for t in texts))

    def classify(self, tokens: list[str], threshold: float, share: float) -> tuple[str, float] | None:
        if not any(self.confirm(f, tokens, share) for f in self.pairs):
            return None
        p = self.probabilities(tokens)
        best = int(p.argmax())
        family = self.classes[best]
        return (family, float(p[best])) if family != UNKNOWN and p[best] >= threshold and self.confirm(family, tokens, share) else None

    def scan(self, text: str | None, threshold: float, share: float) -> list[tuple[int, int, str, float]]:
        """(start, end, family, probability) of the paragraphs or windows that license something, code points."""
        out: list[tuple[int, int, str, float]] = []
        text, at = text or "", 0
        for end, after in [*((m.start(), m.end()) for m in _BLANK.finditer(text)), (len(text), len(text))]:
            out += self._paragraph(text, at, end, threshold, share)
            at = after
        return sorted(out)

    def _paragraph(self, text: str, begin: int, end: int, threshold: float, share: float) -> list[tuple[int, int, str, float]]:
        """As many spans of each family as don't overlap, the most probable ones, from the lines and the whole paragraph."""
        found = [(m.start(), m.end(), m[0].lower()) for m in _WORD.finditer(text, begin, end)]
        spelt = [w for _, _, w in found]
        known = [i for i, pair in enumerate(zip(spelt, spelt[1:], strict=False)) if " ".join(pair) in self.all_pairs]
        if not known:
            return []
        cuts = [0, *(i for i in range(1, len(found)) if "\n" in text[found[i - 1][1] : found[i][0]]), len(found)]
        units = [*zip(cuts, cuts[1:], strict=False), *([(0, len(found))] if len(cuts) > 2 else [])]
        fits: dict[str, list[tuple[int, int, float]]] = {}
        for a, b in sorted({x for lo, hi in units for x in self._spans(spelt, lo, hi)}):
            # without a pair of some template nothing is confirmed
            near = bisect_left(known, a)
            if near < len(known) and known[near] < b - 1 and (hit := self.classify(spelt[a:b], threshold, share)):
                fits.setdefault(hit[0], []).append((a, b, hit[1]))
        chosen = sorted((a, b, family, p) for family, spans in fits.items() for a, b, p in self._joined(spelt, family, _apart(spans), share))
        # another family that holds the same word pairs and more, in both spans together, explains a span
        explained: set[int] = set()
        for i, x in enumerate(chosen):
            for j in range(i + 1, len(chosen)):
                if chosen[j][0] >= x[1]:
                    break
                y = chosen[j]
                both = spelt[x[0] : max(x[1], y[1])]
                if x[2] != y[2] and self._held(x[2], spelt[x[0] : x[1]]) < self._held(y[2], both):
                    explained.add(i)
                elif x[2] != y[2] and self._held(y[2], spelt[y[0] : y[1]]) < self._held(x[2], both):
                    explained.add(j)
        return [(found[a][0], found[b - 1][1], family, p) for i, (a, b, family, p) in enumerate(chosen) if i not in explained]

    def _held(self, family: str, tokens: list[str]) -> frozenset[str]:
        """The word pairs of the template that has most of them here."""
        own = frozenset(map(" ".join, zip(tokens, tokens[1:], strict=False)))
        return max((own & t for t in self.pairs[family]), key=len)

    def _joined(self, spelt: list[str], family: str, spans: list[tuple[int, int, float]], share: float) -> list[tuple[int, int, float]]:
        """Neighbours become one span if a template is confirmed by both together, with more pairs than by either and not by each: one notice."""
        out: list[tuple[int, int, float]] = []
        held = lambda a, b: [len(t & set(map(" ".join, zip(spelt[a:b], spelt[a + 1 : b], strict=False)))) for t in self.pairs[family]]
        for a, b, p in spans:
            if out and a - out[-1][1] < WINDOW_WORDS:
                x, y, q = out[-1]
                parts = zip(self.pairs[family], held(x, b), held(x, y), held(a, b), strict=True)
                if any(n >= share * len(t) > min(k, m) and n > max(k, m) for t, n, k, m in parts):
                    out[-1] = (x, b, max(p, q))
                    continue
            out.append((a, b, p))
        return out

    def _spans(self, spelt: list[str], lo: int, hi: int) -> list[tuple[int, int]]:
        """Ranges of words between ``lo`` and ``hi`` that may be a notice."""
        hits = [i - lo for i in range(lo, hi) if spelt[i] in self.telling]
        if len(hits) < 2:
            return []
        n = hi - lo
        if n <= WINDOW_WORDS:
            spans = [(0, n)]
        else:
            spans = sorted({(max(0, i // STEP_WORDS * STEP_WORDS - d), i // STEP_WORDS * STEP_WORDS - d + WINDOW_WORDS) for i in hits for d in (0, STEP_WORDS)})
        # tight spans too: a notice inside running text stands out when its neighbours are left out
        spans += sorted({(max(0, i - 2), min(n, i + k)) for i in hits for k in (6, 12, 24)})
        return [(lo + a, lo + min(b, n)) for a, b in spans if min(b, n) - a >= 2]


def _softmax_fit(x: np.ndarray, y: np.ndarray, classes: int, steps: int = 300, rate: float = 0.5, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    w, b = np.zeros((x.shape[1], classes), np.float32), np.zeros(classes, np.float32)
    onehot = np.eye(classes, dtype=np.float32)[y]
    share = onehot.sum(0)
    weight = (len(y) / (classes * np.maximum(share, 1))).astype(np.float32)[y][:, None]
    xt = np.ascontiguousarray(x.T)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(steps):
        z = x @ w + b
        e = np.exp(z - z.max(1, keepdims=True))
        g = weight * (e / e.sum(1, keepdims=True) - onehot) / len(y)
        vw, vb = 0.9 * vw + xt @ g + decay * w, 0.9 * vb + g.sum(0)
        w, b = w - rate * vw, b - rate * vb
    return w, b


def corpus_negatives(docs: DataFrame, bound: int) -> list[str]:
    """At most ``bound`` windows of lines without licence words, for training: from as many documents, chosen by a hash.

    Lines are cut into windows as long as those that are classified; which of them are taken, hashes say.
    """
    h = F.xxhash64("doc_id")
    least = docs.select(h.alias("h")).orderBy("h").limit(bound).agg(F.max("h")).first()[0]
    if least is None:
        return []
    lines = docs.where((h <= least) & F.col("text").isNotNull()).select(h.alias("h"), F.explode(F.split("text", "\n")).alias("line"))
    plain = lines.where(~F.lower("line").rlike("licen|rights reserved|public domain|copyright|spdx|permission|redistribut") & (F.length("line") > 20))
    windows = plain.select("h", F.explode(F.regexp_extract_all("line", F.lit(rf"(\S{{1,40}}\s*){{1,{WINDOW_WORDS}}}"), F.lit(0))).alias("line"))
    return [r.line for r in windows.select(F.xxhash64("h", "line").alias("k"), "line").orderBy("k", "line").limit(bound).select("line").collect()]


#: Turns of the calibration: in each, texts whose place in the list is a multiple away are left out, and some families.
TURNS = 4


def fit_licenses(negatives: list[str], augmented: int = 12, seed: int = 5) -> LicenseModel:
    """Train on the templates, varied by dropped words, cut ends and foreign neighbours, against the negatives."""
    r = np.random.default_rng(seed)
    rows: list[tuple[list[str], str, int]] = []  # words, family, turn in which the text is left out
    filler = [w for x in negatives for w in words(x)] or ["the"]
    for family, texts in TEMPLATES.items():
        for turn, t in enumerate(texts):
            own = words(t)
            rows.append((own, family, turn % TURNS))
            for _ in range(augmented):
                kept = [w for w in own if r.random() > 0.08] or own
                before = list(r.choice(filler, r.integers(0, 6)))
                after = list(r.choice(filler, r.integers(0, 6)))
                rows.append((before + kept + after, family, turn % TURNS))
    for turn, t in enumerate((*NEGATIVES, *negatives)):
        rows.append((words(t), UNKNOWN, turn % TURNS))
    for turn, t in enumerate(NEGATIVES):
        for _ in range(augmented):
            rows.append(([w for w in words(t) if r.random() > 0.15], UNKNOWN, turn % TURNS))
    features = {g: i for i, g in enumerate(sorted({g for t in (*sum(TEMPLATES.values(), ()), *NEGATIVES) for g in grams(words(t))}))}
    classes = [*TEMPLATES, UNKNOWN]
    x = np.zeros((len(rows), len(features)), np.float32)
    for i, (tokens, *_) in enumerate(rows):
        at = sorted({features[g] for g in grams(tokens) if g in features})
        x[i, at] = 1 / max(1.0, len(at)) ** 0.5
    y = np.array([classes.index(family) for _, family, _ in rows])
    turn_of = np.array([turn for *_, turn in rows])

    # calibration: what is left out in a turn is scored by a model that hasn't seen it, nor the families of that turn
    unknown, margins, seen, strange = classes.index(UNKNOWN), [], [], []
    for turn in range(TURNS):
        hidden = np.isin(y, [c for c in range(unknown) if c % TURNS == turn])
        out = (turn_of == turn) | hidden
        w, b = _softmax_fit(x[~out], y[~out], len(classes), steps=80)
        z = x[out] @ w + b
        top = z.max(1)
        wanted = np.where(hidden[out], unknown, y[out])
        found = z.argmax(1)
        margins.append(-np.log(np.maximum(np.exp(z - top[:, None]).sum(1) - 1, 1e-12))[~hidden[out]])
        seen.append((found == wanted)[~hidden[out]])
        strange.append((found == unknown)[hidden[out]])
    # the temperature is fitted on being right about unseen texts: the margin of the best class over the rest
    right = np.concatenate(seen)
    temperature = min(2.0, max(0.25, fit_temperature(np.concatenate(margins), right.astype(float))))
    report = {"texts": float(len(right)), "unseen_texts_right": float(right.mean()), "unseen_families_unknown": float(np.concatenate(strange).mean()), "temperature": temperature}

    w, b = _softmax_fit(x, y, len(classes))
    telling = frozenset(g for g, i in features.items() if " " not in g and w[i, :-1].max() > w[i, -1] and g not in {"the", "a", "of", "and", "to", "in", "is", "this", "or", "for", "it", "you", "that", "are", "with", "any", "may", "not", "be", "by", "no"})
    pairs = {family: [frozenset(map(" ".join, zip(words(t), words(t)[1:], strict=False))) for t in texts] for family, texts in TEMPLATES.items()}
    return LicenseModel(classes, features, w, b, temperature, telling, pairs, report)


def license_scan(docs: DataFrame, model: LicenseModel, threshold: float = 0.6, share: float = 0.6) -> DataFrame:
    """One row per document: doc_id, n_licensed, families (sorted, comma-joined), spans (family:start:end), probability."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = T.StructType([docs.schema["doc_id"], T.StructField("n_licensed", T.LongType()), T.StructField("families", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("probability", T.DoubleType())])

    @returns_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            found = [own.scan(t.as_py(), threshold, share) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    pa.array([len(f) for f in found], pa.int64()),
                    pa.array([",".join(sorted({x[2] for x in f})) for f in found], pa.string()),
                    pa.array([",".join(f"{x[2]}:{x[0]}:{x[1]}" for x in f) for f in found], pa.string()),
                    pa.array([max((x[3] for x in f), default=0.0) for f in found], pa.float64()),
                ],
                [f.name for f in out.fields],
            )

    return text_batches(docs).select("doc_id", "text").mapInArrow(run, out)
