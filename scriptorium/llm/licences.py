"""Licence scans: a trained paragraph classifier names licence families, templates confirm them.

Features are the words and word pairs that occur in the templates, counted and divided by the root of the paragraph's length. A
multinomial logistic regression over the families and an unknown class is trained on the templates, varied by dropped, swapped and added
words, on ordinary paragraphs (at most SAMPLE_DOCS texts of the corpus) and on near misses. A held-out part sets the temperature
that calibrates its probabilities. A family is predicted where its probability is the greatest and at least SURE; it is
confirmed where the paragraph holds enough of the word triples of one of the family's templates, or the other way round.

Every paragraph of every text is scored: a line, or windows of WINDOW words of a longer line. So are overlapping windows of SHORT
words within every line, as a short notice in a long line would be diluted; such a window is confirmed where it holds enough of a
template. Of notices whose words overlap, the one that shares most triples with its template counts, so that a part of one
licence's notice isn't taken for another's. An upper bound from the weights of the terms that occur rules out most windows
without a full score, and never changes a verdict.

A line of two to four words is confirmed as any run of one of the family's templates.

Cases: null and empty texts have no paragraphs; very long texts are scored whole, window by window; of notices that tie, the more
probable and then the earlier one counts; repeated rows are judged alike; an empty table gives an empty table; extra columns are
left aside, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import bytes_of, slices, tidied
from scriptorium.llm.decontaminate import pair_hashes, plain, triples
from scriptorium.llm.shingles import word_hashes

#: At most so many texts of the corpus serve as ordinary paragraphs for training, with at most so many paragraphs each.
SAMPLE_DOCS, SAMPLE_LINES = 400, 4
VARIANTS, ROUNDS, SURE, SHARE, WINDOW = 40, 400, 0.5, 0.6, 120
#: Words of the short windows within lines; each begins a quarter of its length after the last one.
SHORT = (8, 16, 32, 64)
#: Most words of a line that counts as any run of a template.
SHORT_LINE = 4
UNKNOWN = "unknown"
#: Short notices of licence families, as publishers print them (fixed values).
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT license. See LICENSE in the project root for license information.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Released under the GNU GPL version 2.",
    ),
    "LGPL": (
        "This library is licensed under the GNU Lesser General Public License.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, version 2.1.",
    ),
    "AGPL": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ),
    "BSD": (
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
        "Released under the ISC License.",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC0": (
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
        "Dedicated to the public domain under CC0 1.0.",
    ),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "Proprietary": (
        "All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher.",
        "Copyright. All rights reserved.",
        "All rights reserved.",
        "This software is proprietary and confidential; unauthorized copying is strictly prohibited.",
    ),
}
#: Identifiers of the families' licences in SPDX lines (fixed values).
SPDX = {
    "MIT": "MIT", "Apache-2.0": "Apache-2.0", "GPL": "GPL-3.0-or-later", "LGPL": "LGPL-2.1-only", "AGPL": "AGPL-3.0-only", "BSD": "BSD-3-Clause", "MPL-2.0": "MPL-2.0", "ISC": "ISC",
    "CC-BY": "CC-BY-4.0", "CC-BY-SA": "CC-BY-SA-4.0", "CC-BY-NC": "CC-BY-NC-4.0", "CC0": "CC0-1.0", "Unlicense": "Unlicense",
}
TEMPLATES = {f: (*ts, *(f"SPDX-License-Identifier: {SPDX[f]}" for f in [f] if f in SPDX)) for f, ts in TEMPLATES.items()}
#: Sentences that use the words of licences for other things (fixed values).
NEAR_MISSES = (
    "She renewed her driving license at the public office on Monday.",
    "The version of the story that was published is free of charge.",
    "He works for the general public and the foundation of the school.",
    "You may obtain a copy of the book at the library.",
    "The pilot lost his license after the accident.",
    "Apache helicopters were seen over the valley.",
    "MIT is a university in Cambridge.",
    "A copy of the agreement was sent to the person without any warranty of success.",
    "This work is hard and the terms of the contract are not free.",
    "Use of the road is permitted with or without a ticket.",
)


def terms_of(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a plain text, and of its word pairs."""
    words = word_hashes(raw)
    return words, pair_hashes(words)


class Classifier:
    """Weights (terms x classes), biases and temperature; class 0 is unknown."""

    def __init__(self, samples: list[bytes], seed: int = 7, without: tuple[str, ...] = ()):
        """Train on all templates but those of `without`, which held_out() then judges."""
        rng = np.random.default_rng(seed)
        self.classes = [UNKNOWN, *TEMPLATES]
        self.templates = {f: [triples(t.encode()) for t in ts] for f, ts in TEMPLATES.items()}
        self.runs = {f: [b" " + b" ".join(plain(t.encode()).split()) + b" " for t in ts] for f, ts in TEMPLATES.items()}
        trained = {f: [t for t in ts if t not in without] for f, ts in TEMPLATES.items()}
        known = [np.concatenate(terms_of(plain(t.encode()))) for ts in trained.values() for t in ts]
        self.terms = np.unique(np.concatenate(known))
        texts, labels = [], []
        for c, ts in enumerate(trained.values(), 1):
            for t in ts:
                for v in range(VARIANTS):
                    texts.append(self._varied(plain(t.encode()).split(), samples, rng) if v else plain(t.encode()))
                    labels.append(c)
        every = [t for ts in self.templates.values() for t in ts]
        ordinary = [s for s in samples if not any(len(triples(s) & t) > 0.3 * len(t) for t in every)]
        # ordinary text also as the short windows see it
        cut = []
        for t in ordinary:
            words, size = plain(t).split(), int(rng.choice(SHORT))
            if len(words) > size:
                first = int(rng.integers(len(words) - size + 1))
                cut.append(b" ".join(words[first : first + size]))
        others = [*map(plain, ordinary), *cut, *[plain(t.encode()) for t in NEAR_MISSES] * 8]
        texts += others
        labels += [0] * len(others)
        x, y = np.array([self.features(t) for t in texts]), np.array(labels)
        held = rng.random(len(y)) < 0.2
        self.weights, self.bias, self.temperature = np.zeros((len(self.terms), len(self.classes))), np.zeros(len(self.classes)), 1.0
        self._fit(x[~held], y[~held])
        self._calibrate(x[held], y[held])
        self.accuracy = float((self.probabilities(x[held]).argmax(axis=1) == y[held]).mean())
        gain = self.weights[:, 1:] - self.weights[:, :1]
        self.gain, self.start = np.maximum(gain.max(axis=1), 0), float((self.bias[1:] - self.bias[0]).max())
        self.gate = np.zeros(1 << 20, bool)
        self.gate[(self.terms & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    @staticmethod
    def _varied(words: list[bytes], samples: list[bytes], rng: np.random.Generator) -> bytes:
        kept = [w for w in words if rng.random() > 0.12] or words
        if rng.random() < 0.3 and len(kept) > 3:
            i = int(rng.integers(len(kept) - 1))
            kept[i], kept[i + 1] = kept[i + 1], kept[i]
        if samples and rng.random() < 0.5:
            extra = plain(samples[int(rng.integers(len(samples)))]).split()[: int(rng.integers(0, 8))]
            kept = extra + kept if rng.random() < 0.5 else kept + extra
        return b" ".join(kept)

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of known terms and their numbers."""
        at = np.flatnonzero(self.gate[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)]) if hasattr(self, "gate") else np.arange(len(hashes))
        n = np.minimum(np.searchsorted(self.terms, hashes[at]), len(self.terms) - 1)
        good = self.terms[n] == hashes[at]
        return at[good], n[good]

    def features(self, raw: bytes) -> np.ndarray:
        words, pairs = terms_of(raw)
        counts = np.bincount(np.concatenate([self.numbers(words)[1], self.numbers(pairs)[1]]), minlength=len(self.terms))
        return counts / np.sqrt(max(1, len(words)))

    def logits(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.logits(x) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def _fit(self, x: np.ndarray, y: np.ndarray, rate: float = 2.0, ridge: float = 1e-4) -> None:
        target = np.eye(len(self.classes))[y]
        weight = (1 / np.bincount(y, minlength=len(self.classes)).clip(1))[y][:, None]
        weight = weight / weight.sum() * 1.0
        velocity = np.zeros_like(self.weights)
        for _ in range(ROUNDS):
            error = (self.probabilities(x) - target) * weight
            velocity = 0.9 * velocity - rate * (x.T @ error + ridge * self.weights)
            self.weights += velocity
            self.bias -= rate * error.sum(axis=0)

    def _calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        best = np.inf
        for t in np.geomspace(0.05, 5, 60):
            self.temperature = t
            loss = -np.log(self.probabilities(x)[np.arange(len(y)), y].clip(1e-12)).mean()
            if loss < best:
                best, chosen = loss, t
        self.temperature = chosen

    def matched(self, words: list[bytes], family: str, whole: bool) -> tuple[float, int, int, int]:
        """Greatest share of triples in common with a template of the family, how many these are, and where they begin and end. A whole paragraph counts by the smaller of both, a window within it by the template."""
        own = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
        held, best = set(own), (0.0, 0, 0, len(words))
        for t in self.templates[family]:
            common = held & t
            if not common:
                continue
            if min(len(held), len(t)) > 2 or held == t:
                share = len(common) / (min(len(held), len(t)) if whole else len(t))
            else:  # very short templates only as they are
                share = float(t <= held)
            if (share, len(common)) > best[:2]:
                at = [i for i, x in enumerate(own) if x in common]
                best = share, len(common), at[0], at[-1] + 3
        # a short line is confirmed as any run of a template
        if whole and best[0] < SHARE and 2 <= len(words) <= SHORT_LINE and any(b" " + b" ".join(words) + b" " in t for t in self.runs[family]):
            best = 1.0, 1, 0, len(words)
        return best

    def held_out(self, texts: dict[str, str]) -> float:
        """Share of whole templates (text: family) that get their family."""
        found = self.probabilities(np.array([self.features(plain(t.encode())) for t in texts])).argmax(axis=1)
        return float(np.mean([self.classes[c] == f for c, f in zip(found.tolist(), texts.values(), strict=True)]))

    def scan(self, raw: bytes) -> list[tuple[int, str, float, float]]:
        """Paragraph number, family, probability and template share of each notice that is predicted; of notices that overlap, the one with most of its template's words."""
        lowered = plain(raw)
        words, pairs = terms_of(lowered)
        # words of each line, from the counts of its own bytes
        begin, counts = 0, []
        for line in raw.split(b"\n"):
            counts.append(len(lowered[begin : begin + len(line)].split()))
            begin += len(line) + 1
        ends = np.cumsum([0, *counts])
        begins, stops, lines, wholes = [], [], [], []
        for line, (a, b) in enumerate(zip(ends.tolist(), ends[1:].tolist())):
            if b == a:
                continue
            starts = np.array([a]) if b - a <= WINDOW else np.arange(a, b - WINDOW // 2, WINDOW // 2)
            begins.append(starts)
            stops.append(np.minimum(starts + WINDOW, b))
            for size in SHORT:
                if b - a > size:
                    starts = np.append(np.arange(a, b - size, size // 4), b - size)
                    begins.append(starts)
                    stops.append(starts + size)
            lines += [line] * (len(begins) - len(wholes))
            wholes += [True] + [False] * (len(begins) - len(wholes) - 1)
        if not begins:
            return []
        sizes = [len(x) for x in begins]
        i, j, line, whole = np.concatenate(begins), np.concatenate(stops), np.repeat(lines, sizes), np.repeat(wholes, sizes)
        at_w, n_w = self.numbers(words)
        at_p, n_p = self.numbers(pairs)
        gain_w, gain_p = np.concatenate([[0.0], np.cumsum(self.gain[n_w])]), np.concatenate([[0.0], np.cumsum(self.gain[n_p])])
        lw, hw, lp, hp = np.searchsorted(at_w, i), np.searchsorted(at_w, j), np.searchsorted(at_p, i), np.searchsorted(at_p, j - 1)
        bound = (gain_w[hw] - gain_w[lw] + gain_p[hp] - gain_p[lp]) / np.sqrt(j - i) + self.start
        chosen, tokens = [], None
        for k in np.flatnonzero(bound >= -1e-9).tolist():
            z = (self.weights[n_w[lw[k] : hw[k]]].sum(axis=0) + self.weights[n_p[lp[k] : hp[k]]].sum(axis=0)) / np.sqrt(j[k] - i[k]) + self.bias
            c = int(z.argmax())
            if not c:
                continue
            p = float(1 / np.exp((z - z[c]) / self.temperature).sum())
            if p >= SURE:
                tokens = lowered.split() if tokens is None else tokens
                a = int(i[k])
                share, n, first, last = self.matched(tokens[a : int(j[k])], self.classes[c], bool(whole[k]))
                chosen.append((share >= SHARE, n, p, int(line[k]), self.classes[c], share, a + first, a + last))
        taken: dict[int, list] = {}
        for x in sorted(chosen, key=lambda x: (not x[0], -x[1], -x[2], x[6], x[7])):
            spans = taken.setdefault(x[3], [])
            if all(x[7] <= y[6] or x[6] >= y[7] for y in spans):
                spans.append(x)
        return [(n, family, p, share) for n in sorted(taken) for _, _, p, _, family, share, _, _ in sorted(taken[n], key=lambda x: x[6])]


def sample_lines(docs: DataFrame, text: str = "text") -> list[bytes]:
    """Lines of a bounded sample of the corpus: the SAMPLE_DOCS texts with the least hashes, so that every run has the same."""
    hashed = docs.where(F.col(text).isNotNull()).select(F.xxhash64(text).alias("h"), F.col(text).alias("t"))
    # the hashes alone are ranked, so that tasks send no texts that aren't in the sample; copies are one text
    last = hashed.select("h").distinct().orderBy("h").limit(SAMPLE_DOCS).agg(F.max("h")).first()[0]
    sample = [r["t"] for r in hashed.where(F.col("h") <= F.lit(last)).groupBy("h").agg(F.min("t").alias("t")).orderBy("h").collect()] if last is not None else []
    return [line.encode() for t in sample for line in t.split("\n")[:SAMPLE_LINES] if line.strip()]


def train(docs: DataFrame, text: str = "text") -> Classifier:
    """Train on the templates and on a bounded sample of the corpus."""
    return Classifier(sample_lines(docs, text))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", classifier: Classifier | None = None) -> DataFrame:
    """id, n_predicted (licence paragraphs), families (confirmed, ascending), unconfirmed (predicted, not confirmed, ascending) and probability (the greatest of a confirmed one, else 0) of each text."""
    trained = docs.sparkSession.sparkContext.broadcast(classifier or train(docs, text))  # some thousand terms x 15 classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = trained.value
        for whole in batches:
            for batch in slices(whole, text):
                rows = []
                for raw in bytes_of(batch, text):
                    found = known.scan(raw)
                    good = [x for x in found if x[3] >= SHARE]
                    families = sorted({x[1] for x in good})
                    rows.append((len({x[0] for x in found}), families, sorted({x[1] for x in found} - {*families}), max((x[2] for x in good), default=0.0)))
                n, families, rest, p = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(families, pa.list_(pa.string())), pa.array(rest, pa.list_(pa.string())), pa.array(p, pa.float64())], names=["doc_id", "n_predicted", "families", "unconfirmed", "probability"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(tidied(run), f"doc_id {kind}, n_predicted long, families array<string>, unconfirmed array<string>, probability double")
