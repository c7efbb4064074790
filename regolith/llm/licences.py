"""Licence scan: a trained paragraph classifier whose predictions are confirmed by templates.

A paragraph is a line of text. A multinomial logistic regression over its word n-grams names a licence family or
``unknown``; it is trained on perturbed template paragraphs of each family and on paragraphs of the corpus that resemble
no template. Its probabilities are calibrated on perturbed paragraphs kept out of training: a temperature is fitted, and
a prediction below the confidence that keeps unknown paragraphs out is ``unknown``. A predicted family counts only if a
template of it is contained in the paragraph: at least 0.8 of the template's five-word shingles are found there.

Notices inside long lines, or wrapped over lines, are found by overlapping windows of 40, 16 and 8 words (``WINDOWS``) over each run of
lines between blank lines. A window's families are confirmed like a line's, and belong to the line in which the notice
begins; what is found twice at a place counts once.
"""

from __future__ import annotations

import functools
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regolith.llm.common import read

# Short public licence notices by family.
TEMPLATES = {
    "agpl": ["This program is licensed under the GNU Affero General Public License, version 3.", "GNU Affero General Public License for more details."],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Released under the BSD 3-Clause License.",
        "Licensed under the BSD License.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc0": ["This work is dedicated to the public domain under CC0 1.0 Universal.", "Released under CC0 1.0."],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "Licensed under the GNU GPL v2 or later.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", "Licensed under the GNU LGPL version 3.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation",
    ],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.", "Licensed under the Mozilla Public License 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "If a copy of the MPL was not distributed with this file, You can obtain one at"],
    "boost": ["Distributed under the Boost Software License, Version 1.0."],
    "epl": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice"],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
    "zlib": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"],
    "proprietary": ["All rights reserved.", "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited."],
}
# Public identifiers of licences by family, and the paths of their deeds.
IDENTIFIERS = {
    "agpl": ["AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"], "apache": ["Apache-2.0"], "boost": ["BSL-1.0"], "bsd": ["BSD-2-Clause", "BSD-3-Clause"], "cc-by": ["CC-BY-4.0"], "cc-by-nc": ["CC-BY-NC-4.0"],
    "cc-by-sa": ["CC-BY-SA-4.0"], "cc0": ["CC0-1.0"], "epl": ["EPL-2.0"], "gpl": ["GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"], "isc": ["ISC"],
    "lgpl": ["LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later"], "mit": ["MIT"], "mpl": ["MPL-2.0"], "unlicense": ["Unlicense"], "zlib": ["Zlib"],
}
DEEDS = {"cc-by": "creativecommons.org/licenses/by/4.0", "cc-by-nc": "creativecommons.org/licenses/by-nc/4.0", "cc-by-sa": "creativecommons.org/licenses/by-sa/4.0", "cc0": "creativecommons.org/publicdomain/zero/1.0", "apache": "www.apache.org/licenses/LICENSE-2.0"}
#: Short marks on lines of their own: identifiers in source files and manifests, and deeds.
TAGS = {family: [f"{mark} {name}" for name in names for mark in ("SPDX-License-Identifier:", "license:")] + ([DEEDS[family]] if family in DEEDS else []) for family, names in IDENTIFIERS.items()}
#: Sentences that hold licence words and are no notices: the corpus may have few of them to learn unknown from.
OTHERS = [
    "The city gave a license to the pub.", "She lost her driver license on the train.", "Contributor license agreements must be signed first.", "A public joke about the general public.",
    "The software is sold per seat and per year.", "Our licence fee rose by two percent.", "The free software movement began early.", "Copyright law protects the work of authors.",
    "The MIT campus lies in Cambridge.", "Two Apache helicopters flew over the village.", "BSD is a family of systems.", "Permission was granted by the council, free of charge.",
    "The foundation published its annual report.", "Version 2.0 of the product ships in May.", "Fishing license holders may apply here.", "The creative commons of the village was green.",
    "A general public meeting is held in March.", "The warranty is void if the case was opened.", "It is sold as is, without returns.", "The license number is printed on the back.",
    "This file is part of the archive.", "The Boost of the engine and the Eclipse of the moon.", "The terms of the contract were subject to change.", "No rights were reserved for late guests.",
]
UNKNOWN = "unknown"

NGRAM = 2
SHINGLE, CONTAINED = 5, 0.8
#: Words of a window, and between the starts of two. Any template (31 words at most) is whole in some wide window, those
#: of up to 11 and of up to 6 words in some narrower one too, where they weigh more.
WINDOWS = ((40, 10), (16, 6), (8, 3))
#: Paragraphs of the corpus in training at most, those with the smallest hashes: a documented bound.
SAMPLE_ROWS = 2500
#: Characters of a paragraph in training at most.
SAMPLE_CHARS = 2000
VARIANTS, TAG_VARIANTS, LONE, FEATURES = 40, 40, 5, 3000
#: Share of unknown calibration paragraphs that may pass the confidence.
PASSING = 0.002
_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")


def words(paragraph: str) -> list[str]:
    return _WORD.findall(paragraph.lower())


def contained(template: list[str], paragraph: list[str]) -> float:
    """Share of the template's shingles in the paragraph; a template of fewer words is sought as one run."""
    size = min(SHINGLE, len(template))
    sought = {tuple(template[i : i + size]) for i in range(len(template) - size + 1)}
    there = {tuple(paragraph[i : i + size]) for i in range(len(paragraph) - size + 1)}
    return len(sought & there) / len(sought) if sought else 0.0


_SOUGHT = {family: [words(t) for t in (*texts, *TAGS.get(family, []))] for family, texts in TEMPLATES.items()}


def confirm(family: str, paragraph: list[str]) -> float:
    """The best containment of the family's templates."""
    return max((contained(t, paragraph) for t in _SOUGHT.get(family, [])), default=0.0)


@dataclass(frozen=True)
class Model:
    families: tuple[str, ...]  # the last is unknown
    vocabulary: dict[str, int]
    singles: frozenset[str]  # words of which any feature has one
    weights: np.ndarray  # (features + 1, families), the bias last
    temperature: float
    confidence: float

    @functools.cached_property
    def gains(self) -> np.ndarray:
        """What each feature can add to each family over unknown, none below 0; the last row is of words without a feature."""
        more = np.maximum(0, self.weights[:-1, :-1] - self.weights[:-1, -1:])
        return np.concatenate([more, np.zeros((1, more.shape[1]))])

    def features(self, found: list[str]) -> list[int]:
        """Numbers of the paragraph's n-grams that the model knows, each once. Others have no weight."""
        get, seen = self.vocabulary.get, set()
        before = None
        for word in found:
            if word in self.singles:
                if (i := get(word)) is not None:
                    seen.add(i)
                if before is not None and (i := get(f"{before} {word}")) is not None:
                    seen.add(i)
                before = word
            else:
                before = None
        return sorted(seen)

    def probabilities(self, found: list[str], calibrated: bool = True) -> np.ndarray:
        x = self.features(found)
        scale = 1 / np.sqrt(max(1, NGRAM * len(found) - 1))
        z = self.weights[x].sum(axis=0) * scale * SPREAD + self.weights[-1]
        z = z / (self.temperature if calibrated else 1.0)
        p = np.exp(z - z.max())
        return p / p.sum()

    def predict(self, found: list[str]) -> tuple[str, float]:
        p = self.probabilities(found)
        k = int(p.argmax())
        return (self.families[k], float(p[k])) if p[k] >= self.confidence else (UNKNOWN, float(p[-1]))


#: Feature values are SPREAD / sqrt(n-grams of the paragraph).
SPREAD = 3.0


def _ngrams(found: list[str]) -> set[str]:
    return {*found, *(f"{a} {b}" for a, b in zip(found, found[1:]))}


def _variants(template: str, rng: random.Random, others: list[list[str]], n: int) -> list[list[str]]:
    """The template's words with words left out, doubled, or set among words of the corpus."""
    base, out = words(template), [words(template)]
    while len(out) < n:
        now = [w for w in base if len(base) < SHINGLE or rng.random() > 0.04 * rng.randrange(3)] or base
        if rng.random() < 0.4 and others:
            around = rng.choice(others)
            cut = rng.randrange(len(around) + 1)
            now = around[max(0, cut - 12) : cut] + now + around[cut : cut + rng.randrange(12)]
        out.append(now)
    return out


def fit(paragraphs: list[str], seed: int = 11) -> Model:
    """Trains on the templates and these paragraphs of a corpus; those that contain half of a template do not count."""
    rng = random.Random(seed)
    plain = [w for p in paragraphs if (w := words(p)) and max(contained(t, w) for ts in _SOUGHT.values() for t in ts) < 0.5]
    rng.shuffle(plain)
    parts = [words(p) for p in ("the license of this text", "version 2.0 of the work", "under the terms", "public work", "this file is", "rights")]
    plain += (parts + [words(p) for p in OTHERS]) * 5
    shared = Counter(w for texts in _SOUGHT.values() for w in {w for t in texts for w in t})
    for word, families_of in sorted(shared.items()):  # a word of notices alone is none, the less the more families have it
        around = [rng.choice(plain)[:12] for _ in range(LONE * families_of)]
        plain += [a[: len(a) // 2] + [word] + a[len(a) // 2 :] for a in around]
    families = (*sorted(TEMPLATES), UNKNOWN)
    rows = [(v, k) for k, f in enumerate(families[:-1]) for t in TEMPLATES[f] for v in _variants(t, rng, plain, VARIANTS)]
    rows += [(v, families.index(f)) for f in TAGS for t in TAGS[f] for v in _variants(t, rng, plain, max(3, TAG_VARIANTS // len(TAGS[f])))]
    rows += [(p, len(families) - 1) for p in plain]
    rng.shuffle(rows)
    cut = len(rows) * 4 // 5
    kept, spare = rows[:cut], rows[cut:]
    counted = Counter(g for found, _ in kept for g in _ngrams(found))
    known = {g for f in _SOUGHT.values() for t in f for g in _ngrams(t)}
    chosen = sorted(known) + [g for g, n in counted.most_common(FEATURES) if g not in known and n >= 5][: FEATURES - len(known)]
    vocabulary = {g: i for i, g in enumerate(chosen)}
    singles = frozenset(w for g in chosen for w in g.split(" "))
    model = Model(families, vocabulary, singles, np.zeros((len(chosen) + 1, len(families))), 1.0, 0.0)
    x = np.zeros((len(kept), len(chosen) + 1), np.float32)
    for row, (found, _) in zip(x, kept, strict=True):
        row[model.features(found)] = SPREAD / np.sqrt(max(1, NGRAM * len(found) - 1))
        row[-1] = 1
    y = np.eye(len(families), dtype=np.float32)[[k for _, k in kept]]
    weights, pace = np.zeros((x.shape[1], len(families)), np.float32), np.zeros((x.shape[1], len(families)), np.float32)
    for _ in range(160):  # gradient steps with momentum
        z = x @ weights
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        pace = 0.9 * pace - 2.0 * (x.T @ (p - y) / len(x) + 1e-5 * weights)
        weights += pace
    model = Model(families, vocabulary, singles, weights.astype(np.float64), 1.0, 0.0)
    raw = [(np.log(model.probabilities(found, False) + 1e-12), k) for found, k in spare]

    def loss(t: float) -> float:
        return -sum(z[k] / t - np.log(np.exp(z / t).sum()) for z, k in raw)

    temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0), key=loss) if raw else 1.0
    model = Model(families, vocabulary, singles, model.weights, temperature, 0.0)
    unknown = sorted(float(model.probabilities(found)[:-1].max()) for found, k in spare if k == len(families) - 1)
    confidence = max(0.5, unknown[int(len(unknown) * (1 - PASSING))]) if unknown else 0.5
    return Model(families, vocabulary, singles, model.weights, temperature, min(confidence, 0.99))


def train(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Fits on at most ``rows`` distinct paragraphs of ``docs`` (text), those with the smallest hashes of all."""
    lines = docs.select(F.explode(F.split("text", "\n")).alias("line")).where(F.length("line").between(1, SAMPLE_CHARS))
    lines = lines.select(F.xxhash64("line").alias("h"), "line")
    last = lines.select("h").distinct().orderBy("h").limit(rows).agg(F.max("h")).first()[0]  # only hashes are shuffled
    some = lines.where(F.col("h") <= F.lit(last)).dropDuplicates(["h"]).orderBy("h").limit(rows)
    return fit([r.line for r in some.collect()])


_SCHEMA = "doc_id long, n_paragraphs long, n_licences long, families string, top_score double, n_unconfirmed long"


def _places(family: str, found: list[str]) -> list[int]:
    """Places of the words that belong to the family's best contained template, ascending."""
    template = max(_SOUGHT[family], key=lambda t: contained(t, found))
    size = min(SHINGLE, len(template))
    sought = {tuple(template[i : i + size]) for i in range(len(template) - size + 1)}
    return sorted({i + k for i in range(len(found) - size + 1) if tuple(found[i : i + size]) in sought for k in range(size)})


def _families(model: Model, found: list[str]) -> list[tuple[str, float]]:
    """The predicted family, and any other that would be predicted were it the only family beside unknown: two notices
    in one window do not hide each other. Scores are calibrated probabilities against unknown."""
    p = model.probabilities(found)
    alone = p[:-1] / (p[:-1] + p[-1])
    return [(model.families[k], float(alone[k])) for k in np.argsort(-p[:-1]) if alone[k] >= model.confidence]


def _windows(model: Model, block: list[str]) -> list[tuple[int, int]]:
    """The windows of a block that can have a family at all. The bound leaves out what speaks for unknown and counts
    repeated n-grams each time, so a window below it has none."""
    get, singles = model.vocabulary.get, model.singles
    known = [w if w in singles else None for w in block]
    pairs = [get(f"{a} {b}", -1) if a is not None and b is not None else -1 for a, b in zip(known, known[1:])]
    gain = model.gains[[get(w, -1) for w in block]]
    gain[1:] += model.gains[pairs]
    total = np.concatenate([np.zeros((1, gain.shape[1])), np.cumsum(gain, axis=0)])
    need = model.temperature * np.log(model.confidence / (1 - model.confidence)) - (model.weights[-1, :-1] - model.weights[-1, -1])
    out = []
    for width, stride in WINDOWS:
        last = max(0, len(block) - width)
        a = np.array([*range(0, last, stride), last])
        b = np.minimum(a + width, len(block))
        scale = SPREAD / np.sqrt(np.maximum(1, NGRAM * (b - a) - 1))
        may = ((total[b] - total[a]) * scale[:, None] >= need - 1e-6).any(axis=1)
        out += zip(a[may].tolist(), b[may].tolist())
    return out


def scan_text(model: Model, text: str | None) -> tuple[int, list[tuple[int, str, float, float]]]:
    """Paragraphs of a text, and (place, family, score, containment) of those that are predicted to be licences; a family
    counts once for each paragraph."""
    hits: dict[tuple[int, str], tuple[float, float]] = {}
    place, block, lines = 0, [], []  # words of the lines since the last blank one, and the line of each

    def windows() -> None:
        if not block or model.singles.isdisjoint(block):
            return
        taken: set[int] = set()  # words of confirmed notices
        doubtful = []
        for a, b in _windows(model, block):
            found, at = block[a:b], list(range(a, b))
            while found and not model.singles.isdisjoint(found):
                families = _families(model, found)
                sure = next(((f, score, share) for f, score in families if (share := confirm(f, found)) >= CONTAINED), None)
                if sure is None:
                    if families:
                        doubtful.append((at, *families[0], confirm(families[0][0], found)))
                    break
                family, score, share = sure
                gone = set(_places(family, found))
                own = sorted({lines[at[i]] for i in gone})
                taken.update(at[i] for i in gone)
                if not any(hits.get((n, family), (0, 0))[1] >= CONTAINED for n in own):
                    for n in own:
                        hits.pop((n, family), None)  # parts of it that no template confirmed alone
                    hits[own[0], family] = score, share
                # then what else the window has
                found, at = [w for i, w in enumerate(found) if i not in gone], [n for i, n in enumerate(at) if i not in gone]
        for at, family, score, share in doubtful:  # not where a window cut a confirmed notice
            if taken.isdisjoint(range(at[0], at[-1] + 1)) and not any((lines[n], family) in hits for n in at):
                hits[lines[at[len(at) // 2]], family] = score, share

    for line in (text or "").split("\n"):
        if not line.strip():
            windows()
            block, lines = [], []
            continue
        found = words(line)
        if found and not model.singles.isdisjoint(found):  # else only the bias speaks, for unknown
            family, score = model.predict(found)
            if family != UNKNOWN:
                hits[place, family] = score, confirm(family, found)
        block += found
        lines += [place] * len(found)
        place += 1
    windows()
    return place, [(n, family, *x) for (n, family), x in sorted(hits.items())]


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: paragraphs, confirmed notices (a family once for each paragraph), their families (sorted, comma between), the
    largest calibrated score of those, and the predictions that no template confirmed.

    Null and empty texts have no paragraphs, an empty ``families`` and score 0. Repeated rows keep their rows; other
    columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most FEATURES features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                n, hits = scan_text(shared.value, text)
                sure = [h for h in hits if h[3] >= CONTAINED]
                out.append((n, len(sure), ",".join(sorted({h[1] for h in sure})), max((h[2] for h in sure), default=0.0), len(hits) - len(sure)))
            columns = list(zip(*out)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], [x.split()[0] for x in _SCHEMA.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, _SCHEMA)


def op1_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return scan(docs, train(docs.select("text")))
