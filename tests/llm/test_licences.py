import math
import random

import pytest

from regolith.llm import licences


def plain(n, seed):
    rng = random.Random(seed)
    parts = ["the", "ion", "ing", "er", "this", "work", "under", "version", "of", "public", "is", "an", "all", "terms"]
    return [" ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 3))) for _ in range(rng.randrange(1, 60))) + "." for _ in range(n)]


@pytest.fixture(scope="module")
def model():
    return licences.fit(plain(1500, 1))


def hits(model, text):
    return [(f, s >= 0.8) for _, f, _, s in licences.scan_text(model, text)[1]]


def test_templates_are_named_and_confirmed(model):
    for family, texts in licences.TEMPLATES.items():
        for text in texts:
            for paragraph in (text, text.upper(), "Note: " + text + " Thanks to all."):
                assert hits(model, paragraph) == [(family, True)], paragraph


def test_other_paragraphs_are_unknown(model):
    false = sum(bool([h for h in hits(model, p) if h[1]]) for p in plain(2000, 2))
    assert false == 0
    for text in ("The license of the car expired.", "Version 2.0 was under the table.", "rights", "MIT opened in 1861.", "Public works are reserved."):
        assert not [h for h in hits(model, text) if h[1]]


def test_a_prediction_needs_a_template(model):
    odd = "Licensed loosely under some Apache-like License draft, Version maybe 2.0."
    assert not [h for h in hits(model, odd) if h[1]]
    assert licences.contained(licences.words("a b c d e f"), licences.words("x a b c d e y")) == 0.5


def test_rows(spark, model):
    texts = ["prose here\nReleased under the MIT License.\n\nmore", None, "", "All rights reserved.\nLicensed under CC BY-NC 4.0.", "word " * 50_000]
    rows = [*((i, t, 1) for i, t in enumerate(texts)), (0, texts[0], 2), (None, texts[0], 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, families int")
    got = sorted(((r.doc_id, r.n_paragraphs, r.n_licences, r.families) for r in licences.scan(df, model).collect()), key=str)
    assert got == sorted([(0, 3, 1, "mit"), (0, 3, 1, "mit"), (None, 3, 1, "mit"), (1, 0, 0, ""), (2, 0, 0, ""), (3, 2, 2, "cc-by-nc,proprietary"), (4, 1, 0, "")], key=str)
    assert licences.scan(df.limit(0), licences.train(df.limit(0).select("text"))).count() == 0


def test_notices_in_long_and_wrapped_paragraphs(model):
    prose = plain(400, 7)
    for family, texts in licences.TEMPLATES.items():
        for text in texts:
            long = " ".join(prose[:20]) + " " + text + " " + " ".join(prose[20:40])
            assert len(long.split()) > 500
            assert (family, True) in hits(model, long), text
            if len(text.split()) >= 6:
                parts = text.split()
                half = len(parts) // 2
                wrapped = prose[0] + "\n" + " ".join(parts[:half]) + "\n" + " ".join(parts[half:]) + "\n" + prose[1]
                assert [(n, f) for n, f, _, s in licences.scan_text(model, wrapped)[1] if s >= 0.8] == [(1, family)], text


def test_two_notices_in_one_line(model):
    prose = plain(400, 8)
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    for line in (f"{mit} {apache}", " ".join([*prose[:9], mit, apache, *prose[9:18]]), " ".join([*prose[:9], mit, *prose[9:18], apache])):
        assert [f for f, sure in hits(model, line) if sure] == ["apache", "mit"], line
    assert not [h for h in hits(model, " ".join(prose[40:])) if h[1]]


# Headers as they stand in source files, wrapped and commented.
HEADERS = {
    "mit": """# Copyright (c) 2020 A. Person
#
# Permission is hereby granted, free of charge, to any person obtaining a copy
# of this software and associated documentation files (the "Software"), to deal
# in the Software without restriction, including without limitation the rights
# to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
# copies of the Software, and to permit persons to whom the Software is""",
    "apache": """ * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    "gpl": """// This program is free software: you can redistribute it and/or modify
// it under the terms of the GNU General Public License as published by
// the Free Software Foundation, either version 3 of the License, or
// (at your option) any later version.""",
    "bsd": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.""",
    "mpl": """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */""",
}


def test_headers_of_source_files(model):
    prose = plain(60, 5)
    for family, header in HEADERS.items():
        for text in (header, "\n".join([*prose[:4], header, *prose[4:8]])):
            assert {f for f, sure in hits(model, text) if sure} == {family}, text


def test_scores_as_their_definition(model):
    """Softmax of the n-grams' weights over the root of their number, at the calibrated temperature."""
    for text in ("Released under the MIT License.", "the work is in the public domain", "x y z", "license license license"):
        found = licences.words(text)
        grams = {*found, *(" ".join(p) for p in zip(found, found[1:]))}
        z = [model.weights[-1][k] for k in range(len(model.families))]
        for g in grams & model.vocabulary.keys():
            z = [a + model.weights[model.vocabulary[g]][k] * 3 / max(1, 2 * len(found) - 1) ** 0.5 for k, a in enumerate(z)]
        e = [math.exp(a / model.temperature) for a in z]
        assert list(model.probabilities(found)) == pytest.approx([a / sum(e) for a in e])


def test_identifiers_and_deeds(model):
    for family, names in licences.IDENTIFIERS.items():
        for name in names:
            for line in (f"SPDX-License-Identifier: {name}", f"// SPDX-License-Identifier: {name}", f'  "license": "{name}",', f"license = '{name}'"):
                assert {f for f, sure in hits(model, "int x;\n" + line + "\nint y;") if sure} == {family}, line
    for family, deed in licences.DEEDS.items():
        assert {f for f, sure in hits(model, f"https://{deed}/") if sure} == {family}


def test_sentences_with_licence_words_are_unknown(model):
    """Not those that the model was trained on."""
    others = [
        "The town gave a licence to the inn.", "He renewed his driver license in June.", "All contributor license agreements were signed.", "The general public was invited to the fair.", "Software version 2.0 was sold per seat.",
        "MIT professors and Apache pilots met.", "The council granted permission, free of charge, to any person who asked.", "A license of any kind is needed for fishing.", "The work is under way in public.", "The Mozilla of the story is a dragon.",
    ]
    for text in others:
        assert not hits(model, text), (text, hits(model, text))
