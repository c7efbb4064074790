import math
import random
import zlib

import numpy as np
import pytest

from regolith.llm import language

PARTS = {"aa": ["the", "ion", "ing", "and", "th", "er"], "bb": ["que", "eau", "ère", "tion", "les", "ou"], "cc": ["sch", "ung", "ein", "über", "keit", "der"]}


def corpus(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = sorted(PARTS)[i % 3]
        words = ["".join(rng.choice(PARTS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.choice([2, 10, 80, 300]))]
        rows.append((i, " ".join(words).capitalize() + ".", lang))
    return rows


@pytest.fixture(scope="module")
def model():
    rows = corpus(240, 1)
    return language.fit([t for _, t, _ in rows], [lang for _, _, lang in rows])


def test_counts_are_the_plain_ones():
    got, letters = language.counts("Ab, b1 É")
    joined = " ab b é "
    grams = [joined[i : i + n] for n in (2, 3) for i in range(len(joined) - n + 1)] + list(joined[1:-1])
    assert letters == 4 and got.sum() == len(grams)
    assert language.counts(None)[1] == language.counts("12 %")[1] == 0


def test_other_texts_are_told(model):
    rows = corpus(300, 2)
    langs, score, rejected = language.predict(model, [t for _, t, _ in rows])
    assert np.mean([a == b for a, (_, _, b) in zip(langs, rows)]) > 0.99
    assert ((score >= 0) & (score <= 1)).all() and not rejected.any()


def test_rejection_and_undetermined(model):
    texts = [None, "", "12 -- %", "中文字符" * 30, "жщю " * 50, "x" * 200_000, "the"]
    langs, score, rejected = language.predict(model, texts)
    assert langs[:3] == ["und"] * 3 and (score[:3] == 0).all() and rejected[:5].all()
    assert set(langs[3:]) <= set(PARTS) and langs[6] == "aa" and not rejected[6]
    assert language.fit(["12"], ["aa"]) is None and language.predict(None, ["a"])[0] == ["und"]


def test_rows_and_training_split(spark):
    rows = [(i, t, lang if i % 10 else None, "s") for i, t, lang in corpus(300, 5)]
    rows += [(7, rows[7][1], rows[7][2], "again"), (None, "the thing", None, None), (999, None, "aa", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = language.train(docs.select("doc_id", "text", "lang"))
    assert set(model.langs) == set(PARTS)
    got = language.identify(docs, model).collect()
    assert len(got) == len(rows)
    truth = {i: lang for i, _, lang in corpus(300, 5)}
    right = [r.lang_pred == truth[r.doc_id] for r in got if r.doc_id in truth]
    assert np.mean(right) > 0.98
    assert {r.lang_pred for r in got if r.text is None} == {"und"}
    held = {r.doc_id: r.h for r in docs.select("doc_id", language.held_out("doc_id").alias("h")).collect()}
    assert all(h == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2) for i, h in held.items())
    none = docs.limit(0)
    assert language.train(none.select("doc_id", "text", "lang")) is None
    assert language.identify(none, None).count() == 0


def test_chunks_change_nothing(monkeypatch):
    texts = ["a", "ab", "the words of a text, and 12 more " * 9, "x" * 50, "é ü ñ"]
    want = [language.counts(t) for t in texts]
    for chunk in (1, 2, 3, 7, 64):
        monkeypatch.setattr(language, "CHUNK", chunk)
        assert all((language.counts(t)[0] == w[0]).all() and language.counts(t)[1] == w[1] for t, w in zip(texts, want))


def plain_prediction(model, text):
    """Counts to dampened, weighted, normalised vectors; the nearest centroid of each language; shares; the floor."""
    counts, letters = language.counts(text)
    if not letters:
        return "und", 0.0, True
    v = [math.log(1 + float(c)) * float(w) for c, w in zip(counts, model.idf)]
    norm = math.sqrt(sum(x * x for x in v))
    best = {}
    for centroid, owner in zip(model.centroids, model.owner):
        cosine = sum(x * float(y) for x, y in zip(v, centroid) if x) / norm
        best[model.langs[owner]] = max(cosine, best.get(model.langs[owner], -1))
    top = max(best, key=best.get)
    score = 1 / sum(math.exp(language.SHARPNESS * (c - best[top])) for c in best.values())
    return top, score, best[top] < model.floor[min(int(math.log2(letters)), 12)]


def test_predictions_as_their_definition():
    rng = random.Random(3)
    parts = {"a": ["the", "ing", "and"], "b": ["que", "eau", "les"], "c": ["ung", "ich", "sch"]}
    make = lambda k, n: " ".join("".join(rng.choice(parts[k]) for _ in range(2)) for _ in range(n))
    model = language.fit([make(k, 60) for k in "abc" for _ in range(40)], [k for k in "abc" for _ in range(40)])
    texts = [make(k, n) for k in "abc" for n in (1, 4, 80)] + ["", None, "12 --", "жщю", "the", make("a", 5) + make("b", 5)]
    langs, score, rejected = language.predict(model, texts)
    want = [plain_prediction(model, t) for t in texts]
    assert langs == [w[0] for w in want] and list(score) == pytest.approx([w[1] for w in want], abs=1e-3) and list(rejected) == [w[2] for w in want]


def test_idf_and_centroids_are_of_the_texts():
    texts = ["the the", "que", "the que"]
    model = language.fit(texts, ["a", "b", "a"])
    seen = [sum(language.counts(t)[0][k] > 0 for t in texts) for k in range(language.SIZE)]
    assert model.idf == pytest.approx([math.log(4 / (1 + n)) + 1 for n in seen], rel=1e-5)
    assert np.linalg.norm(model.centroids, axis=1) == pytest.approx(np.ones(len(model.centroids)), rel=1e-5)
