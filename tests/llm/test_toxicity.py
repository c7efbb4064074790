import math
import random
import zlib

import pytest
import zstandard

from regolith.llm import toxicity


def corpus(n, seed):
    rng = random.Random(seed)
    parts = ["the", "ion", "er", "an", "th", "ing", "or", "en", "le", "re", "st", "ou"]
    words = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 5))) for _ in range(3000)]
    bad = ["blackguard", "knave", "zounds"]
    texts, marks = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(20, 150))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(1 + len(text) // 40):
                text[rng.randrange(len(text))] = rng.choice(bad)
        texts.append(" ".join(text))
        marks.append(int(toxic))
    return texts, marks


@pytest.fixture(scope="module")
def model():
    return toxicity.fit(*corpus(900, 1))


def test_held_out_texts_are_told_apart(model):
    texts, marks = corpus(300, 2)  # other words, the same insults
    scores = toxicity.Scorer(model).scores(texts)
    wrong = sum((s >= toxicity.THRESHOLD) != bool(m) for s, m in zip(scores, marks))
    assert wrong <= 6
    assert ((scores >= 0) & (scores <= 1)).all()


def test_odd_texts_have_a_low_score(model):
    scores = toxicity.Scorer(model).scores([None, "", " \n", "the", "x" * 100_000, "ordinary " * 30_000])
    assert (scores < toxicity.THRESHOLD).all() and scores[0] == scores[1] == scores[2]


def test_bounded_store_changes_nothing(model, monkeypatch):
    texts, _ = corpus(60, 3)
    whole = toxicity.Scorer(model).scores(texts)
    monkeypatch.setattr(toxicity, "HELD_WINDOWS", 20)
    scorer = toxicity.Scorer(model)
    assert [s for t in texts for s in scorer.scores([t])] == whole.tolist()


def test_one_class_only_scores_its_share():
    for marks in ([0, 0], [1, 1], []):
        scores = toxicity.Scorer(toxicity.fit(["a b", "c"][: len(marks)], marks)).scores(["a b", None])
        assert scores[0] == scores[1] and 0 < scores[0] < 1


def test_rows_and_training_split(spark):
    texts, marks = corpus(700, 4)
    docs = spark.createDataFrame([*((i, t, "s") for i, t in enumerate(texts)), (3, texts[3], "s"), (None, texts[0], None), (900, None, "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([*((i, 1, m) for i, m in enumerate(marks)), (5, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(got) == len(texts) + 3
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert r.predicted == int(r.score >= 0.3)
    unseen = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 700]
    assert sum(r.predicted == marks[r.doc_id] for r in unseen) >= 0.97 * len(unseen)
    empty = docs.limit(0)
    assert toxicity.score(empty, toxicity.train(empty, labels.limit(0))).count() == 0


def plain_score(model, text):
    """Words by hand, every window compressed by itself with either dictionary, the curve over the savings."""
    words, now = [], ""
    for c in (text or "").lower() + " ":
        if c.isalnum():
            now += c
        elif now:
            words.append(now)
            now = ""
    saved = []
    for word in words:
        window = b" " + word.encode() + b" " + bytes(range(1, 25))
        sizes = []
        for content in (model.ordinary, model.toxic):
            params = zstandard.ZstdCompressionParameters(compression_level=3, strategy=zstandard.STRATEGY_LAZY2, min_match=4, window_log=16, hash_log=15, chain_log=15, search_log=5, target_length=32, write_content_size=0, write_checksum=0, write_dict_id=0)
            known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(compression_params=params)
            sizes.append(len(zstandard.ZstdCompressor(dict_data=known, compression_params=params).compress(window)))
        saved.append(sizes[0] - sizes[1])
    saved.sort(reverse=True)
    x = (saved[0], sum(max(0, s) for s in saved[:3]) / 3) if saved else (0, 0)
    return 1 / (1 + math.exp(-max(-40, min(40, x[0] * model.weights[0] + x[1] * model.weights[1] + model.weights[2]))))


def test_scores_as_their_definition(model):
    texts, _ = corpus(6, 9)
    odd = ["", None, "Zounds!", "the KNAVE, and a blackguard.", "word " * 3, "12 -- 5"]
    assert toxicity.Scorer(model).scores(texts + odd).tolist() == pytest.approx([plain_score(model, t) for t in texts + odd])


def test_marks_around_words_do_not_change_a_score(model):
    texts, _ = corpus(40, 6)
    marked = [t.replace(" ", ", ") + "!" for t in texts]
    assert toxicity.Scorer(model).scores(marked).tolist() == toxicity.Scorer(model).scores(texts).tolist()
