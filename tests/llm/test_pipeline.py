import hashlib
import random

import corpus_pipeline
from pyspark.sql import functions as F
from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_mixing import brute as brute_mix
from tests.llm.test_simhash import plain_components, plain_fingerprint

from regolith.llm import lines, mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PARTS = {"en": ["the", "ion", "ing", "and", "th", "er"], "fr": ["que", "eau", "ère", "tion", "les", "ou"]}


def documents():
    rng = random.Random(12)
    rows = []
    for i in range(160):
        lang = rng.choice(["en", "fr"])
        words = ["".join(rng.choice(PARTS[lang]) for _ in range(rng.randrange(1, 5))) for _ in range(rng.choice([3, 60, 400]))]
        text = " ".join(words) + rng.choice(["", "\nshared boilerplate line", "\nown line\n"])
        rows.append((i, text, lang if rng.random() < 0.9 else None, rng.choice(["a", "a", "b"]), len(text)))
    rows += [(200 + i, rows[i][1], rows[i][2], "b", rows[i][4]) for i in range(30)]
    rows += [(300, None, "en", "a", None), (301, "12 %% --", None, None, 8), (302, "", "fr", "a", 0), (303, "шщю жщ " * 60, None, "b", 1)]
    return rows


def test_stages_as_brute_force(spark):
    docs = spark.createDataFrame(documents(), SCHEMA)
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES:
        steps.append(stage(spark, steps[-1], "unused").cache())
        if name != "encode":
            assert steps[-1].columns == docs.columns
    first, kept, deduped, alone, mixed, coded = (s.collect() for s in steps)

    assert {r.doc_id for r in first} - {r.doc_id for r in kept} == {300, 301, 302, 303}
    assert all(r.lang is not None for r in kept)

    want = {i: t for i, t, _, _ in brute_lines([(r.doc_id, r.source, r.text) for r in kept], lines.RATIO, lines.LEAST_PAGES)}
    assert {r.doc_id: r.text for r in deduped} == want and all(r.n_chars == len(r.text) for r in deduped)
    assert any("shared" in r.text for r in kept) and not any("shared" in r.text for r in deduped)

    found = plain_components([(r.doc_id, plain_fingerprint(r.text)) for r in deduped])
    assert {r.doc_id for r in alone} == set(found.values()) and len(alone) == len(set(found.values()))

    rows = [(r.doc_id, r.source, r.lang, r.text) for r in alone]
    assert {r.doc_id for r in mixed} == {r[0] for r in brute_mix(rows, mixing.Mix())[0] if r[5]}

    texts = {r.doc_id: r.text for r in mixed}
    assert {r.doc_id: r.decoded_sha256 for r in coded} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items()}


def test_repeated_and_missing_ids(spark):
    rows = [(1, "a b c d", "en", "s", 7), (1, "a b c d", "en", "s", 7), (2, "a b c d", "en", "s", 7), (None, "x y z w", "en", "s", 7), (None, "a b c d", "en", "s", 7)]
    got = corpus_pipeline.simhash_dedup(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got)[:1] == [(False, 1)] and sum(r.doc_id == 1 for r in got) == 1


def test_rows_that_repeat_an_id_with_other_texts(spark):
    """Each text is a document of its own: copies go by their text, and no unique text is lost."""
    rows = [(1, "aa bb cc dd"), (5, "aa bb cc dd"), (5, "something else entirely here"), (5, "and now for a third one"), (9, "and now for a third one"), (None, "no id at all here"), (None, "no id at all here"), (None, "another one without any")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.simhash_dedup(spark, df, "").collect()), key=str)
    assert got == sorted([(1, "aa bb cc dd"), (5, "something else entirely here"), (5, "and now for a third one"), (None, "no id at all here"), (None, "another one without any")], key=str)


def test_clashing_columns_and_empty_table(spark):
    docs = spark.createDataFrame(documents(), SCHEMA).withColumns({c: F.lit(1) for c in ("rejected", "score", "lines", "prob", "topic", "fp", "mark", "_mark", "root_fp")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.count() > 0
        assert stage(spark, docs.limit(0), "").count() == 0


def test_large_groups_of_copies_keep_one(spark):
    """Two groups of copies, each far over the ratio of its source, leave one whole text each."""
    rng = random.Random(21)

    def prose():
        return "\n".join(" ".join("".join(rng.choice(PARTS["en"]) for _ in range(4)) for _ in range(12)) for _ in range(6))

    copies = {"a": prose(), "b": prose()}
    rows = [(1000 * (s == "b") + k, copies[s], "en", s, len(copies[s])) for s in copies for k in range(30)]
    rows += [(5000 + k, prose() + "\nmenu of the site", "en", "ab"[k % 2], 0) for k in range(60)]
    deduped = corpus_pipeline.line_dedup(spark, spark.createDataFrame(rows, SCHEMA), "").cache()
    got = {r.doc_id: r.text for r in deduped.collect()}
    assert all(got[i] == t for i, t, *_ in rows if i < 5000)
    assert not any("menu" in t for t in got.values()) and all(got.values())
    alone = corpus_pipeline.simhash_dedup(spark, deduped, "").collect()
    assert [sum(r.text == t for r in alone) for t in copies.values()] == [1, 1]
