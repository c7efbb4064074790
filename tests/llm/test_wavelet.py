import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from regolith.llm import wavelet
from regolith.llm.pieces import Store

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("size,top", [(0, 1), (1, 1), (64, 2), (1000, 50257), (4097, 70000), (3000, 5)])
def test_shard_answers_as_the_plain_sequence(size, top):
    rng = np.random.default_rng(size)
    seq = rng.integers(0, top, size)
    shard = wavelet.Shard(wavelet.pack(np.array([3, 9]), np.array([size, 0]), seq))
    assert shard.tokens().tolist() == seq.tolist()
    assert shard.access(np.arange(size)).tolist() == seq.tolist()
    places = rng.integers(0, size + 1, 40)
    for token in {0, 1, top - 1, top + 5, 2**20, *seq[:4].tolist()}:
        assert shard.rank(token, places).tolist() == [int((seq[:p] == token).sum()) for p in places]
        assert shard.count(token) == int((seq == token).sum())
        assert shard.occurrences(token).tolist() == np.flatnonzero(seq == token).tolist()
    assert shard.doc_ids.tolist() == [3, 9] and shard.counts.tolist() == [size, 0]


def test_not_a_shard():
    with pytest.raises(ValueError):
        wavelet.Shard(b"PNG....")


def corpus():
    rng = random.Random(2)
    marks = ["the", "hetion", "ing", ",", ".", "  ", "\n", "12", "ñ", "'s", "　", "|", "<|endoftext|>", "🎉"]
    odd = ["", None, " ", "a  b", " a ", "\x85 x", "a\x1c b", "日本 語", "x" * 5000]
    return odd + ["".join(rng.choice(marks) + rng.choice([" ", "", " "]) for _ in range(rng.randrange(120))) for _ in range(200)]


@pytest.mark.parametrize("added", [False, True])
def test_encoder_as_the_library(monkeypatch, added):
    own = Tokenizer.from_file(PATH)
    own.encode_special_tokens = not added
    monkeypatch.setattr(wavelet, "HELD_PIECES", 60)
    monkeypatch.setattr(wavelet, "HELD_WORDS", 60)
    encoder, texts = wavelet.Encoder(PATH, added), [t or "" for t in corpus()]
    for k in range(0, len(texts), 20):
        ids, counts = encoder.encode(pa.array(texts[k : k + 20]))
        got = [ids[e - n : e].tolist() for e, n in zip(np.cumsum(counts), counts)]
        assert got == [own.encode(t, add_special_tokens=False).ids for t in texts[k : k + 20]]


def as_the_library(batches):
    own = Tokenizer.from_file(PATH)
    encoder = wavelet.Encoder(PATH, True)
    for batch in batches:
        ids, counts = encoder.encode(batch)
        got = [ids[e - n : e].tolist() for e, n in zip(np.cumsum(counts), counts)]
        assert got == [own.encode(t or "", add_special_tokens=False).ids for t in batch.to_pylist()]


def test_only_distinct_words_are_looked_up(monkeypatch):
    """40 words with 30 marks each are 70 words of the pattern; looking up all 1200 pieces of them took most of the time."""
    asked, of = [], Store.of
    monkeypatch.setattr(Store, "of", lambda self, names: asked.extend(names) or of(self, names))
    words = ["".join(p) for p in itertools.islice(itertools.product(["ion", "the", "ñu", "日"], repeat=3), 40)]
    marks = ["".join(p) for p in itertools.islice(itertools.product(",.!?)", repeat=3), 30)]
    text = " ".join(f"{w}{m}" for w in words for m in marks)
    as_the_library([pa.array([text, text.replace(" ", "\n")])])
    assert len(asked) < 4 * (len(words) + len(marks))


def test_pieces_of_any_kind_and_place():
    whole = ["e\u0301a, b", "don't 'tis", "Head, tail", "\nfirst", "a\nword, \n b", "x\n,y\n", "ǅ ⅳ ª, ʰ.", "w, w. w\nw, w", "1 2,\n3", " ", "", None]
    odd, plain, none = ["1 2 3\n4", "5\n6 ,"], ["a b, c", "d\ne."], ["", None]
    array = pa.array(whole + odd)
    as_the_library([array, array.slice(3, 7), pa.array(odd), pa.array(plain), pa.array(none), array.slice(0, 0), pa.array(plain).slice(1)])


@pytest.mark.parametrize("size", [63, 200, 201, 1000])
def test_planes_are_split_in_runs(monkeypatch, size):
    seq = np.random.default_rng(size).integers(0, 70_000, size)
    whole = wavelet.pack(np.array([1]), np.array([size]), seq)
    monkeypatch.setattr(wavelet, "RUN", 100)
    assert wavelet.pack(np.array([1]), np.array([size]), seq) == whole
    assert wavelet.Shard(whole).tokens().tolist() == seq.tolist() == wavelet.Shard(whole).access(np.arange(size)).tolist()


def test_rank_and_access_over_many_samples():
    rng = np.random.default_rng(5)
    seq = np.where(rng.random(70_000) < 0.4, 3, rng.integers(0, 900, 70_000))
    shard = wavelet.Shard(wavelet.pack(np.array([1]), np.array([len(seq)]), seq))
    places = np.sort(rng.integers(0, len(seq) + 1, 500))
    assert (shard.access(np.minimum(places, len(seq) - 1)) == seq[np.minimum(places, len(seq) - 1)]).all()
    for token in (3, 17, 899):
        assert (shard.rank(token, places) == np.searchsorted(np.flatnonzero(seq == token), places)).all()
        assert (shard.occurrences(token) == np.flatnonzero(seq == token)).all()


def test_files_round_trip(spark, tmp_path):
    own = Tokenizer.from_file(PATH)
    own.encode_special_tokens = True
    texts = corpus()
    ids = random.Random(4).sample(range(-50, 10**6), len(texts))
    rows = [*zip(ids, texts), (ids[3], "again"), (None, "no id")]
    df = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, start int").repartition(5)
    wavelet.write_shards(df.select("doc_id", "text"), PATH, str(tmp_path / "s"), shard_tokens=300)
    got = sorted(wavelet.read_shards(spark, str(tmp_path / "s")).collect(), key=lambda r: r.start)
    assert len(got) == len(rows)
    begin, last = 0, None
    for r in got:
        assert r.start == begin
        assert last is None or last <= r.doc_id
        begin, last = begin + r.n_tokens, r.doc_id
    want = set()
    for i, t in rows:
        raw = np.array([*own.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        want.add((i, len(raw) // 4, zlib.crc32(raw)))
    assert {(r.doc_id, r.n_tokens, r.ids_crc32) for r in got} == want


def test_empty_table(spark, tmp_path):
    wavelet.write_shards(spark.createDataFrame([], "doc_id long, text string"), PATH, str(tmp_path / "s"))
    assert wavelet.read_shards(spark, str(tmp_path / "s")).count() == 0


def test_query_as_the_unmodified_library(spark, tmp_path):
    own, literal = Tokenizer.from_file(PATH), "<|endoftext|>"
    assert own.encode(literal, add_special_tokens=False).ids == [own.token_to_id(literal)]
    texts = [*corpus(), literal, f"a {literal} b", f"a{literal}{literal}\n", f"<|endoftext{literal}", "<|endoftext|", f" {literal}  x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got, start = {r.doc_id: r for r in wavelet.op10_wavelet(spark, str(tmp_path)).collect()}, 0
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        raw = np.array([*own.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(raw) // 4, zlib.crc32(raw)), t
        assert got[i].n_end_ids == int((np.frombuffer(raw, "<u4") == 0).sum())
        start += len(raw) // 4
