import base64
import hashlib
import random
import struct

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from regolith.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(3)
    odd = ["", None, " ", "  ", "a", " a", "a ", "a  b", "a\n b", "a \n\nb ", "it's we'll 'tis", "x y", "x\x85 y", "x \x1c y", "日本語 テスト 12³½", "a\tb  c", "<|endoftext|>", "🎉🎉 ok", "\r\n\r\n", "zzzz" * 300, "ab" * 5000, "é" * 700, "日本語のテスト" * 90, "\tx y", "x\n", "\n", "\na b", "a\n\nb c", "a\u3000b c", "end "]
    marks = ["the", "hetion", "ing", ",", ".", " ", "  ", "\n", "12", "ñ", "'s", "Qu", "　", "|", "-" * 9]
    return odd + ["".join(rng.choice(marks) + rng.choice([" ", "", " "]) for _ in range(rng.randrange(200))) for _ in range(150)]


def test_encode_as_the_library_and_back(spark, library):
    rows = [(i, t, "clash") for i, t in enumerate(texts())] + [(0, "twice", "x"), (None, "no id", None)]
    got = bpe.digests(spark.createDataFrame(rows, "doc_id long, text string, ids string"), PATH).collect()
    assert len(got) == len(rows)
    want = set()
    for i, t, _ in rows:
        ids = library.encode_ordinary(t or "")
        raw = struct.pack(f"<{len(ids)}I", *ids)
        want.add((i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), raw))
    assert {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, bytes(r.ids)) for r in got} == want


def coded(lists):
    flat = [i for x in lists for i in x]
    return np.array(flat, np.uint32), np.array([len(x) for x in lists], np.int64)


def lists(ids, counts):
    ends = np.cumsum(counts)
    return [ids[e - n : e].tolist() for e, n in zip(ends, counts)]


def test_bounded_stores_change_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "HELD_WORDS", 50)
    monkeypatch.setattr(bpe, "HELD_PIECES", 40)
    monkeypatch.setattr(bpe, "QUERY_WORDS", 7)
    monkeypatch.setattr(bpe, "BATCH_TOKENS", 100)
    own = bpe.Codec(PATH, PATTERN)
    some = [t or "" for t in texts()]
    for k in range(0, len(some), 5):
        ids = own.encode(pa.array(some[k : k + 5]))
        assert lists(*ids) == [library.encode_ordinary(t) for t in some[k : k + 5]]
        assert own.decode(ids) == [t.encode() for t in some[k : k + 5]]


def test_long_words_by_either_query(library, monkeypatch):
    rng = random.Random(8)
    words = ["".join(rng.choice(some) for _ in range(n)) for some in ("a", "ab", "abethnio", "日本語テスト", "éèàû", "aaab") for n in (2, 3, 30, 85, 700)]
    want = [library._encode_single_piece(w.encode()) for w in words]
    for longest, rows in ((256, bpe.LONG_ROWS), (1, bpe.LONG_ROWS), (1, 1)):
        monkeypatch.setattr(bpe, "LONG_WORD", longest)
        monkeypatch.setattr(bpe, "LONG_ROWS", rows)
        assert lists(*bpe.Codec(PATH, PATTERN)._contract(words)) == want


@pytest.mark.parametrize("longest", [256, 1])
def test_a_pair_of_lower_rank_comes_first(tmp_path, monkeypatch, longest):
    """Contracting "cd" makes "xcd", of lower rank: it must be contracted before the next "cd" is."""
    ranks = {bytes([b]): b for b in range(256)} | {b"xcd": 256, b"dx": 257, b"cdcd": 258, b"cd": 259, b"cdx": 260}
    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % r for t, r in ranks.items()))
    made = tiktoken.Encoding("made", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    words = ["xcdcd", "cdcdcd", "xcdxcdcd", "cdxcdcdxcd", "cccddd", "xcd" * 9 + "cd" * 7]
    monkeypatch.setattr(bpe, "LONG_WORD", longest)
    assert lists(*bpe.Codec(str(path), PATTERN)._contract(words)) == [made._encode_single_piece(w.encode()) for w in words]


def test_every_token_of_the_vocabulary_contracts_to_itself(library):
    own = bpe.Codec(PATH, PATTERN)
    words = [w for t in own.ranks if (w := t.decode("utf-8", "ignore")).encode() == t]
    assert len(words) > 40_000 and lists(*own._contract(words)) == [[own.ranks[w.encode()]] for w in words]


def test_empty_table(spark):
    assert bpe.digests(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_stored_ids_decode(spark, library):
    rows = [(i, struct.pack(f"<{len(x)}I", *x)) for i, x in enumerate(library.encode_ordinary(t or "") for t in texts())] + [(-1, None)]
    got = {r.doc_id: bytes(r.decoded) for r in bpe.decode(spark.createDataFrame(rows, "doc_id long, ids binary"), PATH, PATTERN).collect()}
    assert got == {i: (t or "").encode() for i, t in enumerate(texts())} | {-1: b""}


def test_decoded_shows_wrong_ids(library):
    """A document whose stored ids are wrong, lost or out of order must not decode to the input."""
    own, text = bpe.Codec(PATH, PATTERN), "the ing thing of it all"
    ids, counts = own.encode(pa.array([text]))
    assert own.decode((ids, counts)) == [text.encode()]
    for changed in (ids + np.eye(1, len(ids), 2, dtype=np.uint32)[0], ids[:-1], ids[::-1]):
        plain = own.decode((changed, np.array([len(changed)])))[0]
        assert plain != text.encode() and plain == library.decode_bytes(changed.tolist())
