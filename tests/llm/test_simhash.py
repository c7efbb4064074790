import random

import numpy as np
import xxhash

from regolith.llm import simhash


def plain_fingerprint(text, shingle=3):
    raw = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    words, word = [], b""
    for b in raw + b" ":
        if b == 32 or 9 <= b <= 13:
            words += [word] if word else []
            word = b""
        else:
            word += bytes([b])
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << k for k in range(64) if sum(h >> k & 1 for h in hashes) * 2 > len(hashes))


def plain_components(rows):
    """{doc_id: smallest id reachable}, all pairs compared."""
    fps = {i: f for i, f in rows}
    ids, seen = sorted(fps), {}
    for i in ids:
        if i in seen:
            continue
        seen[i], stack = i, [i]
        while stack:
            a = stack.pop()
            for b in ids:
                if b not in seen and bin(fps[a] ^ fps[b]).count("1") <= 3:
                    seen[b] = i
                    stack.append(b)
    return seen


TEXTS = ["", None, " \t\n", "One", "one two", "a b c", "A  b\tC", "x\x0by z w", "é É a", "word " * 400, "a b c d e f g " * 9]


def test_fingerprint_is_the_plain_one():
    for text in TEXTS:
        assert simhash.fingerprint(text) % 2**64 == plain_fingerprint(text)


def test_chain_keys_miss_no_pair(spark):
    """Turned bits anywhere on the ring, and a hot bucket that is dealt into blocks."""
    rng = random.Random(5)
    fps = set()
    for _ in range(60):
        base = rng.getrandbits(64)
        fps.add(base)
        for n in (1, 2, 3, 3, 4, 5):
            fps.add(base ^ sum(1 << b for b in rng.sample(range(64), n)))
    hot = rng.getrandbits(64) & ~0xFFFF
    fps |= {hot | low for low in range(0, 300)}
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    simhash.BLOCK_ROWS, old = 64, simhash.BLOCK_ROWS
    try:
        got = {r.node: r.component for r in simhash.link_fingerprints(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    finally:
        simhash.BLOCK_ROWS = old
    want = plain_components([(f, f % 2**64) for f in signed])
    assert {f: got.get(f, f) for f in signed} == want


def test_near_duplicates_whole(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(500)]
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "One")]
    for g in range(12):
        base = [rng.choice(words) for _ in range(600)]
        for c in range(4):
            copy = list(base)
            for _ in range(c):
                copy[rng.randrange(600)] = "changed"
            rows.append((100 + g * 10 + c, " ".join(copy)))
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, fp int, component_id string")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    want = plain_components([(i, plain_fingerprint(t)) for i, t in rows])
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.fp % 2**64 for r in got} == {i: plain_fingerprint(t) for i, t in rows}


def test_nulls_and_empty_table(spark):
    df = spark.createDataFrame([(None, None), (4, ""), (None, "only here")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in simhash.near_duplicates(df).collect())
    assert got == [(-1, -1), (-1, 4), (4, 4)]
    assert simhash.near_duplicates(df.limit(0)).count() == 0
