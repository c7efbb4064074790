import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from regolith.llm import resample


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def buckets(text):
    w = words(text)
    return [zlib.crc32(f.encode()) % 10000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]


def brute(rows, target):
    s, t = np.zeros(10000), np.zeros(10000)
    for _, text in rows:
        np.add.at(s, buckets(text), 1)
    for text in target:
        np.add.at(t, buckets(text), 1)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + 10000) / ((s[b] + 1) * (t.sum() + 10000)))) for b in range(10000)]
    out = []
    for i, text in rows:
        found = buckets(text)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words(text))])
    fit = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2], r[1]))
    for n, r in enumerate(fit[: 25 * len(fit) // 100]):
        r[4] = n + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def data():
    rng = random.Random(2)
    vocabulary = ["a", "The", "ÄÖ", "x1", "日本", "naïve", "zz" * 40, "Lava", "crater", "7", "😀", "stop"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "\x00", "-", "  "]) for _ in range(n))
    rows = [(i, text(rng.randrange(0, 60))) for i in range(900)]
    rows += [(1000 + i, rows[5][1] + " lava crater" * 9) for i in range(300)]  # copies
    rows += [(None, text(40)), (None, text(50)), (7, text(30)), (7, rows[7][1]), (2000, None), (2001, ""), (2002, "..."), (-3, text(25)), (2003, " ".join(f"w{i % 977}" for i in range(50_000)))]
    return rows, [text(30) + " lava crater lava" for _ in range(40)] + [None]


def run(spark, rows, target, **how):
    docs = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, rank int, weight string").repartition(3)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    return sorted(map(tuple, resample.resample(docs, goal, **how).collect()), key=str)


def test_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(resample, "CHUNK", 1000)
    rows, target = data()
    want = brute(rows, target)
    got = run(spark, rows, target)
    assert got == want and sum(r[4] is not None for r in got) > 100


@pytest.mark.parametrize("margin", [1e-9, 0.3, 5.0])
def test_cutoff_from_any_bracket(spark, margin):
    rng = random.Random(4)
    rows = [(rng.randrange(300), 0, 0, rng.choice([1, 2, 2, 2, 9]) * rng.randrange(3)) for _ in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, n_features long, weight long, score long").repartition(5)
    order = sorted(rows, key=lambda r: (-r[3], r[0]))
    for k in (1, 499, 1000, 2000):
        assert resample.cutoff(df, k, 2000, margin) == (order[k - 1][3], order[k - 1][0])


def test_crc_of_joined_words():
    rng = random.Random(6)
    pairs = [(rng.randbytes(rng.choice([0, 1, 5, 300])), rng.randbytes(rng.choice([0, 1, 2, 9, 1000, 70_000]))) for _ in range(60)]
    first, second = (np.array([zlib.crc32(p[i]) for p in pairs], np.uint32) for i in (0, 1))
    got = resample.joined_crc(first, second, np.array([len(b) for _, b in pairs]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in pairs]
    assert resample.word_lists(pa.array(["", "..", "A b"]))[1].tolist() == [0, 0, 2]


def test_empty_tables(spark):
    rows, target = data()
    assert run(spark, [], target) == []
    assert run(spark, rows[:80], []) == brute(rows[:80], [])
    assert all(r[4] is None for r in run(spark, rows[:3], target))


def test_query_and_sql(spark):
    folder = "/root/testdata/sf0.001"
    got = resample.op13_resample(spark, folder)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    want = db.execute(f"select doc_id, n_features, weight, score, rank from ({resample.OP13_SQL})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
