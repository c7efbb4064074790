import hashlib
import random
from collections import defaultdict

import pytest

from regolith.llm import mixing


def docs(spark, n=600):
    rng = random.Random(6)
    rows = []
    for i in range(n):
        source = "big" if i % 3 else rng.choice(["s1", "s2", "s3", None])
        text = rng.choice(["a b c ", "x | y ", "word \t\n", "under License z "]) * rng.choice([1, 20, 300, 1200])
        rows.append((i, source, rng.choice(["en", "en", "fr", None]), text))
    rows += [(3, "big", "en", "again"), (None, "s1", "fr", "no id"), (9000, "s1", "fr", None), (9001, "only empty", "zz", "")]
    return rows, spark.createDataFrame([(*r, "old") for r in rows], "doc_id long, source string, lang string, text string, prob string")


def brute(rows, mix):
    def cell(r):
        t = r[3] or ""
        topic = "table" if " | " in t else "licence" if "license" in t.lower() else "note" if len(t) < 400 else "long" if len(t) >= 4000 else "prose"
        return r[1] or "(none)", r[2] or "(none)", topic

    tokens = defaultdict(float)
    for r in rows:
        tokens[cell(r)] += len((r[3] or "").split())
    total = sum(tokens.values())
    weight = {c: n / total for c, n in tokens.items()}
    targets = []
    for d in range(3):
        by = defaultdict(float)
        for c, n in tokens.items():
            by[c[d]] += n
        p = {v: n**mix.flatten for v, n in by.items()}
        targets.append({v: x / sum(p.values()) for v, x in p.items()})
    for _ in range(mix.sweeps):
        for d in range(3):
            sums = defaultdict(float)
            for c, w in weight.items():
                sums[c[d]] += w
            weight = {c: w * targets[d][c[d]] / sums[c[d]] if sums[c[d]] else 0 for c, w in weight.items()}
    rate = {c: weight[c] / (tokens[c] / total) if tokens[c] else 1 for c in weight}
    scale = mix.budget
    for _ in range(mix.steps):
        scale *= mix.budget * total / sum(n * min(1, rate[c] * scale) for c, n in tokens.items())
    prob = {c: min(1, r * scale) for c, r in rate.items()}
    u = lambda i: int(hashlib.md5(f"{mix.seed}:{'null' if i is None else i}".encode()).hexdigest()[:13], 16) / 2**52
    return [(r[0], cell(r)[2], len((r[3] or "").split()), weight[cell(r)], prob[cell(r)], u(r[0]) < prob[cell(r)]) for r in rows], weight, targets, prob, tokens


@pytest.mark.parametrize("most", [200_000, 0])
def test_as_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(mixing, "BROADCAST_CELLS", most)
    rows, df = docs(spark)
    want, weight, targets, prob, tokens = brute(rows, mixing.Mix())
    got = [(r.doc_id, r.topic, r.n_tokens, r.weight, r.prob, r.sampled) for r in mixing.sample(df).collect()]
    key = lambda r: (str(r[0]), r[2])
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert (*g[:3], g[5]) == (*w[:3], w[5]) and g[3:5] == pytest.approx(w[3:5], rel=1e-9)
    for v, share in targets[1].items():
        assert sum(w for c, w in weight.items() if c[1] == v) == pytest.approx(share, abs=0.02)
    assert sum(n * prob[c] for c, n in tokens.items()) == pytest.approx(0.5 * sum(tokens.values()), rel=0.02)


def test_given_targets_hold(spark):
    rows, df = docs(spark)
    cells = mixing.rake(mixing.with_cells(df), mixing.Mix(targets={"lang": {"en": 0.2, "fr": 0.7}}, sweeps=30)).collect()
    by = defaultdict(float)
    for r in cells:
        by[r._lang] += r.weight
    assert by["en"] == pytest.approx(0.2, abs=0.02) and by["fr"] == pytest.approx(0.7, abs=0.02)


def test_empty_table(spark):
    assert mixing.sample(docs(spark, 3)[1].limit(0)).count() == 0
