import numpy as np
import pytest

from regolith.llm import embedding


def brute(rows):
    """{row place: (links, component)} of (vec_id, vector, label)."""
    unit, ok = [], []
    for i, v, label in rows:
        x = np.array([np.nan if c is None else c for c in v], float) if v is not None else np.array([np.nan])
        fit = i is not None and label is not None and np.isfinite(x).all() and len(x) == 16 and np.linalg.norm(x) > 0
        ok.append(fit)
        unit.append(x / np.linalg.norm(x) if fit else np.zeros(16))
    cosine = np.stack(unit) @ np.stack(unit).T
    labels = [r[2] for r in rows]
    near = [[a != b and ok[a] and ok[b] and labels[a] == labels[b] and cosine[a, b] >= 0.93 for b in range(len(rows))] for a in range(len(rows))]
    out = {}
    for a in range(len(rows)):
        seen, stack = {a}, [a]
        while stack:
            x = stack.pop()
            for b in np.flatnonzero(near[x]):
                if b not in seen:
                    seen.add(b)
                    stack.append(b)
        ids = [rows[b][0] for b in seen if rows[b][0] is not None]
        out[a] = (sum(near[a]), min(ids) if ids else None)
    return out


def rows():
    rng = np.random.default_rng(7)
    made = []
    for g in range(40):
        base = rng.standard_normal(16)
        for noise in (0, 0, 0.02, 0.05, 0.08, 0.1):
            made.append(((base + noise * rng.standard_normal(16)).astype(np.float32).tolist(), int(g % 3)))
    hot = rng.standard_normal(16)
    made += [((hot + 0.03 * rng.standard_normal(16)).astype(np.float32).tolist(), 1) for _ in range(150)]
    made += [(made[0][0], 2), (None, 1), ([0.0] * 16, 1), ([float("nan")] * 16, 1), ([None] * 16, 0), ([float("inf")] + [1.0] * 15, 0), ([1.0, 2.0], 0), (made[0][0], None), (made[3][0], None)]
    ids = rng.permutation(len(made)).tolist()
    return [(i, v, label) for i, (v, label) in zip(ids, made)] + [(None, made[1][0], 0)]


@pytest.mark.parametrize("block", [1000, 32])
def test_as_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embedding, "BLOCK_ROWS", block)
    data = rows()
    df = spark.createDataFrame([(*r, "kept") for r in data], "vec_id long, embedding array<float>, label int, n_links string")
    got = embedding.near_duplicates(df, recall=0.9999).collect()
    want = brute(data)
    assert len(got) == len(data)
    wanted = {data[a][0]: w for a, w in want.items()}
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == wanted
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)


def test_recall_as_shipped(spark):
    data = rows()
    got = {r.vec_id: r.n_links for r in embedding.near_duplicates(spark.createDataFrame([(*r,) for r in data], "vec_id long, embedding array<float>, label int")).collect()}
    want = {data[a][0]: w[0] for a, w in brute(data).items()}
    assert all(got[i] <= want[i] for i in want) and sum(got.values()) >= embedding.RECALL * sum(want.values())


def test_ids_that_repeat_with_other_vectors(spark):
    near, far = [1.0, 0.0, 0.1], [0.0, 1.0, 0.0]
    data = [(1, [1.0, 0.0, 0.0], 1), (1, near, 1), (2, [1.0, 0.05, 0.0], 1), (3, [1.0, 0.0, 0.05], 1), (7, far, 1), (7, [0.0, 0.0, 1.0], 1), (4, near, 2)]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embedding.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")).collect())
    assert got == [(1, 3, 1), (1, 3, 1), (2, 3, 1), (3, 3, 1), (4, 0, 4), (7, 0, 7), (7, 0, 7)]


def test_very_large_and_very_small_components(spark):
    data = [(1, [1e200, 1e200], 0), (2, [1e-200, 1e-200], 0), (3, [3.0, 3.0], 0), (4, [-1e300, 1e300], 0), (5, [0.0, -0.0], 0)]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embedding.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")).collect())
    assert got == [(1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 0, 4), (5, 0, 5)]


def test_repeated_rows_and_empty_table(spark):
    schema = "vec_id long, embedding array<float>, label int"
    df = spark.createDataFrame([(5, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (2, [2.0, 0.0], 1)], schema)
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in embedding.near_duplicates(df).collect()) == [(2, 2, 2), (5, 2, 2), (5, 2, 2)]
    assert embedding.near_duplicates(df.limit(0)).count() == 0


def test_plan_reaches_the_recall():
    how = embedding.plan(5000, 64)
    rng = np.random.default_rng(0)
    a = rng.standard_normal((3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((3000, 64))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    near = 0.93 * a + np.sqrt(1 - 0.93**2) * b
    assert (how.keys(a) == how.keys(near)).any(axis=1).mean() > 0.985
    assert (how.keys(a) == how.keys(b)).mean() < 4 / 5000
