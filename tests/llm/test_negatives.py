import math

import duckdb
import numpy as np
import pytest

from regolith.llm import negatives

SIZE = 12


def brute(rows, positives=5, most=3):
    """The contract, row by row in exact integers."""
    kept = []
    for i, v, label in rows:
        if i is None or label is None or v is None or len(v) != SIZE or any(c is None or not math.isfinite(c) for c in v):
            continue
        kept.append((i, [math.floor(256 * float(c)) for c in v], label))
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for n, (i, v, label) in enumerate(kept):
        if i % 50:
            continue
        own = sorted(((-dot(v, w), j) for m, (j, w, other) in enumerate(kept) if m != n and other == label))[:positives]
        others = sorted((-dot(v, w), j) for j, w, other in kept if other != label)
        for s, j in own:
            fit = [(-t, k) for t, k in others if 50 * -s <= 100 * -t <= 95 * -s][:most]
            out += [(i, j, r + 1, k, -s, t) for r, (t, k) in enumerate(fit)]
    return sorted(out)


def data(n=700, seed=1, scale=1.0):
    """Clusters, copies, one hot group of equal vectors, ties, and rows that take no part."""
    rng = np.random.default_rng(seed)
    made = []
    while len(made) < n:
        base = rng.standard_normal(SIZE)
        for noise in (0, 0, 0.05, 0.2, 0.4, 0.4, 0.6, 0.6, 0.8):
            x = base + noise * rng.standard_normal(SIZE)
            made.append(((scale * x / np.linalg.norm(x)).astype(np.float32).tolist(), int(rng.integers(4))))
    made = made[:n] + [(made[0][0], k % 5) for k in range(200)] + [([0.0] * SIZE, 1), ([0.0] * SIZE, 2)]
    made += [(None, 1), ([], 1), ([float("nan")] * SIZE, 1), ([None] * SIZE, 0), ([float("-inf")] + [1.0] * (SIZE - 1), 0), ([1.0, 2.0], 0), (made[0][0], None)]
    ids = rng.permutation(len(made)).tolist()
    rows = [(i, v, label) for i, (v, label) in zip(ids, made)]
    return rows + [(None, made[1][0], 0), (0, made[3][0], 1), (50, made[0][0], 0), (50, made[0][0], 0), (-50, made[5][0], 2)]


def mined(spark, rows):
    df = spark.createDataFrame([(*r, 9) for r in rows], "vec_id long, embedding array<float>, label int, rank int").repartition(3)
    return sorted(map(tuple, negatives.mine(df, negatives.F.col("vec_id") % 50 == 0).collect()))


@pytest.mark.parametrize("sizes", [(4096, 256, 1024, 32), (40, 8, 3, 4)])
def test_as_brute_force(spark, monkeypatch, sizes):
    for name, size in zip(("BLOCK_ROWS", "LEAF_ROWS", "PACK", "FANOUT"), sizes):
        monkeypatch.setattr(negatives, name, size)
    rows = data()
    got = mined(spark, rows)
    assert got == brute(rows)
    assert len(got) > 200


def test_large_integers_and_few_rows(spark):
    rows = data(150, 2, 1e6)  # squares of over 52 bits
    assert mined(spark, rows) == brute(rows)
    few = [(50, [1.0] * SIZE, 1), (1, [1.0] * SIZE, 1), (2, [0.6] * SIZE, 0), (3, [0.96] * SIZE, 0), (100, [1.0] * SIZE, 7)]
    assert mined(spark, few) == brute(few) == [(50, 1, 1, 2, SIZE * 256**2, SIZE * 256 * 153)]
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert negatives.mine(empty, negatives.F.col("vec_id") % 50 == 0).collect() == []


def test_no_subtree_is_left_out_wrongly():
    rng = np.random.default_rng(3)
    x = np.rint(np.repeat(200 * rng.standard_normal((100, 5)), 30, axis=0) + 10 * rng.standard_normal((3000, 5)))
    square = float(np.einsum("nd,nd->n", x, x).max())
    tree = negatives.Tree(square, x, negatives._lift(x, square), 50, 10_000)
    assert tree.leaves > 40 and len(np.unique(tree.rows)) == tree.leaves
    assert (tree.descend(x, negatives._lift(x, square)) == tree.rows).all()
    q = x[:40]
    scores = q @ x.T
    norm = np.einsum("nd,nd->n", q, q)
    high, low = np.quantile(scores, 0.999, axis=1), np.quantile(scores, 0.99, axis=1)
    near, far = negatives._radius(norm, square, high), negatives._radius(norm, square, low)
    met = np.zeros((len(q), tree.leaves), bool)
    for leaf, at in tree.visit(q, np.arange(len(q)), near, far):
        met[at, leaf] = True
    inside = (scores >= low[:, None]) & (scores <= high[:, None])
    for i, j in zip(*np.nonzero(inside)):
        assert met[i, tree.rows[j]]
    assert met.mean() < 0.6  # and many are


def test_query_and_sql(spark):
    folder = "/root/testdata/sf0.001"
    got = sorted(map(tuple, negatives.op12_negatives(spark, folder).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))
    db = duckdb.connect()
    db.execute(f"create view embeddings as select * from '{folder}/embeddings.parquet'")
    want = sorted(db.execute(f"select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from ({negatives.OP12_SQL})").fetchall())
    assert got == want and len(got) > 20
