"""Hard negatives by a multiway hyperplane tree over integer vectors.

Inner products become distances: every vector gets one more coordinate that lifts it to the greatest norm, so that
|q - x|^2 = |q|^2 + M^2 - 2 q.x for an anchor q without that coordinate, and a window of scores is an annulus around the anchor.
A node of the tree has some split points; a row belongs to the nearest one, and the node keeps, for each split point and
each sibling's subtree, the least and the greatest distance between them. A subtree is left out for an anchor if no distance
in its range, for any one of the split points, can meet the anchor's annulus by the triangle inequality; in the leaves that stay
scores are exact.

The upper tree is fitted on a bounded sample of rows, but all rows are dealt into its leaves and its ranges are those of all
rows. A leaf's rows are dealt into blocks of bounded size; each block meets bounded packs of the anchors that visit its
leaf, and is itself a small tree while it does. An anchor's own leaf is searched first: what is found there narrows the annulus
for the others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regolith.functions.lineage import cut
from regolith.llm.common import read

#: Rows, and components of these rows, that the upper tree is fitted on at most.
SAMPLE_ROWS, SAMPLE_VALUES = 4096, 2_000_000
#: Split points of a node, leaves of the upper tree at most, rows of a block, rows of a block's leaf, anchors of a pack.
FANOUT, TRUNK_LEAVES, BLOCK_ROWS, LEAF_ROWS, PACK = 32, 1024, 4096, 256, 1024
#: Squared norms stay below this, so that scores fit a long.
MOST_SQUARE = 2.0**62
LEAST = -(2**63 - 1)


@dataclass
class Node:
    """Split points with their lifts; for each its subtree, a node or the number of a leaf; and from split point i to the rows
    below j the least and greatest distance."""

    points: np.ndarray
    lift: np.ndarray
    kids: list[Node | int]
    low: np.ndarray
    high: np.ndarray


def _far(square: float, x: np.ndarray, lift: np.ndarray, points: np.ndarray, points_lift: np.ndarray) -> np.ndarray:
    """Distances of lifted rows to lifted points: all have the squared norm ``square``."""
    return np.sqrt(np.maximum(2 * square - 2 * (x @ points.T + np.outer(lift, points_lift)), 0.0))


def _split_points(square: float, x: np.ndarray, lift: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` rows that lie far from each other, out of three times as many spread over the rows."""
    tried = np.unique(np.linspace(0, len(x) - 1, 3 * most).astype(int))
    chosen = [tried[0]]
    away = _far(square, x[tried], lift[tried], x[chosen], lift[chosen])[:, 0]
    while len(chosen) < most and away.max() > 1e-5 * np.sqrt(square):
        chosen.append(tried[away.argmax()])
        away = np.minimum(away, _far(square, x[tried], lift[tried], x[chosen[-1:]], lift[chosen[-1:]])[:, 0])
    return np.array(chosen)


class Tree:
    """``rows``: the leaf of each row that it was built from; ``weight`` says for how many rows one of these stands."""

    def __init__(self, square: float, x: np.ndarray, lift: np.ndarray, leaf_rows: int, most_leaves: int, weight: float = 1.0) -> None:
        self.square, self.leaves, self.rows = square, 0, np.zeros(len(x), int)
        self.root = self._grow(x, lift, np.arange(len(x)), leaf_rows / weight, most_leaves)

    def _grow(self, x: np.ndarray, lift: np.ndarray, at: np.ndarray, leaf_rows: float, most: int) -> Node | int:
        chosen = at[:0]
        if len(at) > leaf_rows and most > 1:
            chosen = at[_split_points(self.square, x[at], lift[at], min(FANOUT, most, max(2, int(np.ceil(len(at) / leaf_rows)))))]
        if len(chosen) < 2:  # copies of one vector cannot be split
            self.rows[at] = self.leaves
            self.leaves += 1
            return self.leaves - 1
        far = _far(self.square, x[at], lift[at], x[chosen], lift[chosen])
        own = far.argmin(axis=1)
        kids = [self._grow(x, lift, at[own == j], leaf_rows, most // len(chosen)) for j in range(len(chosen))]
        return Node(x[chosen], lift[chosen], kids, *ranges(far, own))

    def nodes(self, node: Node | int | None = None) -> list[Node]:
        """All nodes, parents first."""
        node = self.root if node is None else node
        return [] if isinstance(node, int) else [node, *(n for kid in node.kids for n in self.nodes(kid))]

    def descend(self, x: np.ndarray, lift: np.ndarray, seen=None) -> np.ndarray:
        """The leaf of each row; ``seen`` is called with each node, its number, the distances there and the children taken."""
        out, numbers = np.zeros(len(x), int), {id(n): i for i, n in enumerate(self.nodes())}
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, at = todo.pop()
            if isinstance(node, int):
                out[at] = node
            elif len(at):
                far = _far(self.square, x[at], lift[at], node.points, node.lift)
                own = far.argmin(axis=1)
                if seen:
                    seen(numbers[id(node)], far, own)
                todo += [(kid, at[own == j]) for j, kid in enumerate(node.kids)]
        return out

    def visit(self, q: np.ndarray, owner: np.ndarray, near: np.ndarray, far: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, annuli that may have rows in it). Annulus i lies around q[owner[i]] from near[i] to far[i]; ``far`` may shrink
        meanwhile."""
        slack = 1e-5 * np.sqrt(self.square)
        norms = np.einsum("nd,nd->n", q, q)
        todo = [(self.root, np.arange(len(owner)))]
        while todo:
            node, at = todo.pop()
            if isinstance(node, int):
                yield node, at
                continue
            some, place = np.unique(owner[at], return_inverse=True)
            d = np.sqrt(np.maximum(norms[some, None] + self.square - 2 * (q[some] @ node.points.T), 0.0))  # anchors have no lift
            least, most = np.empty_like(d), np.empty_like(d)
            for j in range(d.shape[1]):
                least[:, j] = np.maximum(node.low[:, j] - d, d - node.high[:, j]).max(axis=1)
                most[:, j] = (d + node.high[:, j]).min(axis=1)
            alive = (least[place] <= far[at, None] + slack) & (most[place] >= near[at, None] - slack)
            todo += [(kid, at[alive[:, j]]) for j, kid in enumerate(node.kids) if alive[:, j].any()]


def ranges(far: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From each split point to the rows of each: least and greatest distance; inf and -inf for no row."""
    k = far.shape[1]
    low, high = np.full((k, k), np.inf), np.full((k, k), -np.inf)
    for j in np.unique(own):
        low[:, j], high[:, j] = far[own == j].min(axis=0), far[own == j].max(axis=0)
    return low, high


class Best:
    """The ``k`` best (score, id, row) of each of ``n`` annuli: higher scores first, then smaller ids."""

    def __init__(self, n: int, k: int) -> None:
        self.score, self.id, self.row = np.full((n, k), LEAST), np.zeros((n, k), np.int64), np.zeros((n, k), np.int64)

    def offer(self, at: np.ndarray, scores: np.ndarray, fit: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Takes in the rows that fit; ``scores`` are those of the annuli ``at``."""
        k = self.score.shape[1]
        scores = np.where(fit, scores, LEAST)
        floor = self.score[at, -1]
        if scores.shape[1] > k:
            floor = np.maximum(floor, np.partition(scores, -k, axis=1)[:, -k])
        new = fit & (scores >= floor[:, None])
        new &= (scores > self.score[at, -1][:, None]) | (ids[None, :] < self.id[at, -1][:, None])  # equal to the last held: by id
        i, j = np.nonzero(new)
        if not len(i):
            return
        held = at[np.unique(i)]
        which = np.concatenate([at[i], np.repeat(held, k)])
        score = np.concatenate([scores[i, j], self.score[held].ravel()])
        name, row = np.concatenate([ids[j], self.id[held].ravel()]), np.concatenate([rows[j], self.row[held].ravel()])
        order = np.lexsort((row, name, -score, which))
        which = which[order]
        starts = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
        rank = np.arange(len(which)) - np.repeat(starts, np.diff(np.append(starts, len(which))))
        order, which, rank = order[rank < k], which[rank < k], rank[rank < k]
        self.score[which, rank], self.id[which, rank], self.row[which, rank] = score[order], name[order], row[order]


def _matrix(column: pa.ChunkedArray | pa.Array, kind=np.float64) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), len(flat) // max(len(column), 1)).astype(kind)


def _lift(x: np.ndarray, square: float) -> np.ndarray:
    return np.sqrt(np.maximum(square - np.einsum("nd,nd->n", x, x), 0.0))


def _radius(norm: np.ndarray, square: float, score: np.ndarray) -> np.ndarray:
    """Distance from an anchor to a row of that score; of no score, without end."""
    d = np.sqrt(np.maximum(norm + square - 2.0 * score.astype(float), 0.0))
    return np.where(score == LEAST, np.inf, d)


_FOUND = "anchor long, annulus int, score long, vec_id long, row_no long"


def _meet(rows: pa.Table, anchors: pa.Table, square: float, k: int, same: bool) -> pa.Table:
    """The best rows of one block for each annulus of a pack of anchors."""
    names = [f.split()[0] for f in _FOUND.split(", ")]
    if not len(rows) or not len(anchors):
        return pa.table({n: pa.array([], pa.int32() if n == "annulus" else pa.int64()) for n in names})
    rows = rows.sort_by([("vec_id", "ascending"), ("row_no", "ascending")])  # so that ties of a leaf come in order
    x, ids, row_no, label = _matrix(rows["vec"]), *(rows[c].to_numpy() for c in ("vec_id", "row_no", "label"))
    q, own_no, own_label = _matrix(anchors["own_vec"]), *(anchors[c].to_numpy() for c in ("anchor", "own_label"))
    low, high = (anchors[c].combine_chunks() for c in ("lows", "highs"))
    annuli = low.value_lengths().to_numpy()
    owner, number = np.repeat(np.arange(len(q)), annuli), np.concatenate([np.arange(n) for n in annuli])
    low, high = low.flatten().to_numpy().copy(), high.flatten().to_numpy()
    norm = np.einsum("nd,nd->n", q, q)[owner]
    near, far = np.where(high == -LEAST, 0.0, _radius(norm, square, high)), _radius(norm, square, low)
    tree, best = Tree(square, x, _lift(x, square), LEAF_ROWS, len(x)), Best(len(owner), k)
    leaf_rows = np.split(np.argsort(tree.rows, kind="stable"), np.searchsorted(np.sort(tree.rows), np.arange(1, tree.leaves)))
    exact = np.float64 if square < 2.0**52 else np.int64  # sums of products below 2^53 are exact in doubles

    def scan(leaf: int, at: np.ndarray) -> None:
        for a in range(0, len(leaf_rows[leaf]), LEAF_ROWS):
            some = leaf_rows[leaf][a : a + LEAF_ROWS]
            asked, place = np.unique(owner[at], return_inverse=True)
            scores = (q[asked].astype(exact) @ x[some].astype(exact).T).astype(np.int64)[place]
            kin = label[some][None, :] == own_label[owner[at], None]
            fit = (scores >= low[at, None]) & (scores <= high[at, None]) & (kin if same else ~kin)
            if same:
                fit &= row_no[some][None, :] != own_no[owner[at], None]
            best.offer(at, scores, fit, ids[some], row_no[some])
        low[at] = np.maximum(low[at], best.score[at, -1])
        far[at] = np.minimum(far[at], _radius(norm[at], square, low[at]))

    home = tree.descend(q, np.zeros(len(q)))[owner]
    for leaf in np.unique(home):
        scan(int(leaf), np.flatnonzero(home == leaf))
    for leaf, at in tree.visit(q, owner, near, far):
        at = at[home[at] != leaf]
        if len(at):
            scan(leaf, at)
    i, j = np.nonzero(best.score != LEAST)
    out = (own_no[owner[i]], number[i].astype(np.int32), best.score[i, j], best.id[i, j], best.row[i, j])
    return pa.table(dict(zip(names, map(pa.array, out), strict=True)))


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "annulus").orderBy(F.desc("score"), "vec_id", "row_no")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class Index:
    """Rows dealt into the leaves of the upper tree.

    ``rows`` are (row_no, vec_id, label, vec, leaf), with integer vectors of one dimension."""

    def __init__(self, rows: DataFrame) -> None:
        about = rows.agg(F.count("*").alias("n"), F.max(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x)).alias("square"), F.max(F.size("vec")).alias("size")).first()
        self.square = square = max(float(about["square"] or 0.0), 1.0)
        size = about["size"] or 1
        most = max(1, min(SAMPLE_ROWS, SAMPLE_VALUES // size))
        sample = rows.orderBy(F.xxhash64("row_no", "vec"), "row_no").limit(most).select("vec").collect()
        x = np.array([r["vec"] for r in sample], float).reshape(len(sample), size)
        self.tree = tree = Tree(square, x, _lift(x, square), BLOCK_ROWS, TRUNK_LEAVES, max(1.0, about["n"] / max(len(sample), 1)))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                v = _matrix(b.column("vec"))
                yield b.append_column("leaf", pa.array(tree.descend(v, _lift(v, square)).astype(np.int32)))

        self.rows = cut(rows.select("row_no", "vec_id", "label", "vec").mapInArrow(place, "row_no long, vec_id long, label long, vec array<int>, leaf int"))
        self._measure()
        self.blocks = self.rows.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))

    def _measure(self) -> None:
        """Sets the upper tree's ranges to those of all rows: at most one row of the result for each pair of siblings."""
        tree, square = self.tree, self.square

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [(np.full(n.low.shape, np.inf), np.full(n.low.shape, -np.inf)) for n in tree.nodes()]

            def seen(number: int, far: np.ndarray, own: np.ndarray) -> None:
                low, high = ranges(far, own)
                held[number] = np.minimum(held[number][0], low), np.maximum(held[number][1], high)

            for b in batches:
                v = _matrix(b.column(0))
                tree.descend(v, _lift(v, square), seen)
            for n, (low, high) in enumerate(held):
                i, j = np.nonzero(np.isfinite(low))
                columns = np.full(len(i), n), i, j, low[i, j], high[i, j]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["node", "i", "j", "low", "high"])

        parts = self.rows.select("vec").mapInArrow(measure, "node long, i long, j long, low double, high double")
        found = parts.groupBy("node", "i", "j").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()
        for node in tree.nodes():
            node.low, node.high = np.full(node.low.shape, np.inf), np.full(node.high.shape, -np.inf)
        nodes = tree.nodes()
        for r in found:
            nodes[r["node"]].low[r["i"], r["j"]], nodes[r["node"]].high[r["i"], r["j"]] = r["low"], r["high"]

    def _round(self, visits: DataFrame, k: int, same: bool) -> DataFrame:
        """The best rows for anchors (anchor, label, vec, lows, highs, leaf) in their leaf: blocks meet packs."""
        load = visits.groupBy("leaf").agg(F.ceil(F.count("*") / PACK).cast("int").alias("packs")).join(self.blocks, "leaf")
        dealt = lambda salt, key, n: F.pmod(F.xxhash64(F.lit(salt), key), n).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        keys = ["leaf", "block", "pack"]
        spread = int(visits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = self.rows.join(load, "leaf").withColumn("block", dealt(1, "row_no", F.col("blocks"))).withColumn("pack", each("packs"))
        asks = visits.join(load, "leaf").withColumn("pack", dealt(2, "anchor", F.col("packs"))).withColumn("block", each("blocks"))
        rows = rows.select(*keys, "row_no", "vec_id", "label", "vec").repartition(spread, *keys)
        asks = asks.select(*keys, "anchor", F.col("label").alias("own_label"), F.col("vec").alias("own_vec"), "lows", "highs").repartition(spread, *keys)
        square = self.square
        return rows.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInArrow(lambda r, a: _meet(r, a, square, k, same), _FOUND)

    def search(self, anchors: DataFrame, k: int, same: bool) -> DataFrame:
        """(anchor, annulus, rank, score, vec_id): for every anchor (anchor, label, vec, home, lows, highs) and each of its
        windows of scores the ``k`` best rows of the same label, itself left out, or of other labels."""
        tree, square = self.tree, self.square
        first = cut(_best(self._round(anchors.withColumn("leaf", F.col("home")), k, same), k))
        full = first.groupBy("anchor", "annulus").agg(F.count("*").alias("n"), F.min("score").alias("bound")).where(F.col("n") == k)
        bounds = full.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("annulus", "bound"))).alias("bounds"))
        narrowed = anchors.join(bounds, "anchor", "left").withColumn("lows", F.transform("lows", lambda x, i: F.greatest(x, F.try_element_at("bounds", i)))).drop("bounds")

        def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not len(b):
                    continue
                q, low, high = _matrix(b.column("vec")), b.column("lows"), b.column("highs")
                owner = np.repeat(np.arange(len(q)), low.value_lengths().to_numpy())
                low, high = low.flatten().to_numpy(), high.flatten().to_numpy()
                norm = np.einsum("nd,nd->n", q, q)[owner]
                near, far = np.where(high == -LEAST, 0.0, _radius(norm, square, high)), _radius(norm, square, low)
                met: list[list[int]] = [[] for _ in q]
                for leaf, at in tree.visit(q, owner, near, far):
                    for i in np.unique(owner[at]):
                        met[i].append(leaf)
                yield b.append_column("leaves", pa.array(met, pa.list_(pa.int32())))

        schema = "anchor long, label long, vec array<int>, home int, lows array<long>, highs array<long>"
        far = narrowed.select("anchor", "label", "vec", "home", "lows", "highs").mapInArrow(visits, schema + ", leaves array<int>")
        far = cut(far.withColumn("leaf", F.explode("leaves")).where("leaf <> home").drop("leaves"))
        return _best(first.drop("rank").unionByName(self._round(far, k, same)), k)


def integer_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(row_no, vec_id, label, vec) of the rows that take part: components times ``scale``, floored."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & sound).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("vec")
    )
    square = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows = rows.withColumn("size", F.size("vec")).where((F.col("size") > 0) & (square < MOST_SQUARE))
    usual = rows.groupBy("size").count().orderBy(F.desc("count"), "size").limit(1).select("size")
    fit = rows.join(F.broadcast(usual), "size", "left_semi").select("vec_id", "label", F.col("vec").cast("array<int>").alias("vec"))
    return cut(fit.withColumn("row_no", F.monotonically_increasing_id()))  # fixed from here on


def mine(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``vectors`` (vec_id, embedding, label):
    for each row where ``anchor`` (of vec_id) holds and each of its best other rows of its label, the best rows of other labels
    whose score lies between ``low`` and ``high`` hundredths of the positive's. Scores are inner products of integer vectors;
    ties go to the smaller vec_id.

    Rows with a null vec_id or label, with a vector that is null or empty, holds null or non-finite components or is of another
    dimension than most, or whose scores would not fit a long take no part. A zero vector does. Rows that repeat an id are rows
    of their own: each is an anchor, and a positive of the other. An empty table gives no rows; other columns do not matter."""
    index = Index(integer_vectors(vectors, scale))
    anchors = index.rows.where(anchor).select(F.col("row_no").alias("anchor"), F.col("vec_id").alias("anchor_id"), "label", "vec", F.col("leaf").alias("home"))
    anchors = cut(anchors)
    whole = {"lows": F.array(F.lit(LEAST).cast("long")), "highs": F.array(F.lit(-LEAST).cast("long"))}
    near = index.search(anchors.drop("anchor_id").withColumns(whole), positives, True)
    near = cut(near.select("anchor", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    windows = near.where("positive_score >= 0").groupBy("anchor").agg(F.array_sort(F.collect_set("positive_score")).alias("scores"))
    share = lambda n, up: F.expr(f"transform(scores, s -> s div 100 * {n} + (s % 100 * {n} + {up}) div 100)")
    asked = anchors.drop("anchor_id").join(windows, "anchor").withColumns({"lows": share(low, 99), "highs": share(high, 0)})
    found = index.search(asked.drop("scores"), negatives, False)
    of = windows.select("anchor", F.posexplode("scores").alias("annulus", "positive_score"))
    far = found.join(of, ["anchor", "annulus"]).select("anchor", "positive_score", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    met = near.join(anchors.select("anchor", "anchor_id"), "anchor").join(far, ["anchor", "positive_score"])
    return met.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(rows, F.col("vec_id") % 50 == 0)


OP12_SQL = """with sound as (
  select row_number() over () as no, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings where vec_id is not null and label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding)),
positive as (
  select a.no, a.vec_id as anchor_id, a.label, a.v, p.vec_id as positive_id, list_inner_product(a.v, p.v)::bigint as positive_score
  from sound a join sound p on p.label = a.label and p.no <> a.no where a.vec_id % 50 = 0
  qualify row_number() over (partition by a.no order by positive_score desc, p.vec_id, p.no) <= 5),
negative as (
  select a.no, n.vec_id as negative_id, list_inner_product(a.v, n.v)::bigint as negative_score
  from sound a join sound n on n.label <> a.label where a.vec_id % 50 = 0)
select anchor_id, positive_id, row_number() over (partition by p.no, positive_id, positive_score order by negative_score desc, negative_id)::int as rank, negative_id, positive_score, negative_score
from positive p join negative n on n.no = p.no and 50 * positive_score <= 100 * negative_score and 100 * negative_score <= 95 * positive_score
qualify rank <= 3"""
