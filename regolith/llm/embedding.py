"""Embedding near-duplicates by Euclidean p-stable hashing.

Vectors are normalised, so a cosine threshold is a distance threshold. A table's hash quantises several random
projections, floor((a.v + b) / width) with normal a and uniform b; vectors of one label whose quantised projections all
agree in a table share a bucket. The number of projections grows with the logarithm of the largest label, so a bucket
holds a few unrelated vectors at any size; the number of tables then follows from the recall asked for at the threshold
itself (nearer pairs are found more surely). Pairs of a bucket are checked by exact cosine in double precision, in blocks,
each pair only in the first table where it meets. Equal vectors are one class and never expanded into pairs.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regolith.functions.graph import components
from regolith.functions.lineage import cut
from regolith.llm.common import in_blocks, in_runs, read

THRESHOLD = 0.93
RECALL = 0.995
WIDTH = 1.5
SEED = 20240229
BLOCK_ROWS = 1000
#: Groups of up to so many rows are compared together, so many pairs at a time.
SMALL_GROUP, PAIRS = 64, 50_000


def collision(distance: float, width: float = WIDTH) -> float:
    """Chance that one quantised projection of two vectors at this distance agrees."""
    t = width / max(distance, 1e-9)
    tail = 0.5 * math.erfc(t / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


@dataclass(frozen=True)
class Plan:
    """Projections of each table, tables, and the vectors' dimension."""

    hashes: int
    tables: int
    size: int

    @functools.cached_property
    def _planes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rng = np.random.default_rng(SEED)
        normals = rng.standard_normal((self.size, self.hashes * self.tables))
        offsets = rng.uniform(0, WIDTH, self.hashes * self.tables)
        return normals, offsets, rng.integers(1, 2**63 - 1, self.hashes, dtype=np.int64) | 1

    def keys(self, unit: np.ndarray, tables: int | None = None) -> np.ndarray:
        """(rows, tables) 64-bit bucket numbers of unit vectors, in all tables or in the first so many."""
        normals, offsets, mixer = self._planes
        n = self.tables if tables is None else tables
        cells = np.floor((unit @ normals[:, : n * self.hashes] + offsets[: n * self.hashes]) / WIDTH).astype(np.int64)
        return (cells.reshape(len(unit), n, self.hashes) * mixer).sum(axis=2)  # wraps around


def plan(largest: int, size: int, threshold: float = THRESHOLD, recall: float = RECALL) -> Plan:
    """Enough projections that two unrelated (orthogonal) vectors of the largest label meet with chance 1 / largest, and
    enough tables for the recall at the threshold."""
    near, far = collision(math.sqrt(2 - 2 * threshold)), collision(math.sqrt(2))
    hashes = max(4, math.ceil(math.log(max(largest, 2)) / -math.log(far)))
    return Plan(hashes, math.ceil(math.log(1 - recall) / math.log(1 - near**hashes)), size)


def _units(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


_FOUND = "class_no long, first_id long, links long, root_no long, root_id long"


def _near(group: np.ndarray, unit: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) of rows of one group at the threshold; ``group`` is sorted. Many small groups are compared in one step,
    a large one as a matrix."""
    cuts = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]])
    found = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b - a > SMALL_GROUP:
            i, j = np.nonzero(np.triu(unit[a:b] @ unit[a:b].T >= threshold, 1))
            found.append((i + a, j + a))
    ends = np.repeat(cuts[1:], np.diff(cuts))
    behind = np.where(np.repeat(np.diff(cuts), np.diff(cuts)) > SMALL_GROUP, 0, ends - np.arange(len(group)) - 1)
    upto = np.cumsum(behind)
    for a in range(0, int(upto[-1]), PAIRS):  # pair p is that of row i with the (p - pairs of earlier rows)-th row behind it
        p = np.arange(a, min(a + PAIRS, int(upto[-1])))
        i = np.searchsorted(upto, p, side="right")
        j = i + 1 + p - (upto[i] - behind[i])
        near = np.einsum("pd,pd->p", unit[i], unit[j]) >= threshold
        found.append((i[near], j[near]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2


def _checked(frame: pd.DataFrame, how: Plan, threshold: float) -> pd.DataFrame:
    """Per class and pair of blocks: links found here first, and the first class that they reach. Only classes that link
    are hashed again, and only for the tables before theirs."""
    frame = frame.sort_values(["pair", "first_id", "class_no"], ignore_index=True)
    unit = _units(frame["embedding"])
    table, label, block, mixed = (frame[c].to_numpy() for c in ("table", "label", "block", "mixed"))
    i, j = _near(frame["pair"].to_numpy(), unit, threshold)
    fit = (table[i] == table[j]) & (label[i] == label[j]) & (~mixed[i] | (block[i] != block[j]))
    i, j = i[fit], j[fit]
    if len(i):
        seen, at = np.unique(np.concatenate([i, j]), return_inverse=True)
        keys = np.concatenate([how.keys(unit[seen[k : k + 2000]], int(table.max()) + 1) for k in range(0, len(seen), 2000)])
        met = np.full(len(i), -1)  # the first table where both meet
        for k in range(0, len(i), 4 * PAIRS):
            a, b, some = at[:len(i)][k : k + 4 * PAIRS], at[len(i) :][k : k + 4 * PAIRS], met[k : k + 4 * PAIRS]
            for t in range(keys.shape[1]):
                some[(some < 0) & (keys[a, t] == keys[b, t])] = t
        first = met == table[i]
        i, j = i[first], j[first]
    copies, links, root = frame["copies"].to_numpy(), np.zeros(len(frame), np.int64), np.arange(len(frame))
    np.add.at(links, i, copies[j])
    np.add.at(links, j, copies[i])
    while True:  # rows are sorted, so the first class that is reached is the smallest row
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    ids, on = frame[["class_no", "first_id"]].to_numpy(), links > 0
    return pd.DataFrame({"class_no": ids[on, 0], "first_id": ids[on, 1], "links": links[on], "root_no": ids[root[on], 0], "root_id": ids[root[on], 1]})


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Only vectors of equal, non-null label link. A vector that is null, zero, or holds null or non-finite components, has a
    null id or a null label, or another dimension than most, links with nothing: no links, itself its component. Repeated
    rows are vectors of their own and link with each other; rows that repeat an id with other vectors count as these. An
    empty table gives no rows."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0)
    two = [F.xxhash64(F.lit(salt), "label", "embedding").alias(f"hash_{salt}") for salt in (1, 2)]  # 128 bits name a class: vectors are no join keys
    rows = vectors.select("vec_id", "embedding", "label", *two).withColumn("fit", F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & sound, F.lit(False)))
    usual = rows.where("fit").groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if usual is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    rows = rows.withColumn("fit", F.col("fit") & (F.coalesce(F.size("embedding"), F.lit(0)) == usual["size"]))
    kinds = rows.where("fit").groupBy("hash_1", "hash_2").agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.min("vec_id").alias("first_id"), F.count("*").alias("copies"))
    classes = cut(kinds.withColumn("class_no", F.monotonically_increasing_id()))  # fixed from here on
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0]
    how = plan(largest, usual["size"], threshold, recall)

    def hashed(frames):
        for frame in frames:
            keys = how.keys(_units(frame["embedding"]))
            n, tables = keys.shape
            yield pd.DataFrame({
                "label": np.repeat(frame["label"].to_numpy(), tables), "table": np.tile(np.arange(tables), n), "key": keys.ravel(),
                "class_no": np.repeat(frame["class_no"].to_numpy(), tables),
            })

    label_type = dict(classes.dtypes)["label"]
    spread = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = (
        classes.repartition(spread, "class_no")
        .select("label", "embedding", "class_no")
        .mapInPandas(hashed, f"label {label_type}, table int, key long, class_no long")
        .withColumn("bucket", F.xxhash64("label", "table", "key"))
        .select("bucket", "table", "class_no")
    )
    met = cut(met)
    sizes = met.groupBy("bucket").agg(F.count("*").alias("bucket_rows")).where("bucket_rows > 1")
    dealt = in_blocks(met.join(sizes, "bucket"), "bucket", "bucket_rows", "class_no", BLOCK_ROWS)
    dealt = dealt.select("pair", "table", "block", "mixed", "class_no").join(classes.drop("hash_1", "hash_2"), "class_no")
    found = cut(in_runs(dealt, "pair", lambda g: _checked(g, how, threshold), _FOUND, 4 * BLOCK_ROWS))
    links = found.groupBy("class_no").agg(F.sum("links").alias("links"))
    node = lambda i, n: F.struct(F.col(i).alias("id"), F.col(n).alias("no"))
    joined = components(found.select(node("first_id", "class_no").alias("a"), node("root_id", "root_no").alias("b")))
    reach = (
        classes.select("hash_1", "hash_2", "class_no", "first_id", "copies")
        .join(links, "class_no", "left")
        .join(joined.select(F.col("node.no").alias("class_no"), F.col("component.id").alias("component_id")), "class_no", "left")
        .select("hash_1", "hash_2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "first_id").alias("component_id"))
    )
    linked = rows.where("fit").join(reach, ["hash_1", "hash_2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op2_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))
