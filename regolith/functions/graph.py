"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regolith.functions.lineage import cut


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node of edges(a, b), of any orderable type: the smallest node that it reaches.

    Large-star and small-star steps in turn: neighbours are hung on the smallest of a node's surroundings, until nothing
    changes, in about log(n) rounds. Minima are aggregated before they are joined, so a node of very many edges leaves
    one row for each task first. Raises if ``rounds`` do not suffice."""

    def smallest(arcs: DataFrame) -> DataFrame:
        low = arcs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        return arcs.join(low, "u")

    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    for _ in range(rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before:
            hung = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return hung.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = smallest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = smallest(large)
        small = down.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        now = cut(small.where("u <> v").distinct())
    raise RuntimeError(f"components still change after {rounds} rounds")
