"""Connected regions by runs: the cells of a row that follow each other are one node.

Runs come from one window over the rows (gaps and islands). Runs of adjacent rows that touch are linked by an equi-join on row and
stretch of columns; components are then found over runs, so nodes are fewer than cells by the mean length of a run. All of
it is Spark's own operators; relax.labels does the same with arrays, block by block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regolith.functions.graph import components
from regolith.functions.lineage import cut
from regolith.operators.relax import ROW

#: Columns of a stretch: runs of two rows are compared only within the stretches that both reach.
STRETCH = 256


def runs(cells: DataFrame) -> DataFrame:
    """(tile_id, y, x0, x1, run) of cells(tile_id, y, x): the first and last column of cells in a row, and the first cell as
    y * ROW + x. One exchange: rows are grouped as they were sorted."""
    along = Window.partitionBy("tile_id", "y").orderBy("x")
    island = cells.select("tile_id", "y", "x").withColumn("_i", F.col("x") - F.row_number().over(along))
    found = island.groupBy("tile_id", "y", "_i").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("_i")
    return found.withColumn("run", F.col("y").cast("long") * ROW + F.col("x0"))


def touching(found: DataFrame, diagonal: bool = True) -> DataFrame:
    """(tile_id, run, other): runs of adjacent rows that share a column, or a corner too."""
    far = 1 if diagonal else 0
    each = lambda a, b: F.explode(F.sequence(F.floor(F.greatest(F.lit(0), a) / STRETCH), F.floor(b / STRETCH)))
    below = found.select("tile_id", (F.col("y") - 1).alias("y"), F.col("x0").alias("b0"), F.col("x1").alias("b1"), F.col("run").alias("other")).withColumn("_at", each(F.col("b0"), F.col("b1")))
    above = found.withColumn("_at", each(F.col("x0") - far, F.col("x1") + far))
    met = above.join(below, ["tile_id", "y", "_at"]).where((F.col("b0") <= F.col("x1") + far) & (F.col("b1") >= F.col("x0") - far))
    return met.select("tile_id", "run", "other").distinct()  # two long runs meet in several stretches


def labelled(found: DataFrame, diagonal: bool = True) -> DataFrame:
    """``found`` runs with ``label``: the first run, and so the first cell, of the connected region."""
    links = touching(found, diagonal)
    joined = components(links.select(F.struct("tile_id", "run").alias("a"), F.struct("tile_id", F.col("other").alias("run")).alias("b")))
    moved = joined.select("node.tile_id", "node.run", F.col("component.run").alias("label"))
    return found.join(moved, ["tile_id", "run"], "left").withColumn("label", F.coalesce("label", "run"))


def cells_of(found: DataFrame, *more: str) -> DataFrame:
    """The cells (tile_id, y, x, ...) of runs."""
    return found.select("tile_id", "y", F.explode(F.sequence("x0", "x1")).alias("x"), *more)


def labels(cells: DataFrame, on: str, diagonal: bool = True) -> DataFrame:
    """(tile_id, y, x, label) of the cells where the boolean ``on`` holds, as relax.labels has them."""
    return cells_of(labelled(cut(runs(cells.where(on))), diagonal), "label")


def filled_mask(closed: DataFrame) -> DataFrame:
    """(tile_id, y, x) that are edges of closed(tile_id, y, x, edge) or enclosed by them: all but the background that is
    4-connected to the border."""
    size = closed.groupBy("tile_id").agg(F.max("y").alias("_y"), F.max("x").alias("_x"))
    ground = labelled(cut(runs(closed.where("edge = 0"))), False).join(size, "tile_id")
    rim = (F.col("y") == 0) | (F.col("y") == F.col("_y")) | (F.col("x0") == 0) | (F.col("x1") == F.col("_x"))
    holes = ground.groupBy("tile_id", "label").agg(F.max(rim).alias("outer")).where(~F.col("outer"))
    inside = ground.join(holes, ["tile_id", "label"], "left_semi").select("tile_id", "y", "x0", "x1")
    return closed.where("edge = 1").select("tile_id", "y", "x").unionByName(cells_of(inside))
