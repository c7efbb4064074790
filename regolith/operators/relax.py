"""Connected labels and least-cost surfaces on grids.

Labels: cells are dealt into square blocks; each block is labelled by itself with shifted arrays, then labels that touch
across block borders are joined as a graph, which holds border cells only. A raster of one block needs no second step.

Costs: a plan's grid of at most BLOCK cells a side is relaxed in one task for each plan, again with shifted arrays.
Larger grids are relaxed block by block (surfaces.py). ``relax_costs`` does the same with joins only, as the plain definition.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regolith.functions.graph import components
from regolith.functions.lineage import cut

BLOCK = 256
#: A label is the first cell (row by row) of its component: y * ROW + x.
ROW = 2**32
EIGHT = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]
FOUR = [(-1, 0), (0, -1), (0, 1), (1, 0)]


def shifted(a: np.ndarray, dy: int, dx: int, fill) -> np.ndarray:
    """b[y, x] = a[y + dy, x + dx], ``fill`` outside."""
    out = np.full_like(a, fill)
    h, w = a.shape
    out[max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)] = a[max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)]
    return out


def label_block(on: np.ndarray, number: np.ndarray, steps: list[tuple[int, int]]) -> np.ndarray:
    """Smallest number reachable within the block, for cells that are on. After each round a cell also takes what its
    label's own cell has taken, so long regions need few rounds."""
    top = np.iinfo(np.int64).max
    place = np.arange(on.size).reshape(on.shape)
    low = np.where(on, place, on.size)
    while True:
        new = low
        for dy, dx in steps:
            new = np.minimum(new, shifted(low, dy, dx, on.size))
        new = np.where(on, new, on.size)
        flat = np.append(new.ravel(), on.size)
        jumped = flat[flat[new]]
        if (jumped == low).all():
            break
        low = jumped
    return np.append(number.ravel(), top)[low]


def labels(cells: DataFrame, on: str, diagonal: bool = True, block: int = BLOCK, carry: tuple[str, ...] = ()) -> DataFrame:
    """(tile_id, y, x, *carry, label) of the cells where the boolean ``on`` holds: the first cell of the connected component.
    ``carry`` names columns that go along, so that nothing need be joined to the labels again."""
    steps = EIGHT if diagonal else FOUR

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        y, x = pdf["y"].to_numpy(), pdf["x"].to_numpy()
        mask = np.zeros((y.max() - y.min() + 1, x.max() - x.min() + 1), bool)
        mask[y - y.min(), x - x.min()] = True
        number = np.arange(y.min(), y.max() + 1, dtype=np.int64)[:, None] * ROW + np.arange(x.min(), x.max() + 1)[None, :]
        return pdf[["tile_id", "y", "x", *carry]].assign(part=label_block(mask, number, steps)[y - y.min(), x - x.min()])

    marked = cells.where(on).select("tile_id", "y", "x", *carry).withColumns({"by": F.floor(F.col("y") / block), "bx": F.floor(F.col("x") / block)})
    kinds = dict(cells.dtypes)
    schema = ", ".join(["tile_id string, y int, x int", *(f"{c} {kinds[c]}" for c in carry), "part long"])
    parts = marked.groupBy("tile_id", "by", "bx").applyInPandas(each, schema)
    parts = cut(parts)
    last = parts.agg(F.max(F.greatest("y", "x"))).first()[0]
    if last is None or last < block:  # every tile is one block
        return parts.withColumnRenamed("part", "label")
    rim = parts.where(f"y % {block} in (0, {block - 1}) or x % {block} in (0, {block - 1})")
    steps_df = F.explode(F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in steps if (dy, dx) > (0, 0))))
    near = rim.withColumn("s", steps_df).select("tile_id", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"), F.col("part").alias("other"))
    edges = near.join(rim, ["tile_id", "y", "x"]).where("part <> other")
    joined = components(edges.select(F.struct("tile_id", "part").alias("a"), F.struct("tile_id", F.col("other").alias("part")).alias("b")))
    moved = joined.select("node.tile_id", "node.part", F.col("component.part").alias("label"))
    return parts.join(moved, ["tile_id", "part"], "left").select("tile_id", "y", "x", *carry, F.coalesce("label", "part").alias("label"))


def edges_of(grid: DataFrame, meters_per_cell: float) -> DataFrame:
    """edges(tile_id, row, col, to_row, to_col, step_m, rise_over_run, to_hazard) to the eight neighbours: an equi-join of
    cells with their neighbours' places."""
    offsets = F.explode(F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in EIGHT)))
    ends = grid.select("tile_id", F.col("row").alias("to_row"), F.col("col").alias("to_col"), F.col("hazard").alias("to_hazard"), F.col("elevation_m").alias("to_elevation"))
    step = F.when(F.col("o.dy") * F.col("o.dx") != 0, F.sqrt(F.lit(2.0))).otherwise(F.lit(1.0)) * meters_per_cell
    starts = grid.withColumn("o", offsets).select(
        "tile_id", "row", "col", (F.col("row") + F.col("o.dy")).alias("to_row"), (F.col("col") + F.col("o.dx")).alias("to_col"), "elevation_m", step.alias("step_m")
    )
    return starts.join(ends, ["tile_id", "to_row", "to_col"]).select(
        "tile_id", "row", "col", "to_row", "to_col", "step_m", ((F.col("to_elevation") - F.col("elevation_m")) / F.col("step_m")).alias("rise_over_run"), "to_hazard"
    )


def relax_costs(starts: DataFrame, edges: DataFrame, rounds: int = 100_000, check_every: int = 4) -> DataFrame:
    """(plan_id, row, col, cost) from starts(plan_id, row, col) over edges(plan_id, row, col, to_row, to_col, cost): the
    cheapest way to each cell, relaxed by joins until nothing improves. Work per round follows the cells improved last."""
    best = cut(starts.select("plan_id", "row", "col", F.lit(0.0).alias("cost")))
    moved, edges = best, cut(edges.select("plan_id", "row", "col", "to_row", "to_col", F.col("cost").alias("step")))
    for _ in range(rounds):
        tried = moved.join(edges, ["plan_id", "row", "col"]).groupBy("plan_id", F.col("to_row").alias("row"), F.col("to_col").alias("col")).agg(F.min(F.col("cost") + F.col("step")).alias("new"))
        moved = cut(tried.join(best, ["plan_id", "row", "col"], "left").where("cost is null or new < cost").select("plan_id", "row", "col", F.col("new").alias("cost")))
        if moved.limit(1).count() == 0:
            return best
        best = cut(best.unionByName(moved).groupBy("plan_id", "row", "col").agg(F.min("cost").alias("cost")))
    raise RuntimeError(f"costs still improve after {rounds} rounds")


def relax_grid(hazard: np.ndarray, elevation: np.ndarray, start: tuple[int, int], meters: float, max_slope_tan: float, max_hazard: float, k: float) -> tuple[np.ndarray, np.ndarray]:
    """Costs from ``start`` (inf where it does not lead), and for each cell the index in EIGHT of the step back towards the
    start. Entering a cell is barred by its hazard or by the step's slope. Ties step back to the smallest cell."""
    wide = np.full((hazard.shape[0] + 2, hazard.shape[1] + 2), np.inf)  # with a rim that nothing comes from
    cost = wide[1:-1, 1:-1]
    cost[start] = 0.0
    beside = [wide[1 + dy : wide.shape[0] - 1 + dy, 1 + dx : wide.shape[1] - 1 + dx] for dy, dx in EIGHT]
    into = []  # per step back: cost of entering the cell from there
    for dy, dx in EIGHT:
        run = np.hypot(dy, dx) * meters
        rise = np.abs(elevation - shifted(elevation, dy, dx, np.nan)) / run
        into.append(np.where((rise > max_slope_tan) | (hazard >= max_hazard) | np.isnan(rise), np.inf, run * (1 + hazard) * (1 + k * rise)))
    while True:
        before = cost.copy()
        for from_there, step in zip(beside, into, strict=True):
            np.minimum(cost, from_there + step, out=cost)
        if (cost == before).all():
            break
    back, low = np.full(hazard.shape, -1), np.full(hazard.shape, np.inf)
    for i, (from_there, step) in enumerate(zip(beside, into, strict=True)):
        through = from_there + step
        better = through < low
        back, low = np.where(better, i, back), np.where(better, through, low)
    back[start] = -1
    return cost.copy(), np.where(np.isinf(cost), -1, back)
