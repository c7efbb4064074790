"""Least-cost routes for many requests at once.

requests(plan_id, tile_id, rover_id, start_x, start_y, goal_x, goal_y, scale, meters_per_cell, max_hazard), pixels; grids
(tile_id, row, col, hazard, elevation_m). Over a grid of at most relax.BLOCK cells a side a task takes a portion of the plans
of its tile; larger ones are relaxed block by block (surfaces.py).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regolith.functions.rounding import rounded
from regolith.operators.relax import BLOCK, EIGHT, relax_grid
from regolith.operators.surfaces import Surfaces
from regolith.settings import DEFAULT, Settings


def snap(point: str, scale: str, n: Column, clamp: bool = True) -> Column:
    """Grid index of a pixel: rounded half to even, clamped to the grid unless it is to stay where it was asked for."""
    at = F.rint(F.col(point) / F.col(scale)).cast("int")
    return F.greatest(F.lit(0), F.least(n - 1, at)) if clamp else at


def grid_sizes(grids: DataFrame) -> DataFrame:
    """(tile_id, rows, cols, whole): ``whole`` if both layers have a value in every cell of the rectangle."""
    size = grids.groupBy("tile_id").agg((F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"), F.least(F.count("hazard"), F.count("elevation_m")).alias("_n"))
    return size.withColumn("whole", F.col("_n") == F.col("rows").cast("long") * F.col("cols")).drop("_n")


def snapped(requests: DataFrame, grids: DataFrame, clamp: bool = True) -> DataFrame:
    """``requests`` with rows, cols, whole, start_row, start_col, goal_row, goal_col; nulls where the tile has no grid. Without
    ``clamp`` an end may lie beyond the grid: such a start leads to itself only, such a goal is not reached."""
    placed = requests.join(grid_sizes(grids), "tile_id", "left")
    return placed.withColumns(
        {f"{end}_{axis}": F.when(F.col(n).isNotNull(), snap(f"{end}_{p}", "scale", F.col(n), clamp)) for end in ("start", "goal") for axis, p, n in (("row", "y", "rows"), ("col", "x", "cols"))}
    )


def energy_factor(rise_over_run: Column, settings: Settings = DEFAULT) -> Column:
    return 1 + settings.energy_slope_coefficient * F.abs(rise_over_run)


def slope_between(a: tuple[str, str, str], b: tuple[str, str, str], meters_per_cell: float) -> Column:
    """Signed slope in degrees from one cell to another, each told by the columns of its row, column and elevation; 0 between a cell
    and itself."""
    dy, dx = F.col(b[0]) - F.col(a[0]), F.col(b[1]) - F.col(a[1])
    run = F.sqrt((dy * dy + dx * dx).cast("double")) * meters_per_cell
    return F.when(run == 0, 0.0).otherwise(F.degrees(F.atan((F.col(b[2]) - F.col(a[2])) / run)))


def edge_cost(step_m: Column, hazard: Column, rise_over_run: Column, settings: Settings = DEFAULT) -> Column:
    return step_m * (1 + hazard) * energy_factor(rise_over_run, settings)


_SURFACE = "plan_id long, row int, col int, cost double, back int"
_PLAN = ["plan_id", "start_row", "start_col", "goal_row", "goal_col", "meters_per_cell", "max_slope_deg", "max_hazard"]
#: Plans of one tile that one task takes together: a tile that many ask for is dealt into portions of about so many.
PORTION = 64


def _layers(grid: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    row, col = grid["row"].to_numpy(), grid["col"].to_numpy()
    shape = int(row.max()) + 1, int(col.max()) + 1
    hazard, elevation = np.full(shape, np.inf), np.zeros(shape)
    hazard[row, col], elevation[row, col] = grid["hazard"], grid["elevation_m"]
    return hazard, elevation


def _relaxed(plans: pd.DataFrame, grid: pd.DataFrame, k: float, route: bool) -> pd.DataFrame:
    """Surfaces, or routes, of some plans over one grid. Plans that differ in their goal only share a surface."""
    out = []
    if len(grid):
        hazard, elevation = _layers(grid)
        for (row, col, metres, slope, most), some in plans.groupby(["start_row", "start_col", "meters_per_cell", "max_slope_deg", "max_hazard"], sort=False):
            cost, back = relax_grid(hazard, elevation, (int(row), int(col)), float(metres), float(np.tan(np.radians(slope))), float(most), k)
            y, x = np.nonzero(np.isfinite(cost))
            for plan in some.itertuples(index=False):
                if route:
                    cells = _walk(back, np.isfinite(cost), (int(plan.goal_row), int(plan.goal_col)))
                    out.append(pd.DataFrame({"plan_id": plan.plan_id, "segment_id": np.arange(len(cells)), "row": [c[0] for c in cells], "col": [c[1] for c in cells]}))
                else:
                    out.append(pd.DataFrame({"plan_id": plan.plan_id, "row": y, "col": x, "cost": cost[y, x], "back": back[y, x]}))
    names = ["plan_id", "segment_id", "row", "col"] if route else ["plan_id", "row", "col", "cost", "back"]
    return pd.concat(out) if out else pd.DataFrame({n: [] for n in names})


def _walk(back: np.ndarray, reached: np.ndarray, goal: tuple[int, int]) -> list[tuple[int, int]]:
    """Cells from the start to ``goal``; none if it is not reached."""
    at, cells = goal, []
    while reached[at]:
        cells.append(at)
        if back[at] < 0:
            break
        at = at[0] + EIGHT[back[at]][0], at[1] + EIGHT[back[at]][1]
    return cells[::-1]


def _by_tile(plans: DataFrame, grids: DataFrame, settings: Settings, route: bool, schema: str) -> DataFrame:
    """Each tile's grid meets the plans over it once for each portion of them, whatever their number."""
    k = settings.energy_slope_coefficient
    portions = plans.groupBy("tile_id").agg(F.ceil(F.count("*") / PORTION).cast("int").alias("portions"))
    dealt = plans.join(portions, "tile_id").withColumn("portion", F.pmod(F.xxhash64("plan_id"), F.col("portions")).cast("int"))
    spread = grids.join(portions, "tile_id").withColumn("portion", F.explode(F.sequence(F.lit(0), F.col("portions") - 1)))
    own, ground = dealt.select("tile_id", "portion", *_PLAN), spread.select("tile_id", "portion", "row", "col", "hazard", "elevation_m")
    return own.groupBy("tile_id", "portion").cogroup(ground.groupBy("tile_id", "portion")).applyInPandas(lambda p, g: _relaxed(p, g, k, route), schema)


def _small() -> Column:
    return (F.col("rows") <= BLOCK) & (F.col("cols") <= BLOCK)


def _within(end: str) -> Column:
    """Whether an end of a plan is a cell of its grid."""
    return F.col(f"{end}_row").between(0, F.col("rows") - 1) & F.col(f"{end}_col").between(0, F.col("cols") - 1)


def _asked(requests: DataFrame, grids: DataFrame, rovers: DataFrame, clamp: bool = True) -> DataFrame:
    """Requests that have a whole grid and a vehicle."""
    return snapped(requests, grids, clamp).where("whole").join(rovers, "rover_id")


def cost_surface(requests: DataFrame, grids: DataFrame, rovers: DataFrame, settings: Settings = DEFAULT, clamp: bool = True) -> DataFrame:
    """(plan_id, row, col, cost, back): cells that a plan's start leads to; ``back`` is the step (in EIGHT) to the cell
    before, -1 at the start. Requests without a whole grid or a vehicle have no rows."""
    asked = _asked(requests, grids, rovers, clamp)
    plans = asked.where(_within("start"))
    near = _by_tile(plans.where(_small()), grids, settings, False, _SURFACE)
    if not clamp:
        alone = asked.where(~_within("start")).select("plan_id", F.col("start_row").alias("row"), F.col("start_col").alias("col"), F.lit(0.0).alias("cost"), F.lit(-1).alias("back"))
        near = near.unionByName(alone)
    large = plans.where(~_small())
    if large.limit(1).count() == 0:
        return near
    return near.unionByName(Surfaces(large, grids, settings.energy_slope_coefficient, BLOCK).costs())


_ROUTE = "plan_id long, segment_id int, row int, col int"


def routes(requests: DataFrame, grids: DataFrame, rovers: DataFrame, settings: Settings = DEFAULT, clamp: bool = True) -> DataFrame:
    """(plan_id, segment_id, row, col) from start to goal, for requests whose status is OK. On a small grid the route is
    walked where its surface was found, so no surface leaves the task; on a larger one block by block."""
    plans = _asked(requests, grids, rovers, clamp).where("start_row <> goal_row or start_col <> goal_col").where(_within("start") & _within("goal"))
    near = _by_tile(plans.where(_small()), grids, settings, True, _ROUTE)
    large = plans.where(~_small())
    if large.limit(1).count() == 0:
        return near
    return near.unionByName(Surfaces(large, grids, settings.energy_slope_coefficient, BLOCK).routes())


def large_surfaces(requests: DataFrame, grids: DataFrame, rovers: DataFrame, settings: Settings = DEFAULT, block: int = BLOCK) -> Surfaces:
    """The requests that have a whole grid and a vehicle, relaxed block by block whatever the size of their grid: costs and
    routes of one computation."""
    return Surfaces(_asked(requests, grids, rovers), grids, settings.energy_slope_coefficient, block)


def plan_status(requests: DataFrame, grids: DataFrame, rovers: DataFrame, surface: DataFrame, clamp: bool = True) -> DataFrame:
    """(plan_id, status, total_cost) of every request: NO_ROVER, NO_GRID, GRID_MISMATCH (the layers are not of one shape),
    SAME_CELL, NO_ROUTE or OK."""
    ends = snapped(requests, grids, clamp).join(rovers.select("rover_id", F.lit(True).alias("known")), "rover_id", "left")
    reached = surface.select("plan_id", F.col("row").alias("goal_row"), F.col("col").alias("goal_col"), "cost")
    same = (F.col("start_row") == F.col("goal_row")) & (F.col("start_col") == F.col("goal_col"))
    status = F.when(F.col("known").isNull(), "NO_ROVER").when(F.col("rows").isNull(), "NO_GRID").when(~F.col("whole"), "GRID_MISMATCH").when(same, "SAME_CELL").when(F.col("cost").isNull(), "NO_ROUTE").otherwise("OK")
    return ends.join(reached, ["plan_id", "goal_row", "goal_col"], "left").select("plan_id", status.alias("status"), F.when(status == "OK", F.col("cost")).alias("total_cost"))


def waypoints(route: DataFrame, requests: DataFrame, grids: DataFrame, rovers: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Routes with pixel, hazard, slope, step length, energy and cumulative energy of each waypoint; rounded for reports,
    the running sum before rounding. The first step is all zero."""
    line = Window.partitionBy("plan_id").orderBy("segment_id")
    about = requests.select("plan_id", "tile_id", "rover_id", "scale", "meters_per_cell").join(rovers.select("rover_id", "kwh_per_m"), "rover_id")
    at = route.join(about, "plan_id").join(grids.select("tile_id", "row", "col", "hazard", "elevation_m"), ["tile_id", "row", "col"])
    before = {c: F.lag(c).over(line) for c in ("row", "col", "elevation_m")}
    dy, dx = F.col("row") - before["row"], F.col("col") - before["col"]
    at = at.withColumn("_m", F.coalesce(F.sqrt((dy * dy + dx * dx).cast("double")) * F.col("meters_per_cell"), F.lit(0.0)))
    at = at.withColumn("_r", F.when(F.col("_m") > 0, (F.col("elevation_m") - F.lag("elevation_m").over(line)) / F.col("_m")).otherwise(0.0))
    at = at.withColumn("_e", F.col("kwh_per_m") * F.col("_m") * energy_factor(F.col("_r"), settings))
    pixel = lambda c: F.rint(F.col(c) * F.col("scale")).cast("int")
    return at.select(
        F.col("plan_id").alias("path_id"), "segment_id", pixel("col").alias("x"), pixel("row").alias("y"), rounded("hazard", 4).alias("hazard_score"),
        rounded(F.degrees(F.atan("_r")), 3).alias("slope_deg"), rounded("_m", 3).alias("step_distance_m"), rounded("_e", 6).alias("energy_cost_kwh"),
        rounded(F.sum("_e").over(line.rowsBetween(Window.unboundedPreceding, 0)), 6).alias("cumulative_energy_kwh"),
    )
