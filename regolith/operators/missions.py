"""Missions from stored grids to reports: routes, their risk, and what each report can tell."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regolith.functions.lineage import cut
from regolith.operators import paths as pt
from regolith.operators import planning
from regolith.operators import reports as rp
from regolith.settings import DEFAULT, Settings


@dataclass(frozen=True)
class Outcome:
    """``status`` (mission_id, status) of every request; ``waypoints``, ``risks`` and ``contexts`` of those that have a route, path_id
    being the mission."""

    status: DataFrame
    waypoints: DataFrame
    risks: DataFrame
    contexts: DataFrame


def run(missions: DataFrame, requests: DataFrame, terrain: DataFrame, grids: DataFrame, rovers: DataFrame, settings: Settings = DEFAULT) -> Outcome:
    """One plan for each mission (mission_id, name, terrain_source, tile_id).

    ``requests`` as for planning.routes, plan_id being the mission; ``terrain`` are rows of analysis.analyse, ``grids`` those of its
    planning grids. Requests of tiles without a grid, of unknown vehicles and without a route have a status and nothing else."""
    route = cut(planning.routes(requests, grids, rovers, settings))
    ends = planning.snapped(requests, grids).join(rovers.select("rover_id", F.lit(True).alias("known")), "rover_id", "left")
    found = ends.join(route.groupBy(F.col("plan_id")).agg(F.count("*").alias("steps")), "plan_id", "left")
    same = (F.col("start_row") == F.col("goal_row")) & (F.col("start_col") == F.col("goal_col"))
    status = F.when(F.col("known").isNull(), "NO_ROVER").when(F.col("rows").isNull(), "NO_GRID").when(~F.col("whole"), "GRID_MISMATCH").when(same, "SAME_CELL").when(F.col("steps").isNull(), "NO_ROUTE").otherwise("OK")
    ways = cut(planning.waypoints(route, requests, grids, rovers, settings).withColumnRenamed("step_distance_m", "step_m"))
    fleet = rovers.withColumnRenamed("max_slope_deg", "rover_max_slope_deg")
    about = requests.select(F.col("plan_id").alias("path_id"), F.col("plan_id").alias("mission_id"), "rover_id").join(fleet, "rover_id")
    summary = pt.path_summary(ways).withColumn("mean_hazard", F.round("mean_hazard", 8))
    risks = pt.assess(summary.join(about, "path_id"), settings)
    contexts = rp.structured_context(risks, missions, pt.top_segments(ways, 5), terrain, settings)
    return Outcome(found.select(F.col("plan_id").alias("mission_id"), status.alias("status")), ways, risks, contexts)
