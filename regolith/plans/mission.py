"""The chain of a mission as one query: raster, hazard, stored planning grids, route, risk and report."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regolith.functions.lineage import shared_dir
from regolith.operators import analysis
from regolith.operators import missions as ms
from regolith.operators import reports as rp
from regolith.plans.report import CONTEXT, TEMPLATE, TOP
from regolith.plans.terrain import CIRCLES, CLASS_NAME, GRID_DIM, HAZARD, OBSTACLE_STATS, PLANNING_GRIDS, SCALE, WIDE
from regolith.plans.traverse import RISK, SUMMARY
from regolith.settings import NOISE_TILES as S
from regolith.sources.store import read_grids, write_grids
from regolith.sources.tables import CELLS, MISSIONS, ROVERS_SQL, cells, missions, rovers, with_ctes


def mission_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each mission from one corner of its tile to a place of its own at the other end, with one of the vehicles."""
    m = F.col("mission_id")
    return missions(spark, sf_dir).select(
        m.alias("plan_id"), "tile_id", (m % 3).cast("int").alias("rover_id"), F.lit(2).alias("start_x"), F.lit(2).alias("start_y"), (m % 24 + 40).cast("int").alias("goal_x"), (m % 20 + 30).cast("int").alias("goal_y"),
        F.lit(SCALE).alias("scale"), F.lit(WIDE).alias("meters_per_cell"), F.lit(S.lethal_hazard).alias("max_hazard"),
    )


def mission_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every mission's outcome and report, from the cells of its tile: the grids are stored and read back between analysis
    and planning."""
    found = analysis.analyse(cells(spark, sf_dir), S)
    folder = f"{shared_dir(spark)}/grids-{uuid.uuid4().hex}"
    write_grids(analysis.planning_grids(found.scored, S, GRID_DIM), folder)
    requests = mission_requests(spark, sf_dir)
    grids, _ = read_grids(spark, folder, requests)
    out = ms.run(missions(spark, sf_dir), requests, found.rows, grids, rovers(spark), S)
    c = "context."
    told = rp.fallback_report(out.contexts).join(out.contexts, "path_id").select(
        F.col("path_id").alias("mission_id"), c + "path_summary.num_waypoints", c + "path_summary.total_distance_m", c + "path_summary.mean_hazard", c + "path_summary.max_slope_encountered_deg",
        F.col(c + "risk_score").alias("risk_tier"), c + "risk_score_numeric", c + "feasibility", c + "terrain_summary.avg_hazard_score", c + "terrain_summary.max_hazard_score", c + "terrain_summary.obstacle_count",
        c + "terrain_summary.terrain_classification", c + "terrain_summary.mean_slope_deg", c + "terrain_summary.max_slope_deg", c + "terrain_summary.area_covered_m.width_m",
        F.col(c + "calculation_basis.hazard.aggregate.p95_hazard").alias("p95_hazard"), F.col(c + "calculation_basis.risk.thresholds.margin").alias("margin"), "summary", "reasons", "recommendation",
    )
    return out.status.join(told, "mission_id", "left")


QUERIES = {"mission_run": mission_run}

ROUTES = f"""asks as (
  select mission_id, tile_id, (mission_id % 3)::int as rover_id, least(nr - 1, round_even((mission_id % 20 + 30) / {SCALE}::double, 0)::int) as goal_row, least(nc - 1, round_even((mission_id % 24 + 40) / {SCALE}::double, 0)::int) as goal_col
  from missions join (select tile_id, max("row") + 1 as nr, max(col) + 1 as nc from planning_grids group by 1) using (tile_id)),
ways_ as materialized (
  select a.tile_id, rover_id, a."row", a.col, b."row" as to_row, b.col as to_col,
         (case when dy * dx <> 0 then sqrt(2::double) else 1 end) * {WIDE}::double * (1 + b.hazard)
           * (1 + {S.energy_slope_coefficient}::double * abs((b.elevation_m - a.elevation_m) / ((case when dy * dx <> 0 then sqrt(2::double) else 1 end) * {WIDE}::double))) as cost
  from planning_grids a cross join (values (-1,-1),(-1,0),(-1,1),(0,-1),(0,1),(1,-1),(1,0),(1,1)) o(dy, dx) join planning_grids b on b.tile_id = a.tile_id and b."row" = a."row" + dy and b.col = a.col + dx cross join rovers
  where b.hazard < {S.lethal_hazard}::double and abs((b.elevation_m - a.elevation_m) / ((case when dy * dx <> 0 then sqrt(2::double) else 1 end) * {WIDE}::double)) <= tan(radians(max_slope_deg))),
surface(tile_id, rover_id, "row", col, cost) using key (tile_id, rover_id, "row", col) as (
  select distinct tile_id, rover_id, 1, 1, 0::double from asks
  union
  select e.tile_id, e.rover_id, e.to_row, e.to_col, min(s.cost + e.cost) from surface s
  join ways_ e on e.tile_id = s.tile_id and e.rover_id = s.rover_id and e."row" = s."row" and e.col = s.col
  left join recurring.surface k on k.tile_id = e.tile_id and k.rover_id = e.rover_id and k."row" = e.to_row and k.col = e.to_col
  where k.cost is null or s.cost + e.cost < k.cost group by e.tile_id, e.rover_id, e.to_row, e.to_col),
steps_back as materialized (
  select e.tile_id, e.rover_id, e.to_row as "row", e.to_col as col, arg_min({{'r': e."row", 'c': e.col}}, (s.cost + e.cost, e."row", e.col)) as b
  from ways_ e join surface s on s.tile_id = e.tile_id and s.rover_id = e.rover_id and s."row" = e."row" and s.col = e.col group by all),
trace(mission_id, tile_id, rover_id, nth, "row", col) as (
  select mission_id, a.tile_id, a.rover_id, 0, goal_row, goal_col from asks a join surface s on s.tile_id = a.tile_id and s.rover_id = a.rover_id and s."row" = goal_row and s.col = goal_col
  union all
  select mission_id, t.tile_id, t.rover_id, nth + 1, b.r, b.c from trace t join steps_back k on k.tile_id = t.tile_id and k.rover_id = t.rover_id and k."row" = t."row" and k.col = t.col where t."row" <> 1 or t.col <> 1),
routes as materialized (select mission_id, tile_id, rover_id, (max(nth) over (partition by mission_id) - nth)::int as segment_id, "row", col from trace),
walked as (
  select r.*, v.kwh_per_m, g.hazard, coalesce(sqrt((r."row" - lag(r."row") over w) ** 2 + (r.col - lag(r.col) over w) ** 2) * {WIDE}::double, 0) as m, g.elevation_m - lag(g.elevation_m) over w as rise
  from routes r join rovers v using (rover_id) join planning_grids g on g.tile_id = r.tile_id and g."row" = r."row" and g.col = r.col
  window w as (partition by r.mission_id order by r.segment_id)),
paced as (select *, case when m > 0 then rise / m else 0 end as slope from walked),
steps as materialized (
  select mission_id as path_id, segment_id, round_even(col * {SCALE}::double, 0)::int as x, round_even("row" * {SCALE}::double, 0)::int as y, round(hazard, 4) as hazard_score, round(degrees(atan(slope)), 3) as slope_deg, round(m, 3) as step_m,
         round(sum(kwh_per_m * m * (1 + {S.energy_slope_coefficient}::double * abs(slope))) over (partition by mission_id order by segment_id rows unbounded preceding), 6) as cumulative_energy_kwh from paced),
path_steps as (select * from steps),
paths as (select mission_id as path_id, mission_id, rover_id, null as planned_at from asks)"""
ORACLE = {
    "mission_run": with_ctes(CELLS, HAZARD, CIRCLES, OBSTACLE_STATS, PLANNING_GRIDS, MISSIONS, ROVERS_SQL, ROUTES, SUMMARY, RISK, TOP, CONTEXT, TEMPLATE)
    + f"""select m.mission_id, case when t.path_id is null then 'NO_ROUTE' else 'OK' end as status, num_waypoints, total_distance_m, mean_hazard, max_slope_deg as max_slope_encountered_deg, risk_tier, risk_score as risk_score_numeric, feasibility,
         avg_hazard_score, max_hazard_score, obstacle_count, terrain_classification, mean_slope_deg, ground_max_slope as max_slope_deg, width_m, p95_hazard, margin, summary, reasons, recommendation
       from missions m left join template t on t.path_id = m.mission_id left join (select * exclude (mission_id, terrain_source) from ctx) c on c.path_id = t.path_id
       left join (
         select tile_id as tile, case when true then {CLASS_NAME.format(area="area_fraction", slope="ms", rough="mr")} end as terrain_classification, obstacles as obstacle_count, round(ms, 3) as mean_slope_deg, round(xs, 3) as ground_max_slope,
                round(round(mh, 6), 4) as avg_hazard_score, round(round(xh, 6), 4) as max_hazard_score, round(round(p95, 6), 4) as p95_hazard, wide as width_m, {S.margin_fraction}::double as margin
         from ostats join (
           select tile_id, avg(slope_deg) as ms, max(slope_deg) as xs, avg(roughness) as mr, avg(hazard) as mh, max(hazard) as xh, quantile_cont(hazard, 0.95) as p95, round((max(x) + 1) * {S.meters_per_pixel}::double, 1) as wide
           from scored group by 1) using (tile_id)) g on g.tile = m.tile_id and t.path_id is not null""",
}
