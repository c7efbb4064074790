"""Queries over paths, vehicles, missions and DEM windows, and the SQL that checks them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regolith.functions.lineage import shared_dir
from regolith.operators import dem as dm
from regolith.operators import paths as pt
from regolith.operators import rules
from regolith.settings import DEFAULT as D
from regolith.settings import DEM_COLUMNS, DEM_METERS_PER_PIXEL, DEM_ROWS, IMAGE_SUFFIXES, MAX_UPLOAD_BYTES, NO_DATA, ROVERS
from regolith.sources.images import screen
from regolith.sources.store import read_grids, write_grids
from regolith.sources.tables import (
    CELLS, CROP_REQUESTS, DEM, MISSIONS, PATH_STEPS, PATHS, ROVERS_SQL, STATUS_EVENTS,
    cells, crop_requests, dem, missions, path_steps, paths, rovers, status_events, table, with_ctes,
)

# --- waypoints and paths -----------------------------------------------------------------------------------------


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waypoints with energy, for the vehicle of their path."""
    about = paths(spark, sf_dir).join(F.broadcast(rovers(spark).select("rover_id", "kwh_per_m")), "rover_id").select("path_id", "kwh_per_m")
    return pt.with_energy(path_steps(spark, sf_dir).join(about, "path_id"), D)


STEPS = f"""costed as (
  select s.*, v.kwh_per_m, v.kwh_per_m * step_m * (1 + {D.energy_slope_coefficient}::double * abs(tan(radians(slope_deg)))) as e
  from path_steps s join paths p using (path_id) join rovers v on v.rover_id = p.rover_id),
steps as (
  select * exclude (e), round(e, 6) as energy_cost_kwh, round(sum(e) over (partition by path_id order by segment_id rows unbounded preceding), 6) as cumulative_energy_kwh from costed)"""
SUMMARY = """summary as (
  select path_id, count(*) as num_waypoints, round(sum(step_m), 3) as total_distance_m, max(cumulative_energy_kwh) as total_energy_kwh,
         round(avg(hazard_score), 8) as mean_hazard, max(hazard_score) as max_hazard, max(abs(slope_deg)) as max_slope_deg from steps group by path_id)"""
RISK = f"""risk0 as (
  select s.*, p.mission_id, p.planned_at, p.rover_id, v.capacity_kwh, v.rover_name, v.max_slope_deg as rover_max_slope_deg, v.kwh_per_m,
         {D.risk_weight_hazard}::double * mean_hazard + {D.risk_weight_energy}::double * least(total_energy_kwh / capacity_kwh, 1) as score
  from summary s join paths p using (path_id) join rovers v on v.rover_id = p.rover_id),
risk as (
  select * exclude (score), round(score, 4) as risk_score, case when score < {D.tier_low} then 'LOW' when score <= {D.tier_medium} then 'MEDIUM' else 'HIGH' end as risk_tier,
         case when total_energy_kwh > capacity_kwh then 'INFEASIBLE' when total_energy_kwh > {D.margin_fraction}::double * capacity_kwh then 'FEASIBLE_WITH_MARGIN' else 'FEASIBLE' end as feasibility,
         round(capacity_kwh - total_energy_kwh + {pt.TIE}::double, 4) as energy_margin_kwh, round(total_energy_kwh / capacity_kwh + {pt.TIE}::double, 4) as energy_utilisation from risk0)"""
PATH_CTES = (PATH_STEPS, PATHS, ROVERS_SQL, STEPS, SUMMARY, RISK)


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pt.path_summary(steps(spark, sf_dir)).withColumn("mean_hazard", F.round("mean_hazard", 8))


def risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    fleet = rovers(spark).withColumnRenamed("max_slope_deg", "rover_max_slope_deg")
    about = paths(spark, sf_dir).join(F.broadcast(fleet), "rover_id")
    return pt.assess(summaries(spark, sf_dir).join(about, "path_id"), D)


def waypoint_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps(spark, sf_dir).select("path_id", "segment_id", "x", "y", "hazard_score", "slope_deg", F.round("step_m", 3).alias("step_distance_m"), "energy_cost_kwh")


def cumulative_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps(spark, sf_dir).select("path_id", "segment_id", "cumulative_energy_kwh")


def top_hazard_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pt.top_segments(path_steps(spark, sf_dir), 5).select("path_id", "rank", "segment_id", "x", "y", "hazard_score", "slope_deg")


def path_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths without waypoints are rows with a reject reason."""
    return paths(spark, sf_dir).select("path_id").join(summaries(spark, sf_dir), "path_id", "left").withColumn(
        "reject_reason", F.when(F.col("num_waypoints").isNull(), "empty path")
    )


def mission_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risks(spark, sf_dir).select("path_id", "mean_hazard", "risk_score", "risk_tier", "feasibility", "energy_margin_kwh", "energy_utilisation")


def feasibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risks(spark, sf_dir).select("path_id", "rover_id", "total_energy_kwh", "feasibility")


def risk_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risks(spark, sf_dir).groupBy("risk_tier").agg(F.count("*").alias("paths"), F.min("risk_score").alias("low"), F.max("risk_score").alias("high"))


def feasibility_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every path's distance and slopes for every vehicle: paths by verdict."""
    use = path_steps(spark, sf_dir).groupBy("path_id").agg(F.sum(F.round(F.col("step_m") * (1 + D.energy_slope_coefficient * F.abs(F.tan(F.radians("slope_deg")))), 6).cast("decimal(18,6)")).cast("double").alias("metres"))
    every = use.crossJoin(F.broadcast(rovers(spark)))  # three vehicles
    verdict = every.withColumn("feasibility", pt.feasibility(F.col("metres") * F.col("kwh_per_m"), F.col("capacity_kwh"), D))
    pivoted = verdict.groupBy("rover_id").pivot("feasibility", ["INFEASIBLE", "FEASIBLE_WITH_MARGIN", "FEASIBLE"]).count()
    return pivoted.select("rover_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c.lower()) for c in pivoted.columns[1:]))


def latest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pt.latest(paths(spark, sf_dir), "mission_id", F.desc("planned_at"), F.desc("path_id"))


def list_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("mission_id").orderBy("planned_at", "path_id"))
    return paths(spark, sf_dir).withColumn("place", place).orderBy("mission_id", "place")


def pack_waypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered arrays of waypoints, shown by size, segment order and ends."""
    w = F.col("waypoints")
    return pt.pack(path_steps(spark, sf_dir)).select(
        "path_id", F.size(w).alias("n"), F.array_join(F.transform(w, lambda s: s.segment_id.cast("string")), ",").alias("segments"),
        F.element_at(w, 1).x.alias("first_x"), F.element_at(w, -1).y.alias("last_y"), F.aggregate(w, F.lit(0.0), lambda a, s: F.greatest(a, s.hazard_score)).alias("max_hazard"),
    )


def unpack_waypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pt.unpack(pt.pack(path_steps(spark, sf_dir)))


# --- missions ----------------------------------------------------------------------------------------------------

#: Missions whose tile was analysed, and when: all but every eleventh.
ANALYSES = "analyses as (select mission_id, tile_id, created_at + interval 1 hour as analyzed_at from missions where mission_id % 11 <> 0)"


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missions(spark, sf_dir).where("mission_id % 11 <> 0").select("mission_id", "tile_id", F.expr("created_at + interval 1 hour").alias("analyzed_at"))


def report_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mission, analysis, latest path and vehicle of every mission that has all four."""
    path = latest_path(spark, sf_dir).join(F.broadcast(rovers(spark)), "rover_id")
    return missions(spark, sf_dir).select("mission_id", "name", "tile_id").join(analyses(spark, sf_dir).select("mission_id", "analyzed_at"), "mission_id").join(path, "mission_id").select(
        "mission_id", "name", "tile_id", "analyzed_at", "path_id", "planned_at", "rover_name", "capacity_kwh"
    )


def stage_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.stage_gate(missions(spark, sf_dir), analyses(spark, sf_dir), paths(spark, sf_dir))


def path_owner_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests name a path and a mission, every fourth the wrong one."""
    asked = paths(spark, sf_dir).select("path_id", (F.col("mission_id") + (F.col("path_id") % 4 == 0).cast("int")).alias("mission_id"))
    return rules.foreign_paths(asked, paths(spark, sf_dir))


def unknown_rover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.unknown_rovers(paths(spark, sf_dir).select("path_id", (F.col("path_id") % 5).cast("int").alias("rover_id")), rovers(spark))


def mission_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every mission with what it has of analysis, latest path and its risk."""
    path = latest_path(spark, sf_dir).select("mission_id", "path_id")
    risk = risks(spark, sf_dir).select("path_id", "risk_tier", "feasibility")
    return (
        missions(spark, sf_dir).select("mission_id", "name").join(analyses(spark, sf_dir).select("mission_id", "analyzed_at"), "mission_id", "left")
        .join(path, "mission_id", "left").join(risk, "path_id", "left").select("mission_id", "name", "analyzed_at", "path_id", "risk_tier", "feasibility")
    )


def list_missions(spark: SparkSession, sf_dir: str, limit: int = 500, offset: int = 20) -> DataFrame:
    """A page of the missions, newest first; a page has at most 200."""
    m = missions(spark, sf_dir).select("mission_id", "name", "created_at")
    return m.orderBy(F.desc("created_at"), "mission_id").offset(offset).limit(min(limit, 200))


def list_rovers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fleet of suppliers and seeds by name."""
    return seed_rovers(spark, sf_dir).orderBy("rover_name")


def _own_rovers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vehicles already known: one for each supplier, of which the fifth is a seed's namesake."""
    return table(spark, sf_dir, "supplier").select(
        F.when(F.col("s_suppkey") == 5, ROVERS[0][1]).otherwise(F.col("s_name")).alias("rover_name"), F.round(F.col("s_acctbal") / 1000, 3).alias("capacity_kwh"), F.col("s_suppkey").cast("double").alias("max_slope_deg")
    )


OWN_ROVERS = f"own_rovers as (select case when s_suppkey = 5 then '{ROVERS[0][1]}' else s_name end as rover_name, round(s_acctbal / 1000, 3) as capacity_kwh, s_suppkey::double as max_slope_deg from supplier)"
SEEDED = "seeded as (select * from own_rovers union all select rover_name, capacity_kwh, max_slope_deg from rovers where rover_name not in (select rover_name from own_rovers))"


def seed_rovers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pt.seed(rovers(spark).select("rover_name", "capacity_kwh", "max_slope_deg"), _own_rovers(spark, sf_dir), "rover_name")


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of each path from two runs: the later wins, of equal times the new one."""
    p = paths(spark, sf_dir).select("path_id", "planned_at")
    old = p.where("path_id % 3 <> 0").select("path_id", F.col("planned_at").alias("generated_at"), F.lit("old").alias("run"))
    new = p.where("path_id % 2 = 0").select("path_id", F.expr("planned_at + make_interval(0, 0, 0, cast(path_id % 3 as int) - 1)").alias("generated_at"), F.lit("new").alias("run"))
    return pt.upsert(old, new, "path_id", "generated_at")


def mission_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of every mission: the last action, not the farthest."""
    e = status_events(table(spark, sf_dir, "events"))
    return e.groupBy("mission_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.count("*").alias("events"))


def missing_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missions that ask for a plan though their tile has no stored grid (odd tiles have none)."""
    folder = f"{shared_dir(spark)}/grids-{uuid.uuid4().hex}"
    write_grids(cells(spark, sf_dir).where("cast(tile_id as int) % 2 = 0").select("tile_id", F.col("y").alias("row"), F.col("x").alias("col"), "intensity"), folder)
    return read_grids(spark, folder, missions(spark, sf_dir).select("mission_id", "tile_id"))[1]


def upload_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads named after documents, of their text's size times 4000, by suffix and size."""
    suffixes = F.array(*(F.lit(s) for s in ("", ".PNG", ".exe", ".jpeg", ".tar.gz", ".tif")))
    up = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("/in/f"), F.col("doc_id").cast("string"), F.element_at(suffixes, (F.col("doc_id") % 6 + 1).cast("int"))).alias("path"), (F.col("n_chars") * 4000).alias("length")
    )
    return screen(up)


def static_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missions(spark, sf_dir).select("mission_id", rules.static_url("terrain_image_path").alias("url"))


def validate_rovers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.validate_rovers(_own_rovers(spark, sf_dir))


def validate_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") - 5).alias("start_x"), (F.col("p_partkey") % 7 - 1).cast("int").alias("goal_y"), F.repeat("p_name", F.col("p_size")).alias("name"))
    return rules.validate_requests(p).select("p_partkey", "start_x", "goal_y", F.length("name").alias("name_length"), "reject_reason")


# --- DEM ---------------------------------------------------------------------------------------------------------


def lonlat_pixel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dm.lonlat_pixel(crop_requests(spark, sf_dir).select("request_id", "lon", "lat"))


def _crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows read back from the raster as a table of bands."""
    d, asked = dem(spark, sf_dir), crop_requests(spark, sf_dir)
    rows, columns = d.agg(F.max("py") + 1, F.max("px") + 1).first()
    folder = f"{shared_dir(spark)}/dem-{uuid.uuid4().hex}"
    dm.write_blocks(d, folder)
    return dm.crop(asked, dm.read_blocks(spark, folder, asked, rows, columns), rows, columns)


def dem_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _crops(spark, sf_dir)


def dem_relief(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dm.relief(_crops(spark, sf_dir))


def dem_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _crops(spark, sf_dir)
    return dm.rescale(c, dm.relief(c))


def crop_sidecar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dm.sidecar(dm.relief(_crops(spark, sf_dir)), crop_requests(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        waypoint_metrics, cumulative_energy, top_hazard_segments, path_summary, mission_risk, feasibility, risk_tier, feasibility_matrix, latest_path, list_paths, pack_waypoints, unpack_waypoints,
        report_input, stage_gate, path_owner_check, unknown_rover, mission_overview, list_missions, list_rovers, seed_rovers, upsert_latest, mission_status, missing_grids, upload_screen, static_url,
        validate_rovers, validate_requests, lonlat_pixel, dem_crop, dem_relief, dem_rescale, crop_sidecar,
    )
}

LATEST = "latest as (select * from paths qualify row_number() over (partition by mission_id order by planned_at desc, path_id desc) = 1)"
CROPS = f"""dim_ as (select max(py) + 1 as nr, max(px) + 1 as nc from dem),
asked as (select request_id, size, greatest(0, least(nc - size, px - size // 2)) as x0, greatest(0, least(nr - size, py - size // 2)) as y0 from crop_requests, dim_),
crops as (
  select request_id, (py - y0)::int as y, (px - x0)::int as x, case when elevation_m > {NO_DATA} then elevation_m end as elevation_m
  from asked join dem on px between x0 and x0 + size - 1 and py between y0 and y0 + size - 1),
relief as (
  select *, case when low is null then 'no valid elevation' when relief < 1e-6 then 'flat window' end as reject_reason
  from (select request_id, min(elevation_m) as low, max(elevation_m) as high, max(elevation_m) - min(elevation_m) as relief from crops group by 1))"""
DEM_CTES = (CELLS, DEM, CROP_REQUESTS, CROPS)
PACKED = "packed as (select path_id, list({'segment_id': segment_id, 'x': x, 'y': y, 'hazard_score': hazard_score, 'slope_deg': slope_deg} order by segment_id) as w from path_steps group by 1)"

ORACLE = {
    "waypoint_metrics": with_ctes(*PATH_CTES) + "select path_id, segment_id, x, y, hazard_score, slope_deg, round(step_m, 3) as step_distance_m, energy_cost_kwh from steps",
    "cumulative_energy": with_ctes(*PATH_CTES) + "select path_id, segment_id, cumulative_energy_kwh from steps",
    "top_hazard_segments": with_ctes(PATH_STEPS)
    + "select path_id, rank::int as rank, segment_id, x, y, hazard_score, slope_deg from (select *, row_number() over (partition by path_id order by hazard_score desc, segment_id) as rank from path_steps) where rank <= 5",
    "path_summary": with_ctes(*PATH_CTES) + "select p.path_id, s.* exclude (path_id), case when s.path_id is null then 'empty path' end as reject_reason from paths p left join summary s using (path_id)",
    "mission_risk": with_ctes(*PATH_CTES) + "select path_id, mean_hazard, risk_score, risk_tier, feasibility, energy_margin_kwh, energy_utilisation from risk",
    "feasibility": with_ctes(*PATH_CTES) + "select path_id, rover_id, total_energy_kwh, feasibility from risk",
    "risk_tier": with_ctes(*PATH_CTES) + "select risk_tier, count(*) as paths, min(risk_score) as low, max(risk_score) as high from risk group by 1",
    "feasibility_matrix": with_ctes(PATH_STEPS, ROVERS_SQL)
    + f"""select rover_id, count(*) filter (e > capacity_kwh) as infeasible, count(*) filter (e <= capacity_kwh and e > {D.margin_fraction}::double * capacity_kwh) as feasible_with_margin,
         count(*) filter (e <= {D.margin_fraction}::double * capacity_kwh) as feasible
       from (select rover_id, capacity_kwh, metres * kwh_per_m as e from rovers cross join
         (select path_id, sum(round(step_m * (1 + {D.energy_slope_coefficient}::double * abs(tan(radians(slope_deg)))), 6)::decimal(18,6))::double as metres from path_steps group by 1)) group by 1""",
    "latest_path": with_ctes(PATHS, LATEST) + "select * from latest",
    "list_paths": with_ctes(PATHS) + "select *, row_number() over (partition by mission_id order by planned_at, path_id)::int as place from paths",
    "pack_waypoints": with_ctes(PATH_STEPS, PACKED)
    + """select path_id, len(w)::int as n, array_to_string(list_transform(w, lambda s: s.segment_id::varchar), ',') as segments, w[1].x as first_x, w[-1].y as last_y,
         list_max(list_transform(w, lambda s: s.hazard_score)) as max_hazard from packed""",
    "unpack_waypoints": with_ctes(PATH_STEPS) + "select path_id, segment_id, x, y, hazard_score, slope_deg from path_steps",
    "report_input": with_ctes(MISSIONS, ANALYSES, PATHS, LATEST, ROVERS_SQL)
    + "select m.mission_id, m.name, m.tile_id, analyzed_at, path_id, planned_at, rover_name, capacity_kwh from missions m join analyses a using (mission_id) join latest l using (mission_id) join rovers using (rover_id)",
    "stage_gate": with_ctes(MISSIONS, ANALYSES, PATHS)
    + """select mission_id, case when mission_id not in (select mission_id from analyses) then 'terrain not analysed'
         when mission_id not in (select mission_id from paths) then 'no path planned' else 'ok' end as outcome from missions""",
    "path_owner_check": with_ctes(PATHS)
    + "select path_id, mission_id + (path_id % 4 = 0)::int as mission_id, 'path belongs to another mission' as reason from paths where path_id % 4 = 0",
    "unknown_rover": with_ctes(PATHS) + "select path_id, (path_id % 5)::int as rover_id from paths where path_id % 5 > 2",
    "mission_overview": with_ctes(*PATH_CTES, MISSIONS, ANALYSES, LATEST)
    + "select m.mission_id, m.name, analyzed_at, l.path_id, risk_tier, feasibility from missions m left join analyses using (mission_id) left join latest l using (mission_id) left join risk r on r.path_id = l.path_id",
    "list_missions": with_ctes(MISSIONS) + "select mission_id, name, created_at from missions order by created_at desc, mission_id limit 200 offset 20",
    "list_rovers": with_ctes(ROVERS_SQL, OWN_ROVERS, SEEDED) + "select * from seeded",
    "seed_rovers": with_ctes(ROVERS_SQL, OWN_ROVERS, SEEDED) + "select * from seeded",
    "upsert_latest": with_ctes(PATHS)
    + """select path_id, generated_at, run from (
         select path_id, planned_at as generated_at, 'old' as run, 0 as n from paths where path_id % 3 <> 0
         union all select path_id, planned_at + to_days((path_id % 3)::int - 1), 'new', 1 from paths where path_id % 2 = 0)
       qualify row_number() over (partition by path_id order by generated_at desc, n desc) = 1""",
    "mission_status": with_ctes(STATUS_EVENTS) + "select mission_id, arg_max(status, (ts, event_id)) as status, count(*) as events from status_events group by 1",
    "missing_grids": with_ctes(CELLS, MISSIONS)
    + "select mission_id, tile_id, 'no planning grid' as reason from missions where tile_id not in (select tile_id from cells where tile_id::int % 2 = 0)",
    "upload_screen": f"""select path, length, case when lower(regexp_extract(path, '(\\.[^./]+)$', 1)) not in {IMAGE_SUFFIXES} then 'unsupported type' when length > {MAX_UPLOAD_BYTES} then 'too large' end as reject_reason
       from (select '/in/f' || doc_id || (['', '.PNG', '.exe', '.jpeg', '.tar.gz', '.tif'])[doc_id % 6 + 1] as path, n_chars * 4000 as length from documents)""",
    "static_url": with_ctes(MISSIONS)
    + "select mission_id, case when starts_with(terrain_image_path, '/srv/storage/') then '/static/' || substr(terrain_image_path, 14) end as url from missions",
    "validate_rovers": with_ctes(OWN_ROVERS)
    + """select *, case when length(rover_name) not between 1 and 100 then 'name length' when not capacity_kwh > 0 then 'capacity'
         when not (max_slope_deg > 0 and max_slope_deg <= 89) then 'slope limit' end as reject_reason from own_rovers""",
    "validate_requests": """select p_partkey, start_x, goal_y, length(name)::int as name_length, case when start_x < 0 then 'start' when goal_y < 0 then 'goal' when length(name) not between 1 and 200 then 'name length' end as reject_reason
       from (select p_partkey, p_size - 5 as start_x, (p_partkey % 7 - 1)::int as goal_y, repeat(p_name, p_size) as name from part)""",
    "lonlat_pixel": with_ctes(CROP_REQUESTS)
    + f"""select request_id, lon, lat, case when ok then round_even((lon + 180) / 360 * {DEM_COLUMNS}, 0)::int end as "column", case when ok then round_even((90 - lat) / 180 * {DEM_ROWS}, 0)::int end as "row",
         case when lon not between -180 and 180 then 'longitude out of range' when lat not between -90 and 90 then 'latitude out of range' end as reject_reason
       from (select *, lon between -180 and 180 and lat between -90 and 90 as ok from crop_requests)""",
    "dem_crop": with_ctes(*DEM_CTES) + "select * from crops",
    "dem_relief": with_ctes(*DEM_CTES) + "select * from relief",
    "dem_rescale": with_ctes(*DEM_CTES)
    + "select request_id, y, x, floor((coalesce(elevation_m, low) - low) / relief * 255.0::double)::int as intensity from crops join relief using (request_id) where reject_reason is null",
    "crop_sidecar": with_ctes(*DEM_CTES)
    + f"""select request_id, px, py, size as tile_size_px, round(size * {DEM_METERS_PER_PIXEL}::double / 1000, 2) as ground_coverage_km, round(low::double, 2) as min_elevation_m, round(high::double, 2) as max_elevation_m,
         round(relief::double, 2) as elevation_range_m, {DEM_METERS_PER_PIXEL}::double as meters_per_pixel from relief join crop_requests using (request_id) where reject_reason is null""",
}
