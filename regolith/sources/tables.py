"""Terrain, path and mission tables derived from the given tables, each as a DataFrame and as the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regolith.settings import ROVERS

TILE_ROWS = 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cells(tile_id, y, x, intensity): 50 vectors make the rows of one tile, their components its columns."""
    return (
        table(spark, sf_dir, "embeddings")
        .selectExpr(f"cast(vec_id div {TILE_ROWS} as string) as tile_id", f"cast(vec_id % {TILE_ROWS} as int) as y", "posexplode(embedding) as (x, e)")
        .selectExpr("tile_id", "y", "x", "cast(least(255, greatest(0, floor((cast(e as double) + 0.5) * 255))) as int) as intensity")
    )


CELLS = f"""cells as (
  select (vec_id // {TILE_ROWS})::varchar as tile_id, (vec_id % {TILE_ROWS})::int as y, x::int as x,
         least(255, greatest(0, floor((e::double + 0.5) * 255)))::int as intensity
  from (select vec_id, unnest(embedding) as e, generate_subscripts(embedding, 1) - 1 as x from embeddings))"""


def dem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dem(py, px, elevation_m): the tiles side by side as one raster, with no-data cells."""
    c = cells(spark, sf_dir)
    return c.selectExpr(
        "y as py", "cast(tile_id as int) * 64 + x as px",
        "case when (cast(tile_id as int) * 64 + x + y) % 97 = 0 then -200000 else intensity * 10 - 4000 end as elevation_m",
    )


DEM = """dem as (
  select y as py, tile_id::int * 64 + x as px,
         case when (tile_id::int * 64 + x + y) % 97 = 0 then -200000 else intensity * 10 - 4000 end as elevation_m
  from cells)"""


def crop_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey as request_id", "s_suppkey * 3.6D - 180D as lon", "90D - s_suppkey * 1.8D as lat",
        "cast(s_suppkey * 6 as int) as px", "cast(s_suppkey % 50 as int) as py", "16 as size",
    )


CROP_REQUESTS = """crop_requests as (
  select s_suppkey as request_id, s_suppkey * 3.6::double - 180 as lon, 90 - s_suppkey * 1.8::double as lat,
         (s_suppkey * 6)::int as px, (s_suppkey % 50)::int as py, 16 as size
  from supplier)"""


def rovers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROVERS, "rover_id int, rover_name string, capacity_kwh double, max_slope_deg double, kwh_per_m double")


ROVERS_SQL = "rovers as (select * from (values {}) v(rover_id, rover_name, capacity_kwh, max_slope_deg, kwh_per_m))".format(
    ", ".join(f"({i}, '{n}', {c}::double, {s}::double, {k}::double)" for i, n, c, s, k in ROVERS)
)


def path_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path_steps(path_id, segment_id, x, y, hazard_score, slope_deg, step_m): waypoints before their energy is known."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return (
        table(spark, sf_dir, "lineitem")
        .withColumn("segment_id", (F.row_number().over(order) - 1).cast("int"))
        .selectExpr(
            "l_orderkey as path_id", "segment_id", "cast(l_partkey % 512 as int) as x", "cast(l_suppkey % 512 as int) as y",
            "round(cast(l_discount as double) * 10, 4) as hazard_score", "round((cast(l_tax as double) - 0.04D) * 500, 3) as slope_deg",
            "case when segment_id = 0 then 0D else cast(l_quantity as double) * 10 end as step_m",
        )
    )


PATH_STEPS = """path_steps as (
  select l_orderkey as path_id, segment_id, (l_partkey % 512)::int as x, (l_suppkey % 512)::int as y,
         round(l_discount::double * 10, 4) as hazard_score, round((l_tax::double - 0.04::double) * 500, 3) as slope_deg,
         case when segment_id = 0 then 0 else l_quantity::double * 10 end as step_m
  from (select *, (row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) - 1)::int as segment_id from lineitem))"""


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """paths(path_id, mission_id, rover_id, planned_at): orders; some have no waypoint, some name an unknown vehicle."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as path_id", "o_custkey as mission_id", "cast(o_custkey % 3 as int) as rover_id", "cast(o_orderdate as timestamp) as planned_at"
    )


PATHS = """paths as (
  select o_orderkey as path_id, o_custkey as mission_id, (o_custkey % 3)::int as rover_id, o_orderdate::timestamp as planned_at from orders)"""


def missions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """missions(mission_id, name, terrain_source, terrain_image_path, tile_id, created_at): customers; some have no source."""
    tiles = table(spark, sf_dir, "embeddings").agg((F.max(F.expr(f"vec_id div {TILE_ROWS}")) + 1).alias("tiles"))
    return table(spark, sf_dir, "customer").crossJoin(F.broadcast(tiles)).selectExpr(  # one row
        "c_custkey as mission_id", "c_name as name", "case when c_custkey % 7 = 0 then null else c_mktsegment end as terrain_source",
        "case when c_custkey % 5 = 0 then concat('/tmp/', c_custkey, '/terrain.png') else concat('/srv/storage/', c_custkey, '/terrain.png') end as terrain_image_path",
        "cast(c_custkey % tiles as string) as tile_id", "timestamp_seconds(1700000000 + (c_custkey * 7919) % 86400) as created_at",
    )


MISSIONS = f"""missions as (
  select c_custkey as mission_id, c_name as name, case when c_custkey % 7 = 0 then null else c_mktsegment end as terrain_source,
         case when c_custkey % 5 = 0 then '/tmp/' || c_custkey || '/terrain.png' else '/srv/storage/' || c_custkey || '/terrain.png' end as terrain_image_path,
         (c_custkey % (select max(vec_id // {TILE_ROWS}) + 1 from embeddings))::varchar as tile_id,
         make_timestamp(((1700000000 + (c_custkey * 7919) % 86400) * 1000000)::bigint) as created_at
  from customer)"""


# The life of a mission by the event that moves it.
STATUS_OF_EVENT = {"signup": "PENDING", "view": "ANALYZED", "click": "PATH_PLANNED", "purchase": "RISK_ASSESSED", "error": "REPORT_GENERATED"}


def status_events(events: DataFrame) -> DataFrame:
    """status_events(event_id, ts, mission_id, status) of the events table or a stream of it."""
    names = F.create_map(*(F.lit(x) for pair in STATUS_OF_EVENT.items() for x in pair))
    return events.select("event_id", "ts", F.col("user_id").alias("mission_id"), names[F.col("event_type")].alias("status"))


STATUS_EVENTS = "status_events as (select event_id, ts, user_id as mission_id, case event_type {} end as status from events)".format(
    " ".join(f"when '{k}' then '{v}'" for k, v in STATUS_OF_EVENT.items())
)


def with_ctes(*ctes: str) -> str:
    return "with recursive " + ",\n".join(ctes) + "\n"
