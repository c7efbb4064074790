"""Rules that requests, vehicles and stored records must keep; each marks or separates rows, none raises."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def validate_rovers(rovers: DataFrame) -> DataFrame:
    """``rovers`` (rover_name, capacity_kwh, max_slope_deg) with reject_reason, null for a sound one."""
    return rovers.withColumn(
        "reject_reason",
        F.when(~F.coalesce(F.length("rover_name").between(1, 100), F.lit(False)), "name length")
        .when(~F.coalesce(F.col("capacity_kwh") > 0, F.lit(False)), "capacity")
        .when(~F.coalesce((F.col("max_slope_deg") > 0) & (F.col("max_slope_deg") <= 89), F.lit(False)), "slope limit"),
    )


def validate_requests(requests: DataFrame) -> DataFrame:
    """``requests`` with reject_reason: those of start_x, start_y, goal_x, goal_y that are there must not be negative, a name
    has 1 to 200 characters."""
    reason = F.lit(None).cast("string")
    if "name" in requests.columns:
        reason = F.when(~F.coalesce(F.length("name").between(1, 200), F.lit(False)), "name length")
    for end in ("goal", "start"):
        for axis in ("y", "x"):
            if f"{end}_{axis}" in requests.columns:
                reason = F.when(F.coalesce(F.col(f"{end}_{axis}") < 0, F.lit(True)), end).otherwise(reason)
    return requests.withColumn("reject_reason", reason)


def static_url(path: str, root: str = "/srv/storage", prefix: str = "/static") -> Column:
    """Served address of a file below the storage root; anything else has none."""
    root = root.rstrip("/") + "/"
    return F.when(F.col(path).startswith(root), F.concat(F.lit(prefix.rstrip("/") + "/"), F.substring(F.col(path), len(root) + 1, 2**31 - 1)))


def strip_key(metadata: str | Column, key: str) -> Column:
    """A metadata map without one key."""
    return F.map_filter(metadata, lambda k, v: k != key)


def extract(metadata: str, **fields: tuple[str, str]) -> list[Column]:
    """Columns read out of a JSON text: name=(path, type). What is missing or of another type is null."""
    return [F.expr(f"try_cast(get_json_object({metadata}, '{path}') as {kind})").alias(name) for name, (path, kind) in fields.items()]


def stage_gate(missions: DataFrame, analyses: DataFrame, paths: DataFrame) -> DataFrame:
    """(mission_id, outcome): what a request for each mission's report would meet first. Gates test that rows exist."""
    has = lambda df, name: df.select("mission_id").distinct().withColumn(name, F.lit(True))
    met = missions.select("mission_id").join(has(analyses, "analysed"), "mission_id", "left").join(has(paths, "planned"), "mission_id", "left")
    return met.select("mission_id", F.when(F.col("analysed").isNull(), "terrain not analysed").when(F.col("planned").isNull(), "no path planned").otherwise("ok").alias("outcome"))


def foreign_paths(requests: DataFrame, paths: DataFrame) -> DataFrame:
    """Of ``requests`` (path_id, mission_id) those whose path is not the mission's."""
    return requests.join(paths.select("path_id", "mission_id"), ["path_id", "mission_id"], "left_anti").withColumn("reason", F.lit("path belongs to another mission"))


def unknown_rovers(requests: DataFrame, rovers: DataFrame) -> DataFrame:
    """Of ``requests`` (rover_id) those whose vehicle does not exist."""
    return requests.join(rovers.select("rover_id"), "rover_id", "left_anti")
