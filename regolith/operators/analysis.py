"""The whole analysis of terrain, from cells to hazard, obstacles and one row for each raster, and the grids that plans use."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regolith.functions.lineage import cut
from regolith.operators import halo, regions, stencil
from regolith.operators import hazard as hz
from regolith.operators.relax import BLOCK
from regolith.settings import DEFAULT, Settings

KEYS = regions.KEYS


@dataclass(frozen=True)
class Obstacles:
    """Region cells (tile_id, y, x, label, boundary), sums of all regions, and the obstacles among these."""

    cells: DataFrame
    sums: DataFrame
    kept: DataFrame


def fields(cells: DataFrame, settings: Settings = DEFAULT, block: int = BLOCK) -> DataFrame:
    """All neighbourhood operators of cells(tile_id, y, x, intensity), computed once (halo.stencils)."""
    return cut(halo.stencils(cells, settings, block))


def find_obstacles(found: DataFrame, settings: Settings = DEFAULT) -> Obstacles:
    """From the ridges in ``found`` (fields) to regions."""
    sizes = cut(regions.sizes_of(found))
    closed = cut(halo.close(regions.edge_hysteresis(found, settings), sizes))
    parts = cut(regions.region_cells(cut(regions.filled_cells(closed, sizes))))
    sums = regions.region_sums(parts)
    return Obstacles(parts, sums, regions.obstacles(sums, settings))


def score(found: DataFrame, obstacles: Obstacles, settings: Settings = DEFAULT) -> DataFrame:
    """(tile_id, y, x, intensity, slope_deg, roughness, slope_term, obstacle_term, hazard) of every cell of ``found``."""
    distance = regions.obstacle_distance(found, regions.obstacle_mask(obstacles.cells, obstacles.kept), settings)
    terms = found.join(distance, KEYS).withColumns({"slope_term": hz.slope_term(F.col("slope_deg"), settings), "obstacle_term": hz.proximity_term(F.col("distance_m"))})
    terms = terms.withColumn("hazard", hz.hazard(F.col("slope_term"), F.col("obstacle_term"), F.col("roughness"), settings))
    return terms.select(*KEYS, "intensity", "slope_deg", "roughness", "slope_term", "obstacle_term", "hazard")


def obstacle_stats(found: DataFrame, obstacles: Obstacles) -> DataFrame:
    """(tile_id, raw_regions, obstacles, density_per_mpx, area_fraction, mean_radius_px, packed): regions seen and kept by raster, the
    share of cells that they cover, and the obstacles as an array in the order of their ids."""
    size = found.groupBy("tile_id").agg(F.count("*").alias("cells"))
    raw = obstacles.sums.groupBy("tile_id").agg(F.count("*").alias("raw_regions"))
    circles = regions.obstacle_circles(obstacles.cells, obstacles.kept)
    packed = F.array_sort(F.collect_list(F.struct("obstacle_id", "x", "y", F.round("area_px", 2).alias("area_px"), F.round("radius_px", 2).alias("radius_px"), F.round("area_m2", 2).alias("area_m2"))))
    got = circles.groupBy("tile_id").agg(F.count("*").alias("found"), F.sum("n_cells").alias("covered"), F.avg("radius_px").alias("radius"), packed.alias("packed"))
    n = F.coalesce("found", F.lit(0))
    return size.join(raw, "tile_id", "left").join(got, "tile_id", "left").select(
        "tile_id", F.coalesce("raw_regions", F.lit(0)).alias("raw_regions"), n.alias("obstacles"), F.round(n / (F.col("cells") / 1e6), 2).alias("density_per_mpx"),
        F.round(F.coalesce("covered", F.lit(0)) / F.col("cells"), 6).alias("area_fraction"), F.round(F.coalesce("radius", F.lit(0.0)), 4).alias("mean_radius_px"), "packed",
    )


def hazard_stats(scored: DataFrame) -> DataFrame:
    """Mean, greatest and 95th percentile of hazard by raster, the share above 0.6, and the means of the three terms; reads
    ``scored`` twice."""
    mean = lambda c: F.round(F.avg(c), 6)
    sums = scored.groupBy("tile_id").agg(
        mean("hazard").alias("mean_hazard"), F.round(F.max("hazard"), 6).alias("max_hazard"), mean((F.col("hazard") > 0.6).cast("double")).alias("fraction_above_0_6"),
        mean("slope_term").alias("slope_term"), mean("obstacle_term").alias("obstacle_term"), mean("roughness").alias("roughness_term"),
    )
    return sums.join(hz.exact_percentile(scored, "hazard", 0.95, 1e-4, "p95_hazard").withColumn("p95_hazard", F.round("p95_hazard", 6)), "tile_id")


def classes(found: DataFrame, stats: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """``stats`` (obstacle_stats) with mean_slope_deg, max_slope_deg, mean_roughness, width_m, height_m, terrain_class, rule_fired and
    ``evidence``: the thresholds of the rules beside the figures that met them. The class follows the figures as they are, the
    share of cells rounded to six places."""
    size = lambda c: F.round((F.max(c) + 1) * settings.meters_per_pixel, 1)
    flat = found.groupBy("tile_id").agg(
        F.avg("slope_deg").alias("_slope"), F.avg("roughness").alias("_rough"), F.round(F.max("slope_deg"), 3).alias("max_slope_deg"), size("x").alias("width_m"), size("y").alias("height_m")
    )
    name, rule = hz.classify(F.col("area_fraction"), F.col("_slope"), F.col("_rough"), settings)
    evidence = F.struct(
        F.struct(F.lit(settings.crater_min_area_fraction).alias("crater_min_area_fraction"), F.lit(settings.sandy_max_slope_deg).alias("sandy_max_slope_deg"), F.lit(settings.sandy_max_roughness).alias("sandy_max_roughness"), F.lit(settings.sandy_max_area_fraction).alias("sandy_max_area_fraction")).alias("thresholds"),
        F.round("area_fraction", 4).alias("obstacle_area_fraction"), "density_per_mpx", F.round("mean_radius_px", 2).alias("mean_radius_px"), F.round("_slope", 3).alias("mean_slope_deg"), F.round("_rough", 4).alias("mean_roughness"),
    )
    met = stats.join(flat, "tile_id").withColumns({"terrain_class": name, "rule_fired": rule, "evidence": evidence})
    return met.withColumns({"mean_slope_deg": F.round("_slope", 3), "mean_roughness": F.round("_rough", 4)}).drop("_slope", "_rough")


@dataclass(frozen=True)
class Analysis:
    """``scored`` cells and one row for each raster."""

    scored: DataFrame
    rows: DataFrame


def analyse(cells: DataFrame, settings: Settings = DEFAULT, block: int = BLOCK) -> Analysis:
    """Everything about cells(tile_id, y, x, intensity), whole rectangles. ``rows`` have all of classes() and hazard_stats()."""
    found = fields(cells, settings, block)
    obstacles = find_obstacles(found, settings)
    scored = cut(score(found, obstacles, settings))
    rows = classes(found, obstacle_stats(found, obstacles), settings).join(hazard_stats(scored), "tile_id")
    return Analysis(scored, cut(rows))


def planning_grids(scored: DataFrame, settings: Settings = DEFAULT, max_dim: int | None = None) -> DataFrame:
    """(tile_id, row, col, hazard, elevation_m, scale) of scored cells: both layers averaged by area to at most ``max_dim`` cells a
    side, six decimals; ``scale``, of four decimals, is that of a raster's pixels to its grid's cells."""
    most = settings.grid_max_dim if max_dim is None else max_dim
    ground = scored.withColumn("elevation_m", hz.elevation_m("intensity", settings))
    both = stencil.downsample(ground, "hazard", most).join(stencil.downsample(ground, "elevation_m", most).drop("scale"), ["tile_id", "row", "col"])
    return both.select("tile_id", "row", "col", F.round("hazard", 6).alias("hazard"), F.round("elevation_m", 6).alias("elevation_m"), F.round("scale", 4).alias("scale"))
