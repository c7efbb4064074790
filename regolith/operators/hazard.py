"""Elevation, hazard terms and scores, per-tile statistics and terrain classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regolith import wording as words
from regolith.settings import DEFAULT, Settings


def clip(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def elevation_m(intensity: str, settings: Settings = DEFAULT) -> Column:
    return F.col(intensity) / F.lit(255.0) * F.lit(settings.elevation_range_m)


def slope_term(slope_deg: Column, settings: Settings = DEFAULT) -> Column:
    return clip(slope_deg / F.lit(settings.slope_reference_deg))


def proximity_term(distance_m: Column) -> Column:
    return 1.0 / (1.0 + F.greatest(F.lit(0.0), distance_m))


def hazard(slope: Column, proximity: Column, roughness: Column, settings: Settings = DEFAULT) -> Column:
    """Weighted sum of the three terms in [0, 1]; the weights were checked when the settings were made."""
    return clip(settings.weight_slope * slope + settings.weight_obstacle * proximity + settings.weight_roughness * roughness)


def display_level(value: Column) -> Column:
    """0 to 255 of a value that saturates at 0 and 1."""
    return F.floor(clip(value) * 255).cast("int")


def edge_thresholds(edges: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """(tile_id, low, high): the percentile of gradient magnitude, at least 1, and a share of it. Magnitudes come from
    few integer m2, so they are counted first and a tile's percentile is over counts, not over its cells."""
    counted = edges.groupBy("tile_id", "m2").count()
    top = F.percentile(F.sqrt(F.col("m2").cast("double")), F.lit(settings.edge_percentile), F.col("count"))
    return counted.groupBy("tile_id").agg(F.greatest(F.lit(1.0), top).alias("high")).withColumn("low", F.col("high") * settings.edge_low_ratio)


def exact_percentile(df: DataFrame, value: str, share: float, width: float, name: str) -> DataFrame:
    """(tile_id, name): the percentile, linear between ranks, of ``value`` in each tile. Values are counted by bins of ``width``
    first; of the bins that hold the two ranks they are then counted one by one, so that neither a mosaic nor a value that most
    of its cells share gathers in one buffer. Reads ``df`` twice."""
    binned = df.select("tile_id", F.col(value).alias("_v"), F.floor(F.col(value) / width).alias("_b"))
    counts = binned.groupBy("tile_id", "_b").agg(F.count("*").alias("_c"))
    line = Window.partitionBy("tile_id")
    ranked = counts.withColumns({"_to": F.sum("_c").over(line.orderBy("_b")), "_rank": (F.sum("_c").over(line) - 1) * F.lit(share)})
    ranked = ranked.withColumns({"_from": F.col("_to") - F.col("_c"), "_low": F.floor("_rank"), "_high": F.ceil("_rank")})
    held = ranked.where("_low between _from and _to - 1 or _high between _from and _to - 1").select("tile_id", "_b", "_from", "_rank", "_low", "_high")
    each = binned.join(held, ["tile_id", "_b"]).groupBy("tile_id", "_v").agg(F.count("*").alias("_c"), F.min("_from").alias("_from"), *(F.first(c).alias(c) for c in ("_rank", "_low", "_high")))
    upto = each.withColumn("_upto", F.min("_from").over(line) + F.sum("_c").over(line.orderBy("_v")))  # values of this size or less
    at = lambda rank: F.min(F.when(F.col("_upto") > F.col(rank), F.col("_v")))
    found = upto.groupBy("tile_id").agg(at("_low").alias("_a"), at("_high").alias("_z"), F.first("_rank").alias("_rank"), F.first("_low").alias("_low"))
    return found.select("tile_id", (F.col("_a") + (F.col("_z") - F.col("_a")) * (F.col("_rank") - F.col("_low"))).alias(name))


def classify(area_fraction: Column, mean_slope: Column, mean_roughness: Column, settings: Settings = DEFAULT) -> tuple[Column, Column]:
    """Terrain class by ordered rules, and the rule that decided."""
    crater = area_fraction >= settings.crater_min_area_fraction
    sandy = (mean_slope <= settings.sandy_max_slope_deg) & (mean_roughness <= settings.sandy_max_roughness) & (area_fraction < settings.sandy_max_area_fraction)
    name = F.when(crater, "crater_field").when(sandy, "sandy_plain").otherwise("rocky_highland")
    rule = F.when(
        crater, F.format_string(words.CRATER_RULE, F.round(area_fraction, 3), F.lit(settings.crater_min_area_fraction))
    ).when(sandy, words.SANDY_RULE)
    return name, rule.otherwise(words.ROCKY_RULE)
