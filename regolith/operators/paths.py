"""Path aggregates, risk, feasibility and the relational steps around missions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regolith.functions.rounding import rounded
from regolith.settings import DEFAULT, Settings


#: Energies have six decimals, so values to be rounded to four often lie halfway: this lifts them above it.
TIE = 1e-9


def feasibility(energy: Column, capacity: Column, settings: Settings = DEFAULT) -> Column:
    """Verdict on a battery; null for a capacity that is not positive. Equality falls to the better class."""
    return (
        F.when(~(capacity > 0), None)
        .when(energy > capacity, "INFEASIBLE")
        .when(energy > settings.margin_fraction * capacity, "FEASIBLE_WITH_MARGIN")
        .otherwise("FEASIBLE")
    )


def risk_tier(score: Column, settings: Settings = DEFAULT) -> Column:
    return F.when(score < settings.tier_low, "LOW").when(score <= settings.tier_medium, "MEDIUM").otherwise("HIGH")


def with_energy(steps: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """``steps`` (with kwh_per_m) and energy_cost_kwh, cumulative_energy_kwh: each rounded after it is computed whole."""
    line = Window.partitionBy("path_id").orderBy("segment_id").rowsBetween(Window.unboundedPreceding, 0)
    slope = F.abs(F.tan(F.radians("slope_deg")))
    own = F.col("kwh_per_m") * F.col("step_m") * (1 + settings.energy_slope_coefficient * slope)
    return steps.withColumn("_e", own).withColumns({"energy_cost_kwh": F.round("_e", 6), "cumulative_energy_kwh": F.round(F.sum("_e").over(line), 6)}).drop("_e")


def top_segments(steps: DataFrame, k: int) -> DataFrame:
    """The ``k`` segments of most hazard of each path, worst first; ties keep the order of travel."""
    rank = F.row_number().over(Window.partitionBy("path_id").orderBy(F.desc("hazard_score"), "segment_id"))
    return steps.withColumn("rank", rank).where(F.col("rank") <= k)


def path_summary(steps: DataFrame) -> DataFrame:
    """One row for each path that has waypoints. Decimal sums: the same in any order."""
    return steps.groupBy("path_id").agg(
        F.count("*").alias("num_waypoints"),
        F.round(F.sum("step_m"), 3).alias("total_distance_m"),
        F.round(F.max("cumulative_energy_kwh"), 6).alias("total_energy_kwh"),
        F.avg(F.col("hazard_score").cast("decimal(12,4)")).cast("double").alias("mean_hazard"),
        F.max("hazard_score").alias("max_hazard"),
        F.max(F.abs("slope_deg")).alias("max_slope_deg"),
    )


def assess(summary: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """``summary`` joined to its vehicle (capacity_kwh) with score, tier, verdict, margin and utilisation. The tier is that of
    the score before rounding."""
    use = F.col("total_energy_kwh") / F.col("capacity_kwh")
    score = settings.risk_weight_hazard * F.col("mean_hazard") + settings.risk_weight_energy * F.least(use, F.lit(1.0))
    return summary.withColumns({
        "risk_score": rounded(score, 4),
        "risk_tier": risk_tier(score, settings),
        "feasibility": feasibility(F.col("total_energy_kwh"), F.col("capacity_kwh"), settings),
        "energy_margin_kwh": rounded(F.col("capacity_kwh") - F.col("total_energy_kwh") + TIE, 4),
        "energy_utilisation": rounded(use + TIE, 4),
    })


def latest(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in ``order``."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Latest row of each key over old and new rows; of equal times the new one. Running it again changes nothing."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest(both, key, F.desc(order), F.desc("_new")).drop("_new")


def seed(seeds: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """``existing`` and the seeds whose key it lacks."""
    return existing.unionByName(seeds.join(existing.select(key), key, "left_anti"))


WAYPOINT = ("segment_id", "x", "y", "hazard_score", "slope_deg")


def pack(steps: DataFrame, fields: tuple[str, ...] = WAYPOINT) -> DataFrame:
    """(path_id, waypoints): each path's waypoints as an array in the order of travel; the first field orders."""
    return steps.groupBy("path_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("waypoints"))


def unpack(packed: DataFrame) -> DataFrame:
    """The rows that pack() took."""
    return packed.select("path_id", F.inline("waypoints"))
