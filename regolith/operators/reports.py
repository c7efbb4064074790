"""Structured context of a path's report, the template report, and checks of model replies."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regolith import wording as words
from regolith.functions.rounding import rounded
from regolith.operators.paths import TIE
from regolith.settings import DEFAULT, Settings

REQUIRED = ("summary", "top_risks", "recommendation")


def fixed(value: str | Column, places: int) -> Column:
    """A number with fixed decimals."""
    return F.format_string(f"%.{places}f", value)


def structured_context(risks: DataFrame, missions: DataFrame, segments: DataFrame, terrain: DataFrame | None = None, settings: Settings = DEFAULT) -> DataFrame:
    """(path_id, context): one nested row of all figures that a report may tell. ``segments`` has each path's worst. With
    ``terrain``, rows of analysis.analyse for the tiles of missions, it tells of the terrain too, and on what basis hazard
    and risk were computed."""
    worst = segments.groupBy("path_id").agg(F.array_sort(F.collect_list(F.struct("rank", "segment_id", "x", "y", "hazard_score", "slope_deg"))).alias("worst"))
    about = missions.select("mission_id", F.col("name").alias("mission_name"), "terrain_source", *(["tile_id"] if terrain is not None else []))
    met = risks.join(about, "mission_id").join(worst, "path_id")
    more = []
    if terrain is not None:
        summary = F.struct(
            rounded("mean_hazard", 4).alias("avg_hazard_score"), rounded("max_hazard", 4).alias("max_hazard_score"), F.col("obstacles").alias("obstacle_count"),
            F.col("terrain_class").alias("terrain_classification"), "mean_slope_deg", "max_slope_deg", F.struct("width_m", "height_m").alias("area_covered_m"),
        )
        ground = terrain.select("tile_id", summary.alias("_terrain")).join(hazard_basis(terrain, settings).withColumnRenamed("basis", "_hazard"), "tile_id")
        met = met.join(ground, "tile_id").join(audit_basis(risks, settings).withColumnRenamed("basis", "_risk"), "path_id")
        more = [F.col("_terrain").alias("terrain_summary"), F.struct(F.col("_hazard").alias("hazard"), F.col("_risk").alias("risk")).alias("calculation_basis")]
    context = F.struct(
        "mission_id",
        "mission_name",
        F.coalesce("terrain_source", F.lit("unspecified")).alias("terrain_source"),
        F.struct(
            "total_distance_m", rounded(F.col("total_energy_kwh") + TIE, 4).alias("total_energy_cost_kwh"), "num_waypoints", "mean_hazard", "max_hazard",
            F.col("max_slope_deg").alias("max_slope_encountered_deg"), F.col("worst").alias("high_hazard_segments"),
        ).alias("path_summary"),
        F.struct(F.col("rover_name").alias("name"), "capacity_kwh", "energy_margin_kwh", "energy_utilisation", F.col("rover_max_slope_deg").alias("max_traversable_slope_deg"), "kwh_per_m").alias("rover_constraints"),
        F.col("risk_tier").alias("risk_score"),
        F.col("risk_score").alias("risk_score_numeric"),
        "feasibility",
        *more,
    )
    return met.select("path_id", context.alias("context"))


def recommendation(verdict: Column, margin: Column) -> Column:
    return (
        F.when(verdict == "INFEASIBLE", words.INFEASIBLE)
        .when(verdict == "FEASIBLE_WITH_MARGIN", F.concat(F.lit(words.MARGIN_BEFORE), fixed(margin, 4), F.lit(words.MARGIN_AFTER)))
        .otherwise(words.FEASIBLE)
    )


def _reason(s: Column) -> Column:
    return F.format_string(words.REASON, s.hazard_score, s.x, s.y, s.slope_deg)


def _template() -> dict[str, Column]:
    """Columns of the report from a context's figures alone."""
    c = lambda *path: F.col(".".join(("context", *path)))
    two = F.slice(c("path_summary", "high_hazard_segments"), 1, 2)
    first = F.element_at(two, 1)
    worst = F.when(F.size(two) > 0, F.format_string(words.WORST_SEGMENT, first.segment_id, first.hazard_score)).otherwise(words.NO_SEGMENT)
    summary = F.format_string(
        words.SUMMARY + "%s",
        c("risk_score"), c("risk_score_numeric"), c("feasibility"), c("path_summary", "total_distance_m"), c("path_summary", "num_waypoints"),
        c("path_summary", "total_energy_cost_kwh"), c("rover_constraints", "capacity_kwh"), c("rover_constraints", "energy_margin_kwh"), worst,
    )
    reasons = F.transform(two, lambda s: F.concat(s.segment_id.cast("string"), F.lit(": "), _reason(s)))
    return {"summary": summary, "reasons": F.array_join(reasons, " "), "recommendation": recommendation(c("feasibility"), c("rover_constraints", "energy_margin_kwh"))}


def fallback_report(contexts: DataFrame) -> DataFrame:
    """(path_id, summary, reasons, recommendation): the report from figures alone; reasons of the two worst segments."""
    return contexts.select("path_id", *(column.alias(name) for name, column in _template().items()))


def read_reply(raw: str | None) -> dict:
    """summary, recommendation, risks (segment_id, reason) and fallback_reason of one model reply: why it cannot be used.

    White space around it, a code fence and its json tag are cut; the reply must be a JSON object with the required keys, looked
    for in order. Values are told as Python writes them. A segment_id may be a number, truncated, a boolean, or the text of
    a whole number; else it is null, as are the items of a top_risks that is a text or an object."""
    none = dict.fromkeys(("summary", "recommendation", "risks"))
    if raw is None:
        return none | {"fallback_reason": "no reply"}
    text = raw.strip()
    if text.startswith("```"):
        text = text.split("```")[1].removeprefix("json").strip()
    try:
        reply = json.loads(text)
    except (ValueError, RecursionError):
        return none | {"fallback_reason": "unparseable model output"}
    if not isinstance(reply, dict):
        return none | {"fallback_reason": "not an object"}
    missing = [key for key in REQUIRED if key not in reply]
    if missing:
        return none | {"fallback_reason": f"missing required key: {missing[0]}"}
    risks = []
    try:
        for risk in reply["top_risks"] or []:
            whole = isinstance(risk, dict) and isinstance(risk.get("segment_id"), (int, float, str))
            try:
                segment = int(risk["segment_id"]) if whole else None
            except ValueError:
                segment = None
            fits = segment is not None and abs(segment) < 2**63
            risks.append({"segment_id": segment if fits else None, "reason": str(risk.get("reason", "")) if isinstance(risk, dict) else ""})
    except (TypeError, OverflowError):  # a number, or an infinite one in it
        return none | {"fallback_reason": "top_risks cannot be listed"}
    return {"summary": str(reply["summary"]), "recommendation": str(reply["recommendation"]), "risks": risks, "fallback_reason": None}


_REPLY = "summary string, recommendation string, risks array<struct<segment_id: bigint, reason: string>>, fallback_reason string"


def parse_replies(replies: DataFrame) -> DataFrame:
    """``replies`` (path_id, raw) with summary, recommendation, risks (array of segment_id, reason in order) and
    fallback_reason, each reply read once (read_reply)."""


    def read(raw: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_reply(r) for r in raw], columns=["summary", "recommendation", "risks", "fallback_reason"])

    return replies.withColumn("_reply", F.pandas_udf(read, _REPLY)("raw")).select("*", "_reply.*").drop("_reply")


def _backed(ids: Column) -> tuple[Column, Column]:
    """Of a reply's risks those whose segment is among ``ids``, in order, and how many others there are."""
    kept = F.filter("risks", lambda r: F.coalesce(F.array_contains(ids, r.segment_id), F.lit(False)))
    return kept, (F.size("risks") - F.size(kept)).cast("long")


def verified_risks(parsed: DataFrame, allowed: DataFrame) -> DataFrame:
    """(path_id, kept, dropped): of each usable reply the cited risks (segment_id, reason) whose segment ``allowed`` (path_id,
    segment_id) has, in the reply's order, and how many others there were. A path has a few allowed segments."""
    known = allowed.groupBy("path_id").agg(F.collect_set(F.col("segment_id").cast("long")).alias("_ids"))
    kept, dropped = _backed(F.coalesce("_ids", F.expr("cast(array() as array<bigint>)")))
    return parsed.where("fallback_reason is null").join(known, "path_id", "left").select("path_id", kept.alias("kept"), dropped.alias("dropped"))


def check_citations(parsed: DataFrame, allowed: DataFrame) -> DataFrame:
    """verified_risks with ``kept`` as text: the segments that stay."""
    return verified_risks(parsed, allowed).withColumn("kept", F.array_join(F.transform("kept", lambda k: k.segment_id.cast("string")), ","))


def final_report(contexts: DataFrame, replies: DataFrame) -> DataFrame:
    """(path_id, generated_by, summary, top_risks, recommendation, dropped_citations, fallback_reason) of every context: the
    model's reply if it is usable, with the citations that the context backs, else the template and why. ``replies``
    (path_id, raw) has one row for each path at most; a path without one falls back too. One join: the template and the
    allowed segments are columns of the path's own row."""
    worst = "context.path_summary.high_hazard_segments"
    template = _template()
    parsed = parse_replies(replies).select("path_id", F.col("summary").alias("_s"), F.col("recommendation").alias("_r"), "risks", F.col("fallback_reason").alias("_why"))
    met = contexts.join(parsed, "path_id", "left")
    kept, dropped = _backed(F.transform(worst, lambda s: s.segment_id.cast("long")))
    own = F.transform(F.slice(worst, 1, 2), lambda s: F.struct(s.segment_id.cast("long").alias("segment_id"), _reason(s).alias("reason")))
    model = F.col("risks").isNotNull()
    pick = lambda of_model, of_template: F.when(model, of_model).otherwise(of_template)
    return met.select(
        "path_id", pick(F.lit("llm"), F.lit("template_fallback")).alias("generated_by"), pick(F.col("_s"), template["summary"]).alias("summary"), pick(kept, own).alias("top_risks"),
        pick(F.col("_r"), template["recommendation"]).alias("recommendation"), F.when(model, dropped).alias("dropped_citations"), F.when(~model, F.coalesce("_why", F.lit("no reply"))).alias("fallback_reason"),
    )


def audit_basis(risks: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """(path_id, basis): formula, weights, thresholds and inputs with every result."""
    basis = F.struct(
        F.lit(words.RISK_FORMULA).alias("risk_formula"),
        F.struct(F.lit(settings.risk_weight_hazard).alias("hazard"), F.lit(settings.risk_weight_energy).alias("energy")).alias("weights"),
        F.struct(F.lit(settings.tier_low).alias("low"), F.lit(settings.tier_medium).alias("medium"), F.lit(settings.margin_fraction).alias("margin")).alias("thresholds"),
        F.struct("total_energy_kwh", "capacity_kwh", "num_waypoints").alias("inputs"),
    )
    return risks.select("path_id", basis.alias("basis"))


def hazard_basis(stats: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """``stats`` of hazard_stats with ``basis``: how each tile's hazard came about and what it came to."""
    four = lambda *names: F.struct(*(rounded(c, 4).alias(c) for c in names))
    basis = F.struct(
        F.lit(words.HAZARD_FORMULA).alias("formula"),
        F.struct(F.lit(settings.weight_slope).alias("slope"), F.lit(settings.weight_obstacle).alias("obstacle_proximity"), F.lit(settings.weight_roughness).alias("roughness")).alias("weights"),
        F.lit(settings.slope_reference_deg).alias("slope_reference_deg"),
        F.lit(settings.roughness_window).alias("roughness_window"),
        four("mean_hazard", "max_hazard", "p95_hazard", "fraction_above_0_6").alias("aggregate"),
        four("slope_term", "obstacle_term", "roughness_term").alias("component_means"),
    )
    return stats.select("tile_id", basis.alias("basis"))


def path_basis(plans: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """(plan_id, basis) of ``plans`` (plan_id, rows, cols, scale, meters_per_cell, max_hazard, by_hazard, by_slope): the terms
    under which a route was sought, with the edges that either limit removed from the whole grid."""
    basis = F.struct(
        F.lit(8).alias("connectivity"),
        F.lit(words.COST_FUNCTION).alias("cost_function"),
        F.lit(words.ENERGY_MODEL).alias("energy_model"),
        F.lit(words.HARD_CONSTRAINTS).alias("hard_constraints"),
        F.lit(settings.energy_slope_coefficient).alias("energy_slope_coefficient"),
        F.struct("rows", "cols").alias("planning_grid_shape"),
        F.round("meters_per_cell", 4).alias("meters_per_cell"),
        F.round("scale", 4).alias("downsample_scale"),
        F.col("max_hazard").alias("lethal_hazard_threshold"),
        F.col("by_hazard").alias("moves_blocked_by_lethal_hazard"),
        F.col("by_slope").alias("moves_blocked_by_slope_limit"),
    )
    return plans.select("plan_id", basis.alias("basis"))
