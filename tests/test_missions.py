import numpy as np
import pytest
from pyspark.sql import functions as F

from regolith.operators import analysis, missions, reports, stencil
from regolith.settings import Settings
from tests.test_stencil import frame

SETTINGS = Settings(elevation_range_m=4.0)
FLEET = "rover_id int, rover_name string, capacity_kwh double, max_slope_deg double, kwh_per_m double"


def ground(spark):
    rng = np.random.default_rng(3)
    disc = np.hypot(*(np.indices((60, 70)) - np.array([30, 35])[:, None, None])) < 12
    a = np.where(disc, 250, 20).astype(int)
    b = rng.integers(100, 110, (40, 50))
    flat = np.full((30, 30), 77)
    return frame(spark, a, "a").unionByName(frame(spark, b, "b")).unionByName(frame(spark, flat, "flat")).repartition(3)


def test_one_row_tells_all_of_a_raster(spark):
    found = analysis.analyse(ground(spark), SETTINGS, 32)  # several blocks
    whole = analysis.analyse(ground(spark), SETTINGS)
    rows = {r.tile_id: r for r in found.rows.collect()}
    assert rows == {r.tile_id: r for r in whole.rows.collect()}
    assert rows["a"].obstacles == 1 and abs(rows["a"].packed[0].radius_px - 12) < 3 and rows["flat"].obstacles == 0 and rows["flat"].packed is None
    assert rows["flat"].terrain_class == "sandy_plain" and (rows["flat"].max_hazard, rows["flat"].max_slope_deg) == (0.0, 0.0)
    assert (rows["a"].width_m, rows["a"].height_m) == (140.0, 120.0)
    e = rows["a"].evidence
    assert e.thresholds.crater_min_area_fraction == SETTINGS.crater_min_area_fraction and e.obstacle_area_fraction == pytest.approx(rows["a"].area_fraction, abs=1e-4)
    windows = {(r.tile_id, r.y, r.x): r.slope_deg for r in stencil.slope(ground(spark), SETTINGS).collect()}
    assert {(r.tile_id, r.y, r.x): r.slope_deg for r in found.scored.collect()} == windows


def test_chain_from_grids_to_contexts(spark):
    found = analysis.analyse(ground(spark), SETTINGS)
    grids = analysis.planning_grids(found.scored, SETTINGS, 20)
    assert {(r.tile_id, r.scale) for r in grids.select("tile_id", "scale").distinct().collect()} == {("a", 3.5), ("b", 2.5), ("flat", 1.5)}
    asked = [(1, "a", 0), (2, "a", 1), (3, "b", 0), (4, "gone", 0), (5, "b", 9), (6, "flat", 0)]
    requests = spark.createDataFrame([(i, t, r, 1, 1, *{6: (1, 1), 2: (35, 30)}.get(i, (60, 50)), 3.5, 7.0, 0.85) for i, t, r in asked], "plan_id long, tile_id string, rover_id int, start_x int, start_y int, goal_x int, goal_y int, scale double, meters_per_cell double, max_hazard double")
    fleet = spark.createDataFrame([(0, "able", 6.0, 60.0, 0.003), (1, "timid", 6.0, 0.0001, 0.003)], FLEET)
    about = spark.createDataFrame([(i, f"m{i}", None, t) for i, t, _ in asked], "mission_id long, name string, terrain_source string, tile_id string")
    out = missions.run(about, requests, found.rows, grids, fleet, SETTINGS)
    status = {r.mission_id: r.status for r in out.status.collect()}
    assert status == {1: "OK", 2: "NO_ROUTE", 3: "OK", 4: "NO_GRID", 5: "NO_ROVER", 6: "SAME_CELL"}
    contexts = {r.path_id: r.context for r in out.contexts.collect()}
    assert contexts.keys() == {1, 3}
    row = found.rows.where("tile_id = 'a'").first()
    c = contexts[1]
    assert c.terrain_summary.terrain_classification == row.terrain_class and c.terrain_summary.obstacle_count == 1 and c.terrain_summary.area_covered_m.width_m == 140.0
    assert c.calculation_basis.hazard.aggregate.mean_hazard == pytest.approx(row.mean_hazard, abs=1e-4) and c.calculation_basis.risk.weights.hazard == 0.6
    ways = out.waypoints.where("path_id = 1").orderBy("segment_id").collect()
    assert c.path_summary.num_waypoints == len(ways) and c.path_summary.max_hazard == max(w.hazard_score for w in ways)
    assert out.risks.where(F.col("path_id") == 1).first().feasibility == c.feasibility


def test_hazard_of_reports_is_rounded_as_doubles(spark):
    """0.51155 times 10,000 is below a half: 0.5115, as in SQL, not 0.5116."""
    figures = dict.fromkeys(("mean_hazard", "max_hazard", "p95_hazard", "fraction_above_0_6", "slope_term", "obstacle_term", "roughness_term"), 0.51155)
    stats = spark.createDataFrame([figures | {"tile_id": "a"}])
    assert set(reports.hazard_basis(stats, SETTINGS).first().basis.aggregate) == {0.5115}
