import heapq
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from regolith.operators import planning, relax

ROVER = "rover_id int, rover_name string, capacity_kwh double, max_slope_deg double, kwh_per_m double"


def dijkstra(hazard, elevation, start, meters, slope, most, k=0.5):
    cost, heap = {start: 0.0}, [(0.0, start)]
    while heap:
        c, (y, x) = heapq.heappop(heap)
        if c > cost[y, x]:
            continue
        for dy, dx in relax.EIGHT:
            b, a = y + dy, x + dx
            if not (0 <= b < hazard.shape[0] and 0 <= a < hazard.shape[1]) or hazard[b, a] >= most:
                continue
            run = math.hypot(dy, dx) * meters
            rise = abs(elevation[b, a] - elevation[y, x]) / run
            if rise > math.tan(math.radians(slope)):
                continue
            new = c + run * (1 + hazard[b, a]) * (1 + k * rise)
            if new < cost.get((b, a), math.inf):
                cost[b, a] = new
                heapq.heappush(heap, (new, (b, a)))
    return cost


def world(spark, hazard, elevation, asks, slope=25.0, meters=1.0, most=0.85):
    h, w = hazard.shape
    grid = spark.createDataFrame([("t", y, x, float(hazard[y, x]), float(elevation[y, x])) for y in range(h) for x in range(w)], "tile_id string, row int, col int, hazard double, elevation_m double")
    requests = spark.createDataFrame(
        [(i, "t" if i < 90 else "none", 0 if i != 80 else 7, *a, *b, 1.0, meters, most) for i, a, b in asks],
        "plan_id long, tile_id string, rover_id int, start_x int, start_y int, goal_x int, goal_y int, scale double, meters_per_cell double, max_hazard double",
    )
    return requests, grid, spark.createDataFrame([(0, "r", 6.0, slope, 0.003)], ROVER)


def route(spark, *args, **kw):
    requests, grid, rovers = world(spark, *args, **kw)
    surface = planning.cost_surface(requests, grid, rovers).cache()
    status = {r.plan_id: (r.status, r.total_cost) for r in planning.plan_status(requests, grid, rovers, surface).collect()}
    way = planning.waypoints(planning.routes(requests, grid, rovers), requests, grid, rovers).orderBy("path_id", "segment_id").collect()
    return status, way


Z = np.zeros((20, 20))


def test_flat_diagonal_and_statuses(spark):
    status, way = route(spark, Z, Z, [(1, (0, 0), (9, 9)), (2, (5, 5), (5, 5)), (3, (0, 0), (9999, 9999)), (80, (0, 0), (1, 1)), (91, (0, 0), (1, 1))])
    assert {i: s for i, (s, _) in status.items()} == {1: "OK", 2: "SAME_CELL", 3: "OK", 80: "NO_ROVER", 91: "NO_GRID"}
    one = [w for w in way if w.path_id == 1]
    assert [(w.x, w.y) for w in one] == [(i, i) for i in range(10)] and status[1][1] == pytest.approx(9 * math.sqrt(2))
    assert one[-1].cumulative_energy_kwh == pytest.approx(0.003 * 9 * math.sqrt(2), abs=1e-6) and one[0].step_distance_m == 0
    assert [(w.x, w.y) for w in way if w.path_id == 3][-1] == (19, 19)


@pytest.mark.parametrize("block", [256, 8])
def test_costs_as_dijkstra_in_one_task_and_by_joins(spark, monkeypatch, block):
    monkeypatch.setattr(planning, "BLOCK", block)
    rng = np.random.default_rng(11)
    hazard, elevation = rng.random((14, 12)), rng.random((14, 12)) * 1.2
    requests, grid, rovers = world(spark, hazard, elevation, [(1, (0, 0), (11, 13))], meters=2.0)
    surface = planning.cost_surface(requests, grid, rovers).collect()
    want = dijkstra(hazard, elevation, (0, 0), 2.0, 25.0, 0.85)
    assert {(r.row, r.col): pytest.approx(r.cost, rel=1e-9) for r in surface} == want
    for r in surface:  # each step back is one of a cheapest way
        if r.back >= 0:
            y, x = r.row + relax.EIGHT[r.back][0], r.col + relax.EIGHT[r.back][1]
            run = math.hypot(*relax.EIGHT[r.back]) * 2.0
            step = run * (1 + hazard[r.row, r.col]) * (1 + 0.5 * abs(elevation[y, x] - elevation[r.row, r.col]) / run)
            assert want[y, x] + step == pytest.approx(r.cost)
        else:
            assert (r.row, r.col) == (0, 0)


def test_lethal_bands_and_cliffs(spark):
    band = np.zeros((21, 21))
    band[10, :18] = 0.95
    ask = [(1, (5, 2), (5, 18))]
    soft, way = route(spark, band, np.zeros((21, 21)), ask, most=1.0)
    assert soft[1][0] == "OK" and all(w.x < 18 for w in way if w.y == 10)
    hard, way = route(spark, band, np.zeros((21, 21)), ask)
    assert all(w.x >= 18 for w in way if w.y == 10) and hard[1][1] > soft[1][1]
    band[10, :] = 0.95
    assert route(spark, band, np.zeros((21, 21)), ask)[0][1] == ("NO_ROUTE", None)
    cliff = np.zeros((20, 20))
    cliff[:18, 10] = 500
    status, way = route(spark, Z, cliff, [(1, (2, 5), (17, 5))], meters=2.0)
    assert status[1][0] == "OK" and all(w.y >= 18 for w in way if w.x == 10)
    cliff[:, 10] = 500
    assert route(spark, Z, cliff, [(1, (2, 5), (17, 5))])[0][1] == ("NO_ROUTE", None)


def test_a_lethal_start_is_allowed(spark):
    h = Z.copy()
    h[0, 0] = 1.0
    assert route(spark, h, Z, [(1, (0, 0), (3, 0))])[0][1][0] == "OK"


def test_snap_rounds_half_to_even(spark):
    df = spark.createDataFrame([(5.0, 2.0), (7.0, 2.0), (-3.0, 1.0), (99.0, 1.0)], "p double, s double")
    assert [r[0] for r in df.select(planning.snap("p", "s", F.lit(10))).collect()] == [2, 4, 0, 9]


def test_routes_in_one_task_and_by_joins(spark, monkeypatch):
    rng = np.random.default_rng(4)
    hazard, elevation = 0.8 * rng.random((11, 12)), 0.5 * rng.random((11, 12))
    asks = [(i, (0, 0), (11, 10)) for i in range(3)] + [(3, (4, 4), (0, 9)), (4, (2, 2), (2, 2))]
    requests, grid, rovers = world(spark, hazard, elevation, asks, meters=2.0)
    took = []
    for block, portion in ((256, 64), (256, 1), (8, 64)):
        monkeypatch.setattr(planning, "BLOCK", block)
        monkeypatch.setattr(planning, "PORTION", portion)
        took.append(sorted(map(tuple, planning.routes(requests, grid, rovers).collect())))
    assert took[0] == took[1] == took[2]
    assert [r[2:] for r in took[0] if r[0] == 0][0] == (0, 0) and {r[0] for r in took[0]} == {0, 1, 2, 3}


def test_layers_of_two_shapes_are_a_status(spark):
    requests, grid, rovers = world(spark, Z, Z, [(1, (0, 0), (3, 3))])
    for broken in (grid.where("row <> 4 or col <> 4"), grid.withColumn("elevation_m", F.when(F.col("row") < 19, F.col("elevation_m")))):
        surface = planning.cost_surface(requests, broken, rovers)
        assert surface.count() == 0 and [r.status for r in planning.plan_status(requests, broken, rovers, surface).collect()] == ["GRID_MISMATCH"]


def test_waypoints_at_a_scale(spark):
    """Pixels are rounded half to even from cells of a grid that was scaled down."""
    requests, grid, rovers = world(spark, Z, Z, [(1, (3, 3), (27, 27))], meters=5.0)
    requests = requests.withColumn("scale", F.lit(2.5))
    way = planning.waypoints(planning.routes(requests, grid, rovers), requests, grid, rovers).orderBy("segment_id").collect()
    assert [(w.x, w.y) for w in way] == [(v, v) for v in (2, 5, 8, 10, 12, 15, 18, 20, 22, 25, 28)] and way[1].step_distance_m == round(5 * math.sqrt(2), 3)


def test_ends_beyond_the_grid_without_clamping(spark):
    asks = [(1, (0, 0), (9, 9)), (2, (0, 0), (9, 20)), (3, (20, 0), (9, 9)), (4, (0, 0), (-1, 0)), (5, (25, 25), (25, 25))]
    requests, grid, rovers = world(spark, Z, Z, asks)
    surface = planning.cost_surface(requests, grid, rovers, clamp=False).cache()
    status = {r.plan_id: r.status for r in planning.plan_status(requests, grid, rovers, surface, clamp=False).collect()}
    assert status == {1: "OK", 2: "NO_ROUTE", 3: "NO_ROUTE", 4: "NO_ROUTE", 5: "SAME_CELL"}
    assert [(r.row, r.col, r.cost) for r in surface.where("plan_id = 3").collect()] == [(0, 20, 0.0)]
    assert surface.where("plan_id = 2").count() == 400
    assert {r.plan_id for r in planning.routes(requests, grid, rovers, clamp=False).collect()} == {1}


def test_waypoints_are_rounded_as_doubles(spark):
    """0.51155 times 10,000 is below a half, and a fall of less than half a thousandth of a degree is -0.0, as in SQL."""
    requests, grid, rovers = world(spark, np.full((3, 3), 0.51155), np.array([[0, -1e-6, 0]] * 3), [(1, (0, 0), (1, 0))])
    way = planning.waypoints(planning.routes(requests, grid, rovers), requests, grid, rovers).orderBy("segment_id").collect()
    assert [(w.hazard_score, repr(w.slope_deg)) for w in way] == [(0.5115, "0.0"), (0.5115, "-0.0")]
