import numpy as np
import pytest
from pyspark.sql import functions as F

from regolith.operators import surfaces
from regolith.operators.planning import _walk, edge_cost
from regolith.operators.relax import edges_of, relax_costs, relax_grid

PLAN = "plan_id long, tile_id string, start_row int, start_col int, goal_row int, goal_col int, meters_per_cell double, max_slope_deg double, max_hazard double"


def ground(shape, seed, walls=0.0):
    rng = np.random.default_rng(seed)
    hazard = np.round(rng.random(shape) * 0.6, 3)
    hazard[rng.random(shape) < walls] = 0.95
    return hazard, np.round(rng.random(shape) * 2, 2)


def table(spark, **tiles):
    import pandas as pd

    parts = []
    for name, (hazard, elevation) in tiles.items():
        y, x = np.indices(hazard.shape, np.int32)
        parts.append(pd.DataFrame({"tile_id": name, "row": y.ravel(), "col": x.ravel(), "hazard": hazard.ravel(), "elevation_m": elevation.ravel()}))
    return spark.createDataFrame(pd.concat(parts)).repartition(3)


def expected(tiles, plans, k=0.5):
    costs, routes = {}, {}
    for plan_id, tile, r, c, gr, gc, metres, slope, most in plans:
        cost, back = relax_grid(*tiles[tile], (r, c), metres, float(np.tan(np.radians(slope))), most, k)
        costs |= {(plan_id, int(y), int(x)): (cost[y, x], int(back[y, x])) for y, x in zip(*np.nonzero(np.isfinite(cost)))}
        routes |= {(plan_id, n): tuple(map(int, at)) for n, at in enumerate(_walk(back, np.isfinite(cost), (gr, gc)))}
    return costs, routes


@pytest.mark.parametrize("block", [9])
def test_equals_one_grid(spark, block):
    serpent = np.zeros((17, 17)), np.zeros((17, 17))  # a way that comes back to blocks it has left
    serpent[0][4::8, :-1] = 0.95
    serpent[0][8::8, 1:] = 0.95
    tiles = {"a": ground((37, 22), 1, 0.2), "b": ground((16, 50), 2), "c": serpent}
    plans = [
        (1, "a", 0, 0, 36, 21, 2.0, 40.0, 0.9), (2, "a", 18, 11, 0, 21, 1.0, 35.0, 0.9), (3, "a", 18, 11, 36, 0, 2.0, 25.0, 0.5),
        (4, "b", 15, 49, 0, 0, 3.0, 30.0, 0.85), (5, "b", 3, 3, 3, 3, 3.0, 30.0, 0.85), (6, "c", 0, 0, 14, 3, 1.0, 30.0, 0.85), (7, "b", 3, 3, 9, 40, 3.0, 0.01, 0.85),
    ]
    found = surfaces.Surfaces(spark.createDataFrame(plans, PLAN), table(spark, **tiles), 0.5, block)
    costs, routes = expected(tiles, plans)
    assert {(r.plan_id, r.row, r.col): (r.cost, r.back) for r in found.costs().collect()} == costs
    assert {(r.plan_id, r.segment_id): (r.row, r.col) for r in found.routes().collect()} == routes
    assert {p for p, _ in routes} == {1, 2, 4, 5, 6}


def test_large_grids_take_few_rounds(spark):
    hazard, elevation = ground((512, 512), 5)
    elevation = np.round(elevation / 10, 3)
    hazard[150:512, 250:260] = 0.95  # a wall to go around
    plans = [(1, "big", 500, 10, 500, 505, 2.0, 30.0, 0.85)]
    found = surfaces.Surfaces(spark.createDataFrame(plans, PLAN), table(spark, big=(hazard, elevation)), 0.5, 128)
    assert found.rounds <= 16  # four blocks across; not hundreds of cells
    want, back = relax_grid(hazard, elevation, (500, 10), 2.0, float(np.tan(np.radians(30.0))), 0.85, 0.5)
    got = found.costs().toPandas()
    cost = np.full(hazard.shape, np.inf)
    cost[got["row"], got["col"]] = got["cost"]
    assert (cost == want).all()
    cells = [(r.row, r.col) for r in found.routes().orderBy("segment_id").collect()]
    assert cells == _walk(back, np.isfinite(want), (500, 505))
    assert len(cells) > 600


def test_nothing_is_asked_or_reached(spark):
    grid = table(spark, a=ground((9, 9), 1))
    none = surfaces.Surfaces(spark.createDataFrame([], PLAN), grid, 0.5, 4)
    assert none.costs().count() == 0 and none.routes().count() == 0


def test_jumps_follow_long_ways(spark):
    n = 700
    nodes = spark.createDataFrame([(1, i, i + 1 if i < n else None, i % 3 + 1) for i in range(n + 1)] + [(2, 7, 9, 4), (2, 9, None, 1)], "plan_id long, node long, next long, steps long")
    starts = spark.createDataFrame([(1, 3, 0), (2, 7, 0), (3, 1, 0)], "plan_id long, node long, nth long")
    got = sorted(map(tuple, surfaces.on_the_way(nodes, starts).collect()))
    want, nth = [], 0
    for i in range(3, n + 1):
        want.append((1, i, nth))
        nth += i % 3 + 1
    assert got == want + [(2, 7, 0), (2, 9, 4), (3, 1, 0)]


def test_equals_relaxation_by_joins(spark):
    """The plain definition: edges joined to costs until nothing improves."""
    grid = table(spark, a=ground((7, 9), 6))
    plans = [(1, "a", 3, 3, 6, 8, 1.0, 80.0, 0.85)]
    edges = edges_of(grid, 1.0).select(F.lit(1).cast("long").alias("plan_id"), "row", "col", "to_row", "to_col", edge_cost(F.col("step_m"), F.col("to_hazard"), F.col("rise_over_run")).alias("cost"))
    want = {(r.row, r.col): r.cost for r in relax_costs(spark.createDataFrame([(1, 3, 3)], "plan_id long, row int, col int"), edges).collect()}
    got = {(r.row, r.col): r.cost for r in surfaces.Surfaces(spark.createDataFrame(plans, PLAN), grid, 0.5, 4).costs().collect()}
    assert len(want) == 63 and got == pytest.approx(want, rel=1e-12)
