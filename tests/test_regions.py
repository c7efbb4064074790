import numpy as np
import pytest
from pyspark.sql import functions as F

from regolith.operators import regions, relax
from regolith.settings import Settings
from tests.test_stencil import frame, raster


def flood(on, steps):
    label = np.full(on.shape, -1, np.int64)
    for y, x in zip(*np.nonzero(on)):
        if label[y, x] < 0:
            stack, label[y, x] = [(y, x)], y * relax.ROW + x
            first = label[y, x]
            while stack:
                a, b = stack.pop()
                for dy, dx in steps:
                    c, d = a + dy, b + dx
                    if 0 <= c < on.shape[0] and 0 <= d < on.shape[1] and on[c, d] and label[c, d] < 0:
                        label[c, d] = first
                        stack.append((c, d))
    return label


@pytest.mark.parametrize("diagonal", [True, False])
@pytest.mark.parametrize("block", [256, 7])
def test_labels_as_flood_fill(spark, diagonal, block):
    on = np.random.default_rng(3).random((31, 26)) < (0.4 if diagonal else 0.55)
    df = frame(spark, on.astype(int))
    got = np.full(on.shape, -1, np.int64)
    for r in relax.labels(df, "intensity = 1", diagonal, block).collect():
        got[r.y, r.x] = r.label
    assert (got == flood(on, relax.EIGHT if diagonal else relax.FOUR)).all()
    assert relax.labels(df, "intensity > 9", diagonal, block).count() == 0


def test_spiral_over_blocks(spark):
    on = np.zeros((23, 23), int)
    for k in range(0, 11, 2):
        on[k, k : 23 - k] = on[22 - k, k : 23 - k] = on[k : 23 - k, 22 - k] = 1
        on[k + 2 : 23 - k, k] = 1
        on[k + 2, k : k + 3] = 1
    assert relax.labels(frame(spark, on), "intensity = 1", False, 4).select("label").distinct().count() == len(np.unique(flood(on == 1, relax.FOUR))) - 1


def test_disc_is_one_obstacle(spark):
    y, x = np.indices((128, 128))
    image = np.where((y - 64) ** 2 + (x - 64) ** 2 <= 25**2, 255, 0)
    image[10, ::9] = 255
    found = regions.region_cells(regions.filled_mask(regions.closed_edges(frame(spark, image)))).cache()
    sums = regions.region_sums(found)
    kept = regions.obstacles(sums, Settings(min_obstacle_area_px=200))
    got = regions.obstacle_circles(found, kept).collect()
    assert len(got) == 1 <= sums.count()
    assert abs(got[0].x - 64) <= 3 and abs(got[0].y - 64) <= 3 and abs(got[0].radius_px - 25) <= 3 and got[0].area_m2 == 4 * got[0].area_px


def test_holes_are_filled_and_nested_regions_swallowed(spark):
    on = np.zeros((20, 20), int)
    on[2:15, 2:15] = 1
    on[4:13, 4:13] = 0
    on[7:9, 7:9] = 1
    closed = frame(spark, on).withColumnRenamed("intensity", "edge")
    filled = regions.filled_mask(closed)
    assert filled.count() == 13 * 13
    r = regions.region_sums(regions.region_cells(filled)).collect()
    assert [(x.n_cells, x.boundary_cells, x.area_px) for x in r] == [(169, 48, 144.0)]


def test_circles():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 10, 60):
        points = rng.integers(0, 40, (n, 2))
        x, y, r = regions.enclosing_circle(points)
        away = np.hypot(points[:, 0] - x, points[:, 1] - y)
        assert away.max() <= r + 1e-6
        best = min((np.hypot(*(points - c).T).max() for c in [(x + dx, y + dy) for dx in (-0.2, 0, 0.2) for dy in (-0.2, 0, 0.2)]))
        assert r <= best + 1e-6


def test_distance_as_numpy(spark):
    on = np.random.default_rng(5).random((21, 34)) < 0.01
    on[4, 5] = True
    cells = frame(spark, on.astype(int))
    mask = cells.where("intensity = 1").select("tile_id", "y", "x")
    got = raster(regions.obstacle_distance(cells, mask), "distance_m", on.shape)
    py, px = np.nonzero(on)
    y, x = np.indices(on.shape)
    want = np.sqrt(((y[..., None] - py) ** 2 + (x[..., None] - px) ** 2).min(axis=2)) * 2.0
    assert np.allclose(got, want)
    none = regions.obstacle_distance(cells, mask.limit(0))
    assert none.select(F.min("distance_m"), F.max("distance_m")).first()[:] == (1e6, 1e6)


@pytest.mark.parametrize("shifts", [0, 3, 256])
def test_nearest_by_shifts_and_by_envelope(shifts):
    rng = np.random.default_rng(9)
    for share in (0.01, 0.1, 0.9):
        gap = np.where(rng.random(300) < share, rng.integers(0, 40, 300).astype(float), np.inf)
        gap[17] = 3
        at = np.arange(300)
        assert (regions.nearest(gap**2, shifts) == (gap**2 + (at[:, None] - at) ** 2).min(axis=1)).all()
    assert np.isinf(regions.nearest(np.full(4, np.inf))).all()


def test_rows_of_a_hundred_thousand_cells(spark):
    """One row as long as the global model's: arrays, no object for each cell."""
    n = 106_694
    cells = spark.range(n).select(F.lit("m").alias("tile_id"), F.lit(0).alias("y"), F.col("id").cast("int").alias("x"))
    mask = spark.createDataFrame([("m", 0, 5), ("m", 0, 60_000)], "tile_id string, y int, x int")
    got = regions.obstacle_distance(cells, mask, Settings()).orderBy("x").select("distance_m").toPandas()["distance_m"].to_numpy()
    at = np.arange(n)
    assert np.array_equal(got, 2.0 * np.minimum(np.abs(at - 5), np.abs(at - 60_000)))
