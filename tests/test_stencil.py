import numpy as np
import pytest

from regolith.operators import halo, hazard, stencil
from regolith.settings import DEFAULT, Settings
from pyspark.sql import functions as F


def frame(spark, image, tile="t", **more):
    h, w = image.shape
    return spark.createDataFrame([(tile, y, x, int(image[y, x])) for y in range(h) for x in range(w)], "tile_id string, y int, x int, intensity int")


def raster(df, column, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.y, r.x] = r[column]
    return out


def reflect(a, r):
    return np.pad(a, r, mode="reflect")


def windows(a, r):
    p = reflect(a.astype(float), r)
    return np.lib.stride_tricks.sliding_window_view(p, (2 * r + 1, 2 * r + 1))


IMAGE = np.random.default_rng(0).integers(0, 256, (14, 17))


def test_flat_and_ramp(spark):
    flat = stencil.slope(frame(spark, np.full((32, 32), 128)))
    assert flat.agg(F.max("slope_deg"), F.max("gradient")).first()[:] == (0.0, 0.0)
    ramp = np.tile(np.arange(256), (12, 1))
    fine = raster(stencil.slope(frame(spark, ramp), Settings(meters_per_pixel=1, elevation_range_m=255)), "slope_deg", ramp.shape)
    assert np.abs(fine[:, 4:-4] - 45).max() < 0.5
    one = raster(stencil.slope(frame(spark, ramp), Settings(meters_per_pixel=1)), "gradient", ramp.shape)
    two = raster(stencil.slope(frame(spark, ramp), Settings(meters_per_pixel=2)), "gradient", ramp.shape)
    assert np.allclose(one, 2 * two, rtol=1e-9)


def test_sobel_blur_and_roughness_as_numpy(spark):
    kx = np.outer([1, 2, 1], [-1, 0, 1])
    g = stencil.sobel(frame(spark, IMAGE))
    assert (raster(g, "gx", IMAGE.shape) == (windows(IMAGE, 1) * kx).sum(axis=(2, 3))).all()
    assert (raster(g, "gy", IMAGE.shape) == (windows(IMAGE, 1) * kx.T).sum(axis=(2, 3))).all()
    k = np.outer([1, 4, 6, 4, 1], [1, 4, 6, 4, 1])
    want = ((windows(IMAGE, 2) * k).sum(axis=(2, 3)) + 128) // 256
    assert (raster(stencil.gaussian_blur(frame(spark, IMAGE)), "blurred", IMAGE.shape) == want).all()
    for size, used in ((9, 4), (8, 4), (3, 1)):
        want = np.minimum(1, windows(IMAGE / 255.0, used).std(axis=(2, 3)) / 0.5)
        assert np.allclose(raster(stencil.roughness(frame(spark, IMAGE), Settings(roughness_window=size)), "roughness", IMAGE.shape), want)


def test_close_as_numpy(spark):
    on = (np.random.default_rng(4).random((15, 13)) < 0.2).astype(int)
    shape = np.array([[0, 0, 1, 0, 0], [1] * 5, [1] * 5, [1] * 5, [0, 0, 1, 0, 0]], bool)

    def run(a, fill, pick):
        p = np.pad(a, 2, constant_values=fill)
        w = np.lib.stride_tricks.sliding_window_view(p, (5, 5))
        return pick(np.where(shape, w, fill), axis=(2, 3))

    want = run(run(on, 0, np.max), 1, np.min)
    df = frame(spark, on).withColumnRenamed("intensity", "edge")
    assert (raster(stencil.morph_close(df), "edge", on.shape) == want).all()


def test_nms_as_numpy(spark):
    g = stencil.edge_nms(frame(spark, IMAGE))
    gx, gy, m2, got = (raster(g, c, IMAGE.shape) for c in ("gx", "gy", "m2", "ridge"))
    p = np.pad(m2, 1)
    for y in range(IMAGE.shape[0]):
        for x in range(IMAGE.shape[1]):
            angle = np.degrees(np.arctan2(abs(gy[y, x]), abs(gx[y, x])))
            step = (0, 1) if angle <= 22.5 else (1, 0) if angle >= 67.5 else (1, 1) if gx[y, x] * gy[y, x] >= 0 else (1, -1)
            before, after = p[y + 1 - step[0], x + 1 - step[1]], p[y + 1 + step[0], x + 1 + step[1]]
            assert bool(got[y, x]) == (m2[y, x] > before and m2[y, x] >= after)


@pytest.mark.parametrize("shape,most,size", [((50, 50), 192, (50, 50)), ((40, 20), 16, (16, 8)), ((7, 30), 9, (2, 9))])
def test_downsample_keeps_area_means(spark, shape, most, size):
    image = np.random.default_rng(1).integers(0, 256, shape)
    down = stencil.downsample(frame(spark, image), "intensity", most).collect()
    got = np.full(size, np.nan)
    for r in down:
        got[r.row, r.col] = r.intensity
        assert r.scale == pytest.approx(max(shape) / most if max(shape) > most else 1)

    def weights(n, m):
        lo, hi = np.arange(m)[:, None] * n / m, (np.arange(m)[:, None] + 1) * n / m
        return np.clip(np.minimum(hi, np.arange(n) + 1) - np.maximum(lo, np.arange(n)), 0, None) * m / n

    assert np.allclose(got, weights(shape[0], size[0]) @ image @ weights(shape[1], size[1]).T)


def test_thresholds_follow_contrast(spark):
    ramp = np.tile(np.linspace(0, 60, 64), (64, 1)).astype(int)
    low = hazard.edge_thresholds(stencil.edge_gradient(frame(spark, ramp, "a"))).first()
    high = hazard.edge_thresholds(stencil.edge_gradient(frame(spark, ramp * 4, "b"))).first()
    assert high.high > low.high and low.low == low.high / 2
    g = stencil.edge_gradient(frame(spark, IMAGE)).select("m2").toPandas()["m2"]
    assert hazard.edge_thresholds(stencil.edge_gradient(frame(spark, IMAGE))).first().high == pytest.approx(np.percentile(np.sqrt(g), 97))


def test_terms_and_classes(spark):
    df = spark.createDataFrame([(0.0, 0.0), (15.0, 1.0), (30.0, 9.0), (60.0, -4.0)], "s double, d double")
    got = df.select(hazard.slope_term(F.col("s")).alias("a"), hazard.proximity_term(F.col("d")).alias("b"), hazard.display_level(F.col("s") / 45).alias("c")).collect()
    assert [tuple(r) for r in got] == [(0, 1, 0), (0.5, 0.5, 85), (1, 0.1, 170), (1, 1, 255)]
    with pytest.raises(ValueError, match="sum to 1.0"):
        Settings(weight_slope=0.9)
    rows = spark.createDataFrame([(0.2, 1.0, 0.0), (0.05, 6.0, 0.12), (0.1, 1.0, 0.0), (0.0, 6.1, 0.0)], "a double, s double, r double")
    name, _ = hazard.classify(F.col("a"), F.col("s"), F.col("r"))
    assert [r[0] for r in rows.select(name).collect()] == ["crater_field", "sandy_plain", "rocky_highland", "rocky_highland"]


def test_exchanges_of_the_stencils(spark):
    """Slope and roughness together need one exchange for each direction, edges four."""
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    cells = frame(spark, np.zeros((12, 12), int))
    assert exchanges(stencil.layers(cells)) == 2 and exchanges(stencil.edge_nms(cells)) == 4


def test_exact_percentiles(spark):
    rng = np.random.default_rng(3)
    rows = [("a", float(v)) for v in rng.random(997)] + [("b", 0.5)] + [("c", float(v)) for v in (0.1, 0.1, 0.1, 0.9)] + [("d", float(v)) for v in rng.integers(0, 3, 40)]
    df = spark.createDataFrame(rows, "tile_id string, v double")
    for width in (0.01, 10.0, 1e-5):
        got = {r.tile_id: r.p for r in hazard.exact_percentile(df, "v", 0.95, width, "p").collect()}
        assert got == {t: pytest.approx(np.percentile([v for k, v in rows if k == t], 95)) for t in "abcd"}


def _cells(spark, **tiles):
    rows = [(name, y, x, int(v)) for name, a in tiles.items() for (y, x), v in np.ndenumerate(a)]
    return spark.createDataFrame(rows, "tile_id string, y int, x int, intensity int").repartition(3)


def _tiles():
    rng = np.random.default_rng(8)
    shapes = {"one": (1, 1), "row": (1, 9), "column": (7, 1), "two": (2, 2), "thin": (20, 3), "flat": (3, 30), "five": (5, 5), "wide": (33, 41), "even": (16, 32)}
    return {name: rng.integers(0, 256, shape) for name, shape in shapes.items()}


def _padded(a, r):
    """Reflected as often as it takes, one index at a time."""
    def place(i, n):
        while not 0 <= i < n:
            i = -i if i < 0 else 2 * (n - 1) - i
        return i if n > 1 else 0

    ys, xs = ([0 if n == 1 else place(i, n) for i in range(-r, n + r)] for n in a.shape)
    return a[np.ix_(ys, xs)]


def test_roughness_and_blur_of_narrow_tiles(spark):
    tiles = _tiles()
    got = {(r.tile_id, r.y, r.x): r for r in stencil.gaussian_blur(stencil.roughness(_cells(spark, **tiles))).collect()}
    k = np.array([1, 4, 6, 4, 1])
    for name, a in tiles.items():
        wide, blur = _padded(a, 4), _padded(a, 2)
        for (y, x), _ in np.ndenumerate(a):
            r = got[name, y, x]
            assert r.roughness == pytest.approx(min(1.0, np.std(wide[y : y + 9, x : x + 9] / 255) / 0.5), abs=1e-12)
            assert r.blurred == (int(k @ blur[y : y + 5, x : x + 5] @ k) + 128) // 256


@pytest.mark.parametrize("block", [2, 7, 16, 256])
def test_blocks_equal_windows_bit_for_bit(spark, block):
    cells = _cells(spark, **_tiles())
    for settings in (DEFAULT, Settings(roughness_window=4), Settings(roughness_window=13)):
        got = {(r.tile_id, r.y, r.x): r for r in halo.stencils(cells, settings, block).collect()}
        want = {(r.tile_id, r.y, r.x): r for r in stencil.layers(cells, settings).collect()}
        assert got.keys() == want.keys()
        for at, w in want.items():
            assert (got[at].gradient, got[at].slope_deg, got[at].roughness, got[at].intensity) == (w.gradient, w.slope_deg, w.roughness, w.intensity)
    for r in stencil.edge_nms(cells).collect():
        g = got[r.tile_id, r.y, r.x]
        assert (g.blurred, g.gx, g.gy, g.m2, g.ridge) == (r.blurred, r.gx, r.gy, r.m2, r.ridge)


def test_blocks_take_one_exchange(spark):
    plan = halo.stencils(_cells(spark, a=np.zeros((9, 9))))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") - plan.count("REPARTITION_BY_NUM") - plan.count("RoundRobin") <= 1 and "Window" not in plan


@pytest.mark.parametrize("most", [3, 7, 12, 100])
def test_downsample_averages_by_area(spark, most):
    tiles = _tiles()
    got = {(r.tile_id, r.row, r.col): r for r in stencil.downsample(_cells(spark, **tiles), "intensity", most).collect()}
    for name, a in tiles.items():
        longest = max(a.shape)
        scale = 1.0 if longest <= most else longest / most
        new = [max(1, round(n / scale)) for n in a.shape]
        weights = []
        for n, m in zip(a.shape, new):
            step = n / m
            weights.append(np.array([[max(0.0, min(i + 1, (j + 1) * step) - max(i, j * step)) / step for i in range(n)] for j in range(m)]))
        want = weights[0] @ a @ weights[1].T
        assert sum(1 for t, *_ in got if t == name) == want.size
        for (y, x), v in np.ndenumerate(want):
            assert got[name, y, x].intensity == pytest.approx(v, abs=1e-9) and got[name, y, x].scale == scale


def test_percentiles_of_flat_ground(spark):
    """Most of a raster's cells share one value: one row counts them."""
    rng = np.random.default_rng(5)
    values = np.where(rng.random(5000) < 0.9, 0.0, np.round(rng.random(5000), 2))
    df = spark.createDataFrame([("t", float(v)) for v in values] + [("one", 3.25)], "tile_id string, v double")
    for share in (0.0, 0.5, 0.9, 0.95, 1.0):
        got = {r.tile_id: r.p for r in hazard.exact_percentile(df, "v", share, 0.01, "p").collect()}
        assert got == {"t": pytest.approx(np.quantile(values, share), abs=1e-12), "one": 3.25}
    assert "collect_list" not in hazard.exact_percentile(df, "v", 0.5, 0.01, "p")._jdf.queryExecution().toString()
