import numpy as np
import pytest

from regolith.operators import halo, regions, relax, runs, stencil
from tests.test_stencil import frame


def masks():
    rng = np.random.default_rng(12)
    ring = np.zeros((21, 34), bool)
    ring[2:19, 3:31] = True
    ring[4:17, 5:29] = False
    ring[8:12, 9:14] = True
    ring[9, 10] = False
    return {"dense": rng.random((23, 31)) < 0.55, "thin": rng.random((40, 3)) < 0.4, "rings": ring, "none": np.zeros((6, 6), bool), "all": np.ones((5, 9), bool), "large hole": ring.repeat(2, 0)}


def cells(spark):
    parts = [frame(spark, m.astype(int), name) for name, m in masks().items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumnRenamed("intensity", "edge").repartition(3)


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


@pytest.mark.parametrize("diagonal", [True, False])
def test_regions_by_runs_and_by_blocks_are_the_same(spark, monkeypatch, diagonal):
    monkeypatch.setattr(runs, "STRETCH", 5)
    c = cells(spark).cache()
    by_runs = runs.labels(c, "edge = 1", diagonal)
    assert rows(by_runs, "tile_id", "y", "x", "label") == rows(relax.labels(c, "edge = 1", diagonal), "tile_id", "y", "x", "label")
    plan = runs.touching(runs.runs(c.where("edge = 1")), diagonal)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def enclosed(mask):
    """Edges and all that a flood from the border does not reach."""
    seen, todo = np.zeros_like(mask), [(y, x) for y, x in np.ndindex(mask.shape) if (y in (0, mask.shape[0] - 1) or x in (0, mask.shape[1] - 1)) and not mask[y, x]]
    while todo:
        y, x = todo.pop()
        if 0 <= y < mask.shape[0] and 0 <= x < mask.shape[1] and not mask[y, x] and not seen[y, x]:
            seen[y, x] = True
            todo += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
    return ~seen


@pytest.mark.parametrize("block", [256, 7])
def test_filling_as_a_flood(spark, block):
    c = cells(spark).cache()
    want = sorted((name, int(y), int(x)) for name, m in masks().items() for y, x in zip(*np.nonzero(enclosed(m))))
    assert rows(regions.filled_cells(c.where("edge = 1"), regions.sizes_of(c), block), "tile_id", "y", "x") == want
    if block == 7:
        assert rows(runs.filled_mask(c), "tile_id", "y", "x") == want


@pytest.mark.parametrize("block", [256, 6])
def test_closing_by_blocks_equals_windows(spark, block):
    c = cells(spark).cache()
    want = rows(stencil.morph_close(c).where("edge = 1"), "tile_id", "y", "x")
    assert rows(halo.close(c.where("edge = 1"), regions.sizes_of(c), block), "tile_id", "y", "x") == want


def test_boundary_cells_have_a_side_outside(spark):
    c = cells(spark).where("edge = 1").select("tile_id", "y", "x").cache()
    got = {(r.tile_id, r.y, r.x): r.boundary for r in regions.region_cells(c).collect()}
    for (name, y, x), boundary in got.items():
        inside = all((name, y + dy, x + dx) in got for dy, dx in relax.FOUR)
        assert boundary == (not inside)
