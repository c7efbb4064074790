"""The neighbourhood operators of one raster in one pass over blocks.

One exchange deals every cell to its block, and the cells near a block's border to the neighbours that reach them: their halo.
A block then has all that slope, roughness, blur, edge gradient and ridges of its own cells look at, and computes them as whole
arrays of integers. At the raster's true borders the halo is reflected, as often as a narrow raster needs. What is not whole
numbers is derived from them by Spark, so values are those of the window operators (stencil.py), bit for bit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regolith.operators.relax import BLOCK
from regolith.operators.stencil import TAN_HIGH, TAN_LOW, from_sums
from regolith.settings import DEFAULT, Settings


def reach(at: str, block: int, halo: int) -> Column:
    """Blocks along one axis that a cell belongs to or lies in the halo of."""
    return F.sequence(F.floor((F.col(at) - halo) / block).cast("int"), F.floor((F.col(at) + halo) / block).cast("int"))


def fold(index: np.ndarray, last: int) -> np.ndarray:
    """Places outside 0 to ``last`` reflected back, without repeating the border, as often as it takes."""
    if last == 0:
        return np.zeros_like(index)
    index = np.abs(index) % (2 * last)
    return np.where(index > last, 2 * last - index, index)


def _sobel(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d, s = a[:, 2:] - a[:, :-2], a[:, :-2] + 2 * a[:, 1:-1] + a[:, 2:]
    return d[:-2] + 2 * d[1:-1] + d[2:], s[2:] - s[:-2]


def _box(a: np.ndarray, n: int) -> np.ndarray:
    """Sums over n x n cells."""
    for axis in (0, 1):
        upto = np.cumsum(a, axis=axis)
        upto = np.concatenate([np.zeros_like(upto.take([0], axis)), upto], axis=axis)
        a = upto.take(range(n, upto.shape[axis]), axis) - upto.take(range(upto.shape[axis] - n), axis)
    return a


def _blur(a: np.ndarray) -> np.ndarray:
    down = a[:-4] + 4 * a[1:-3] + 6 * a[2:-2] + 4 * a[3:-1] + a[4:]
    return (down[:, :-4] + 4 * down[:, 1:-3] + 6 * down[:, 2:-2] + 4 * down[:, 3:-1] + down[:, 4:] + 128) // 256


def _ridge(m2: np.ndarray, gx: np.ndarray, gy: np.ndarray) -> np.ndarray:
    """``m2`` with a rim of one cell; the gradient without."""
    own = m2[1:-1, 1:-1]
    at = lambda dy, dx: m2[1 + dy : m2.shape[0] - 1 + dy, 1 + dx : m2.shape[1] - 1 + dx]
    ax, ay, falling = np.abs(gx).astype(float), np.abs(gy).astype(float), gx * gy >= 0
    flat, steep = ay <= ax * TAN_LOW, ay >= ax * TAN_HIGH
    before = np.select([flat, steep, falling], [at(0, -1), at(-1, 0), at(-1, -1)], at(-1, 1))
    after = np.select([flat, steep, falling], [at(0, 1), at(1, 0), at(1, 1)], at(1, -1))
    return (own > before) & (own >= after)


_FIELDS = "tile_id string, y int, x int, intensity int, _gx int, _gy int, _s long, _q long, blurred int, gx int, gy int, m2 int, ridge boolean"


def block_fields(y: np.ndarray, x: np.ndarray, intensity: np.ndarray, y0: int, x0: int, block: int, halo: int, r: int) -> list[np.ndarray] | None:
    """Columns y, x, ... of _FIELDS of a block's own cells from all its cells."""
    (low_y, high_y), (low_x, high_x) = (int(y.min()), int(y.max())), (int(x.min()), int(x.max()))
    end_y, end_x = min(y0 + block - 1, high_y), min(x0 + block - 1, high_x)
    if end_y < y0 or end_x < x0:
        return None  # a halo beyond the raster's end
    values = np.zeros((high_y - low_y + 1, high_x - low_x + 1), np.int64)
    values[y - low_y, x - low_x] = intensity
    rows, cols = np.arange(y0 - halo, end_y + halo + 1), np.arange(x0 - halo, end_x + halo + 1)
    wide = values[fold(rows, high_y) - low_y][:, fold(cols, high_x) - low_x]
    inner = lambda a, rim: a[rim : a.shape[0] - rim, rim : a.shape[1] - rim]
    gx, gy = _sobel(inner(wide, halo - 1))
    n = 2 * r + 1
    s, q = _box(inner(wide, halo - r), n), _box(inner(wide * wide, halo - r), n)
    blurred = _blur(inner(wide, halo - 4))  # with a rim of two cells
    ex, ey = _sobel(blurred)
    m2 = ex * ex + ey * ey
    inside = lambda at, last: (at >= 0) & (at <= last)
    m2 = np.where(inside(rows[halo - 1 : len(rows) - halo + 1], high_y)[:, None] & inside(cols[halo - 1 : len(cols) - halo + 1], high_x)[None, :], m2, 0)
    ex, ey = inner(ex, 1), inner(ey, 1)
    at_y, at_x = np.meshgrid(rows[halo : len(rows) - halo], cols[halo : len(cols) - halo], indexing="ij")
    return [a.ravel() for a in (at_y, at_x, inner(wide, halo), gx, gy, s, q, inner(blurred, 2), ex, ey, inner(m2, 1), _ridge(m2, ex, ey))]


def stencils(cells: DataFrame, settings: Settings = DEFAULT, block: int = BLOCK) -> DataFrame:
    """(tile_id, y, x, intensity, gradient, slope_deg, roughness, blurred, gx, gy, m2, ridge) of cells(tile_id, y, x, intensity),
    whole rectangles of any size, as stencil.layers and stencil.edge_nms have them. One exchange; a task holds one block with
    its halo."""
    r = settings.roughness_window // 2  # an even window is widened by one
    halo = max(4, r)

    def each(table: pa.Table) -> pa.Table:
        tile, by, bx = (table[c][0].as_py() for c in ("tile_id", "by", "bx"))
        found = block_fields(*(table[c].to_numpy() for c in ("y", "x", "intensity")), by * block, bx * block, block, halo, r)
        kinds = [pa.int32()] * 5 + [pa.int64()] * 2 + [pa.int32()] * 4 + [pa.bool_()]
        columns = [pa.array([], k) for k in kinds] if found is None else [pa.array(c).cast(k) for c, k in zip(found, kinds, strict=True)]
        return pa.table([pa.repeat(pa.scalar(tile, pa.string()), len(columns[0])), *columns], [f.split()[0] for f in _FIELDS.split(", ")])

    met = cells.select("tile_id", "y", "x", "intensity").withColumn("by", F.explode(reach("y", block, halo))).withColumn("bx", F.explode(reach("x", block, halo)))
    spread = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = met.where("by >= 0 and bx >= 0").repartition(spread, "tile_id", "by", "bx")
    sums = met.groupBy("tile_id", "by", "bx").applyInArrow(each, _FIELDS)
    return from_sums(sums, settings)


def _ellipse(a: np.ndarray, pick) -> np.ndarray:
    """Max or min over a 5x5 ellipse, rows of widths 1, 5, 5, 5, 1; the result has a rim of two cells less."""
    h, w = a.shape
    wide = [a[:, 2 + d : w - 2 + d] for d in range(-2, 3)]
    row = pick.reduce(wide)
    return pick.reduce([row[2 + d : h - 2 + d] for d in (-1, 0, 1)] + [a[2 + d : h - 2 + d, 2 : w - 2] for d in (-2, 2)])


def close(edges: DataFrame, sizes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(tile_id, y, x) of the closed edge map: ``edges`` (tile_id, y, x) dilated, then eroded, by the ellipse. ``sizes``
    (tile_id, last_y, last_x): cells outside a raster do not count. Only blocks that have or border on an edge are looked at."""

    def each(table: pa.Table) -> pa.Table:
        tile, by, bx, last_y, last_x = (table[c][0].as_py() for c in ("tile_id", "by", "bx", "last_y", "last_x"))
        y0, x0 = by * block, bx * block
        h, w = min(block, last_y + 1 - y0), min(block, last_x + 1 - x0)
        wide = np.zeros((h + 8, w + 8), np.uint8)
        wide[table["y"].to_numpy() - y0 + 4, table["x"].to_numpy() - x0 + 4] = 1
        grown = _ellipse(wide, np.maximum)
        rows, cols = np.arange(y0 - 2, y0 + h + 2), np.arange(x0 - 2, x0 + w + 2)
        grown[(rows < 0) | (rows > last_y)], grown[:, (cols < 0) | (cols > last_x)] = 1, 1
        y, x = np.nonzero(_ellipse(grown, np.minimum))
        return pa.table([pa.repeat(pa.scalar(tile, pa.string()), len(y)), pa.array((y + y0).astype(np.int32)), pa.array((x + x0).astype(np.int32))], ["tile_id", "y", "x"])

    met = edges.select("tile_id", "y", "x").withColumn("by", F.explode(reach("y", block, 4))).withColumn("bx", F.explode(reach("x", block, 4)))
    met = met.join(sizes, "tile_id").where(f"by >= 0 and bx >= 0 and by * {block} <= last_y and bx * {block} <= last_x")
    met = met.where(f"y < by * {block} + least({block}, last_y + 1 - by * {block}) + 4 and x < bx * {block} + least({block}, last_x + 1 - bx * {block}) + 4")
    spread = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return met.repartition(spread, "tile_id", "by", "bx").groupBy("tile_id", "by", "bx").applyInArrow(each, "tile_id string, y int, x int")
