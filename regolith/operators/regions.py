"""From ridges to obstacle regions: hysteresis, closing, filling, areas, circles and distances."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regolith.functions.graph import components
from regolith.functions.lineage import cut
from regolith.operators.halo import close
from regolith.operators.hazard import edge_thresholds
from regolith.operators.relax import BLOCK, FOUR, ROW, label_block, labels
from regolith.operators.stencil import edge_nms
from regolith.settings import DEFAULT, Settings

KEYS = ["tile_id", "y", "x"]
FAR_M = 1e6


def sizes_of(cells: DataFrame) -> DataFrame:
    """(tile_id, last_y, last_x) of whole rectangles."""
    return cells.groupBy("tile_id").agg(F.max("y").alias("last_y"), F.max("x").alias("last_x"))


def edge_hysteresis(cells: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """(tile_id, y, x, label) of ridge cells above the low threshold whose 8-connected component reaches the high one.
    ``cells`` may have m2 and ridge already (halo.stencils)."""
    ridges = cells if "ridge" in cells.columns else edge_nms(cells)
    marked = ridges.select(*KEYS, "m2", "ridge").join(edge_thresholds(ridges, settings), "tile_id").withColumn("_m", F.sqrt(F.col("m2").cast("double")))
    weak = marked.where("ridge and _m > low").select(*KEYS, (F.col("_m") > F.col("high")).alias("strong"))
    named = labels(weak, "true", carry=("strong",))
    alive = named.groupBy("tile_id", "label").agg(F.max("strong").alias("alive")).where("alive")
    return named.join(alive.drop("alive"), ["tile_id", "label"], "left_semi").select(*KEYS, "label")


def closed_edges(cells: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """(tile_id, y, x, edge): the closed edge map over all cells."""
    found = close(edge_hysteresis(cells, settings), sizes_of(cells)).withColumn("edge", F.lit(1))
    return cells.select(*KEYS).join(found, KEYS, "left").withColumn("edge", F.coalesce("edge", F.lit(0)))


def filled_cells(edges: DataFrame, sizes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(tile_id, y, x) that are ``edges`` (tile_id, y, x) or enclosed by them: all but the background that is 4-connected to the
    raster's border. ``sizes`` as of sizes_of.

    Background is never listed cell by cell: each block labels its own, tells what it has along its border, and after
    these labels are joined over block borders keeps what no outer label holds. Rasters of one block need no second look."""
    at = lambda c: F.floor(F.col(c) / block).cast("int")
    own = edges.withColumns({"by": at("y"), "bx": at("x")}).groupBy("tile_id", "by", "bx").agg(F.collect_list("y").alias("ys"), F.collect_list("x").alias("xs"))  # of one block
    each = lambda last: F.explode(F.sequence(F.lit(0), at(last)))
    every = sizes.withColumn("by", each("last_y")).withColumn("bx", each("last_x")).join(own, ["tile_id", "by", "bx"], "left")
    spread = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = cut(every.select("tile_id", "by", "bx", "last_y", "last_x", "ys", "xs").repartition(spread, "tile_id", "by", "bx"))

    def parts(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Edge cells, background labels, and which background touches the raster's border."""
        y0, x0 = row["by"] * block, row["bx"] * block
        h, w = min(block, row["last_y"] + 1 - y0), min(block, row["last_x"] + 1 - x0)
        edge = np.zeros((h, w), bool)
        if row["ys"] is not None:
            edge[np.array(row["ys"]) - y0, np.array(row["xs"]) - x0] = True
        number = np.arange(y0, y0 + h, dtype=np.int64)[:, None] * ROW + np.arange(x0, x0 + w)[None, :]
        label = label_block(~edge, number, FOUR) if edge.any() else np.full_like(number, number[0, 0])
        rim = np.zeros((h, w), bool)
        rim[0] |= y0 == 0
        rim[-1] |= y0 + h > row["last_y"]
        rim[:, 0] |= x0 == 0
        rim[:, -1] |= x0 + w > row["last_x"]
        return edge, label, np.isin(label, label[rim & ~edge])

    def borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            edge, label, outer = parts(row)
            on = np.zeros_like(edge)
            on[0], on[-1], on[:, 0], on[:, -1] = True, True, True, True
            y, x = np.nonzero(on & ~edge)
            columns = (y + row["by"] * block).astype(np.int32), (x + row["bx"] * block).astype(np.int32), label[y, x], outer[y, x]
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(row["tile_id"], pa.string()), len(y)), *map(pa.array, columns)], ["tile_id", "y", "x", "part", "outer"])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            edge, label, outer = parts(row)
            out = outer if row.get("outside") is None else outer | np.isin(label, np.array(row["outside"], np.int64))
            y, x = np.nonzero(edge | ~out)
            columns = (y + row["by"] * block).astype(np.int32), (x + row["bx"] * block).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(row["tile_id"], pa.string()), len(y)), *map(pa.array, columns)], ["tile_id", "y", "x"])

    schema = "tile_id string, y int, x int"
    if not packed.where("by > 0 or bx > 0").limit(1).count():
        return packed.where("ys is not null").mapInArrow(keep, schema)
    rim = cut(packed.mapInArrow(borders, schema + ", part long, outer boolean"))
    beside = rim.withColumn("s", F.explode(F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in FOUR if (dy, dx) > (0, 0)))))
    beside = beside.select("tile_id", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"), F.col("part").alias("other"))
    links = beside.join(rim.select("tile_id", "y", "x", "part"), KEYS).where("part <> other").select(F.struct("tile_id", "part").alias("a"), F.struct("tile_id", F.col("other").alias("part")).alias("b"))
    joined = components(links.distinct()).select("node.tile_id", "node.part", F.col("component.part").alias("whole"))
    known = rim.groupBy("tile_id", "part").agg(F.max("outer").alias("outer"), F.min_by(F.struct(at("y").alias("by"), at("x").alias("bx")), F.struct("y", "x")).alias("of"))
    known = known.join(joined, ["tile_id", "part"], "left").withColumn("whole", F.coalesce("whole", "part"))
    outside = known.join(known.where("outer").select("tile_id", "whole").distinct(), ["tile_id", "whole"], "left_semi")
    outside = outside.groupBy("tile_id", "of.by", "of.bx").agg(F.collect_list("part").alias("outside"))  # at most the border cells of a block
    return packed.join(outside, ["tile_id", "by", "bx"], "left").mapInArrow(keep, schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(len(batch)):
            cells_ = ((name, batch.column(name)[i]) for name in batch.schema.names)
            yield {name: (v.values.to_numpy() if v.is_valid else None) if isinstance(v, pa.ListScalar) else v.as_py() for name, v in cells_}


def filled_mask(closed: DataFrame) -> DataFrame:
    """(tile_id, y, x) that are edges of closed(tile_id, y, x, edge) over all cells, or enclosed by them."""
    return filled_cells(closed.where("edge = 1").select(*KEYS), sizes_of(closed))


def region_cells(filled: DataFrame) -> DataFrame:
    """(tile_id, y, x, label, boundary): filled cells by 8-connected region; boundary cells have a side outside."""
    named = labels(filled, "true")
    beside = lambda at, across: Window.partitionBy("tile_id", across).orderBy(at)
    inner = F.lit(True)
    for at, across in (("x", "y"), ("y", "x")):
        line = beside(at, across)
        inner = inner & (F.coalesce(F.lag(at).over(line), F.lit(-9)) == F.col(at) - 1) & (F.coalesce(F.lead(at).over(line), F.lit(-9)) == F.col(at) + 1)
    return named.withColumn("boundary", ~inner)


def region_sums(cells: DataFrame) -> DataFrame:
    """(tile_id, label, n_cells, boundary_cells, area_px): the area of the outline through cell centres by Pick's theorem,
    at least 0."""
    sums = cells.groupBy("tile_id", "label").agg(F.count("*").alias("n_cells"), F.sum(F.col("boundary").cast("long")).alias("boundary_cells"))
    return sums.withColumn("area_px", F.greatest(F.lit(0.0), F.col("n_cells") - F.col("boundary_cells") / 2.0 - 1.0))


def obstacles(found: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Regions of at least the least area, with area_m2 and obstacle_id: from 0 in the order of their first cells."""
    kept = found.where(F.col("area_px") >= settings.min_obstacle_area_px)
    number = F.row_number().over(Window.partitionBy("tile_id").orderBy("label")) - 1
    return kept.withColumn("obstacle_id", number.cast("int")).withColumn("area_m2", F.col("area_px") * settings.meters_per_pixel**2)


def enclosing_circle(points: np.ndarray) -> tuple[float, float, float]:
    """Smallest circle (x, y, radius) around points: grown by the farthest point outside, over the at most three points
    that fix it."""

    def through(p: list[np.ndarray]) -> tuple[float, float, float]:
        if len(p) == 1:
            return p[0][0], p[0][1], 0.0
        if len(p) == 2:
            c = (p[0] + p[1]) / 2
            return c[0], c[1], math.dist(p[0], p[1]) / 2
        a, b = p[1] - p[0], p[2] - p[0]
        d = 2 * (a[0] * b[1] - a[1] * b[0])
        if abs(d) < 1e-12:
            return 0.0, 0.0, math.inf
        u = np.array([b[1] * (a @ a) - a[1] * (b @ b), a[0] * (b @ b) - b[0] * (a @ a)]) / d
        return p[0][0] + u[0], p[0][1] + u[1], math.hypot(*u)

    points = points.astype(float)
    fixed = [points[0]]
    while True:
        x, y, r = through(fixed)
        away = np.hypot(points[:, 0] - x, points[:, 1] - y)
        far = int(away.argmax())
        if away[far] <= r * (1 + 1e-9) + 1e-9:
            return x, y, r
        tried = [[points[far]]] + [[points[far], p] for p in fixed] + [[points[far], p, q] for i, p in enumerate(fixed) for q in fixed[:i]]
        holds = [(c[2], t) for t in tried if (c := through(t))[2] < math.inf and all(math.dist(c[:2], p) <= c[2] * (1 + 1e-9) + 1e-9 for p in (*fixed, points[far]))]
        fixed = min(holds, key=lambda h: h[0])[1]


def obstacle_circles(cells: DataFrame, kept: DataFrame) -> DataFrame:
    """``kept`` obstacles with the centre x, y (to six decimals, then half to even) and radius_px of the smallest circle around their
    boundary. A region's boundary is gathered row by row to its two ends first: inner points cannot fix the circle."""
    ends = cells.where("boundary").join(kept.select("tile_id", "label"), ["tile_id", "label"]).groupBy("tile_id", "label", "y").agg(F.min("x").alias("x0"), F.max("x").alias("x1"))

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        points = np.concatenate([pdf[["x0", "y"]].to_numpy(), pdf[["x1", "y"]].to_numpy()])
        x, y, r = enclosing_circle(points)
        return pd.DataFrame({"tile_id": pdf["tile_id"][:1], "label": pdf["label"][:1], "x": [int(np.rint(np.round(x, 6)))], "y": [int(np.rint(np.round(y, 6)))], "radius_px": [r]})

    circles = ends.groupBy("tile_id", "label").applyInPandas(each, "tile_id string, label long, x int, y int, radius_px double")
    return kept.join(circles, ["tile_id", "label"])


def obstacle_mask(cells: DataFrame, kept: DataFrame) -> DataFrame:
    """(tile_id, y, x) of the kept obstacles."""
    return cells.join(kept.select("tile_id", "label"), ["tile_id", "label"], "left_semi").select(*KEYS)


def obstacle_distance(cells: DataFrame, mask: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """(tile_id, y, x, distance_m): exact Euclidean distance to the nearest mask cell of the tile, FAR_M if it has none.
    Windows find the nearest mask cell of each column; then each row, as arrays, takes the least over its columns."""
    marked = cells.select(*KEYS).join(mask.withColumn("_on", F.lit(1)), KEYS, "left")
    at = F.when(F.col("_on") == 1, F.col("y"))
    up = Window.partitionBy("tile_id", "x").orderBy("y")
    above = F.last(at, ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, 0))
    below = F.first(at, ignorenulls=True).over(up.rowsBetween(0, Window.unboundedFollowing))
    gap = F.least(F.col("y") - above, below - F.col("y"))  # least passes over nulls
    rows = marked.withColumn("gap", gap).groupBy("tile_id", "y").agg(F.array_sort(F.collect_list(F.struct("x", "gap"))).alias("row"))
    metres = settings.meters_per_pixel

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("row")
            cuts, cells_ = lists.offsets.to_numpy(), lists.values
            x, gaps = cells_.field("x").to_numpy(), cells_.field("gap").fill_null(-1).to_numpy()
            for i in range(len(batch)):
                gap = gaps[cuts[i] : cuts[i + 1]].astype(float)
                best = nearest(np.where(gap < 0, np.inf, gap * gap))
                far = np.where(np.isinf(best), FAR_M, np.sqrt(best) * metres)
                own = [pa.repeat(batch.column(c)[i], len(far)) for c in ("tile_id", "y")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(x[cuts[i] : cuts[i + 1]]), pa.array(far)], ["tile_id", "y", "x", "distance_m"])

    return rows.mapInArrow(each, "tile_id string, y int, x int, distance_m double")


#: Columns that ``nearest`` looks away at most while it shifts whole rows.
SHIFTS = 256


def nearest(squares: np.ndarray, shifts: int = SHIFTS) -> np.ndarray:
    """For each place i the least of squares[j] + (i - j)^2. Whole rows are shifted as far as any place can still gain; a row
    whose nearest columns are farther than ``shifts`` takes the lower envelope of the parabolas, in linear time."""
    n, there = len(squares), np.flatnonzero(np.isfinite(squares))
    if not len(there):
        return squares.copy()
    at = np.arange(n)
    right = np.clip(np.searchsorted(there, at), 0, len(there) - 1)
    best = squares.copy()
    for j in (there[right], there[np.maximum(right - 1, 0)]):  # a bound that is finite everywhere
        best = np.minimum(best, squares[j] + (at - j) ** 2)
    if best.max() <= shifts * shifts:
        step = 1
        while step < n and step * step < best.max():
            best[step:] = np.minimum(best[step:], squares[:-step] + step * step)
            best[:-step] = np.minimum(best[:-step], squares[step:] + step * step)
            step += 1
        return best
    seats, borders = [int(there[0])], [-np.inf]  # parabolas of the envelope, and where each begins
    for j in there[1:].tolist():
        while True:
            i = seats[-1]
            meet = (squares[j] + j * j - squares[i] - i * i) / (2 * (j - i))
            if meet > borders[-1]:
                break
            seats.pop()
            borders.pop()
        seats.append(j)
        borders.append(meet)
    own = np.array(seats)[np.searchsorted(np.array(borders), at, side="left") - 1]
    return squares[own] + (at - own) ** 2
