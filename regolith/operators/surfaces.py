"""Least-cost surfaces over grids of many blocks, and the routes through them.

A grid is cut into square blocks with a rim of the neighbouring cells. A block relaxes to rest by itself with shifted arrays,
from the costs on its rim; where its border got cheaper it sends the border's strips to the neighbours that they face,
and only blocks that got a strip run again. So rounds are about as many as blocks a route crosses, and between rounds
only strips are kept, never surfaces.

Routes: in each block at rest the steps back are followed, all at once by doubling, from the border cells to the first cell
outside. What is left is a chain from border to border, whose jumps are doubled again by joins; its cells on the way from the
goal are picked by these jumps, and only the blocks that a route crosses are walked.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regolith.functions.lineage import cut
from regolith.operators.relax import BLOCK, EIGHT, ROW

KEYS = ["plan_id", "tile_id", "by", "bx"]
#: Blocks under way that are broadcast to the grid's blocks at most, with their strips; more are joined by shuffle.
BROADCAST_BLOCKS = 1000
#: Rounds whose strips are kept one by one before the older of each side go.
KEPT_ROUNDS = 8
_OWN = 8  # the side of a block's own border, as last sent
_STRIPS = "plan_id long, tile_id string, by int, bx int, side int, costs array<double>"


def grid_blocks(grids: DataFrame, block: int = BLOCK) -> DataFrame:
    """(tile_id, by, bx, height, width, last_by, last_bx, hazard, elevation) of ``grids`` (tile_id, row, col, hazard,
    elevation_m): both layers with a rim of one cell, row by row; infinite hazard where there is no cell. A cell goes to at most
    four blocks, in one exchange."""
    reach = lambda at: F.array_distinct(F.array(F.floor((F.col(at) - 1) / block), F.floor(F.col(at) / block), F.floor((F.col(at) + 1) / block)))
    size = grids.groupBy("tile_id").agg(F.max("row").alias("last_row"), F.max("col").alias("last_col"))
    spread = int(grids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = grids.join(size, "tile_id").withColumn("by", F.explode(reach("row"))).withColumn("bx", F.explode(reach("col")))
    met = met.where(f"by >= 0 and bx >= 0 and by * {block} <= last_row and bx * {block} <= last_col")
    met = met.select("tile_id", F.col("by").cast("int").alias("by"), F.col("bx").cast("int").alias("bx"), "last_row", "last_col", "row", "col", "hazard", "elevation_m")

    def each(cells: pa.Table) -> pa.Table:
        tile, by, bx, last_row, last_col = (cells[c][0].as_py() for c in ("tile_id", "by", "bx", "last_row", "last_col"))
        height, width = min(block, last_row + 1 - by * block), min(block, last_col + 1 - bx * block)
        y, x = cells["row"].to_numpy() - by * block + 1, cells["col"].to_numpy() - bx * block + 1
        hazard, elevation = np.full((height + 2, width + 2), np.inf), np.full((height + 2, width + 2), np.nan)
        hazard[y, x], elevation[y, x] = cells["hazard"].to_numpy(), cells["elevation_m"].to_numpy()
        one = {"tile_id": tile, "by": by, "bx": bx, "height": height, "width": width, "last_by": last_row // block, "last_bx": last_col // block}
        return pa.table({k: [v] for k, v in one.items()} | {"hazard": pa.array([hazard.ravel()]), "elevation": pa.array([elevation.ravel()])}, _BLOCK_SCHEMA)

    schema = "tile_id string, by int, bx int, height int, width int, last_by int, last_bx int, hazard array<double>, elevation array<double>"
    return cut(met.repartition(spread, "tile_id", "by", "bx").groupBy("tile_id", "by", "bx").applyInArrow(each, schema))


_BLOCK_SCHEMA = pa.schema(
    [("tile_id", pa.string()), *((c, pa.int32()) for c in ("by", "bx", "height", "width", "last_by", "last_bx")), ("hazard", pa.list_(pa.float64())), ("elevation", pa.list_(pa.float64()))]
)


def _facing(cost: np.ndarray, side: int, inside: bool) -> tuple:
    """Index of the cells of a block with its rim that face the neighbour on ``side``: its own border, or the rim there."""
    dy, dx = EIGHT[side]
    at = lambda d, n: slice(1, n - 1) if d == 0 else ((1 if d < 0 else n - 2) if inside else (0 if d < 0 else n - 1))
    return at(dy, cost.shape[0]), at(dx, cost.shape[1])


class Rest:
    """A block of one plan, relaxed to rest from the strips on its rim."""

    def __init__(self, row: dict, block: int, k: float) -> None:
        self.row, self.y0, self.x0 = row, row["by"] * block - 1, row["bx"] * block - 1
        shape = row["height"] + 2, row["width"] + 2
        hazard, elevation = row["hazard"].reshape(shape), row["elevation"].reshape(shape)
        self.cost = cost = np.full(shape, np.inf)
        self.sent = [np.full(np.size(cost[_facing(cost, side, True)]), np.inf) for side in range(8)]
        for strip in row["strips"] or []:
            side, costs = strip["side"], np.array(strip["costs"], float)
            if side == _OWN:
                for i, part in enumerate(np.split(costs, np.cumsum([len(s) for s in self.sent])[:-1])):
                    self.sent[i] = np.minimum(self.sent[i], part)
            else:
                at = _facing(cost, side, False)
                cost[at] = np.minimum(cost[at], costs if np.ndim(cost[at]) else costs[0])
        self.start = row["start_row"] - self.y0, row["start_col"] - self.x0
        if self.holds(self.start):
            cost[self.start] = 0.0
        inner = np.s_[1:-1, 1:-1]
        most_tan = float(np.tan(np.radians(row["max_slope_deg"])))
        self.into = []
        for dy, dx in EIGHT:
            run = np.hypot(dy, dx) * row["meters_per_cell"]
            rise = np.abs(elevation[inner] - self._from(elevation, dy, dx)) / run
            barred = (rise > most_tan) | (hazard[inner] >= row["max_hazard"]) | np.isnan(rise)
            self.into.append(np.where(barred, np.inf, run * (1 + hazard[inner]) * (1 + k * rise)))
        while True:
            before = cost[inner].copy()
            for (dy, dx), step in zip(EIGHT, self.into, strict=True):
                np.minimum(cost[inner], self._from(cost, dy, dx) + step, out=cost[inner])
            if (cost[inner] == before).all():
                break

    @staticmethod
    def _from(a: np.ndarray, dy: int, dx: int) -> np.ndarray:
        return a[1 + dy : a.shape[0] - 1 + dy, 1 + dx : a.shape[1] - 1 + dx]

    def holds(self, at: tuple[int, int]) -> bool:
        """Whether a place in the block's own numbers is inside it, not on the rim."""
        return 1 <= at[0] <= self.row["height"] and 1 <= at[1] <= self.row["width"]

    def strips(self) -> Iterator[dict]:
        """Strips that got cheaper, addressed to the neighbours that they face, and then the own border."""
        own = {c: self.row[c] for c in KEYS}
        now = [np.atleast_1d(self.cost[_facing(self.cost, side, True)]) for side in range(8)]
        for side, (dy, dx) in enumerate(EIGHT):
            by, bx = own["by"] + dy, own["bx"] + dx
            if 0 <= by <= self.row["last_by"] and 0 <= bx <= self.row["last_bx"] and (now[side] < self.sent[side]).any():
                yield own | {"by": by, "bx": bx, "side": 7 - side, "costs": now[side]}
        yield own | {"side": _OWN, "costs": np.concatenate(now)}

    def back(self) -> np.ndarray:
        """For each cell with the rim the index in EIGHT of the step back; -1 at the start, on the rim and where nothing leads.
        Ties go to the smallest cell."""
        out, low = np.full(self.cost.shape, -1), np.full((self.row["height"], self.row["width"]), np.inf)
        inner = out[1:-1, 1:-1]
        for i, ((dy, dx), step) in enumerate(zip(EIGHT, self.into, strict=True)):
            through = self._from(self.cost, dy, dx) + step
            better = through < low
            inner[better], low = i, np.where(better, through, low)
        inner[np.isinf(self.cost[1:-1, 1:-1])] = -1
        if self.holds(self.start):
            out[self.start] = -1
        return out

    def surface(self) -> pa.RecordBatch:
        y, x = np.nonzero(np.isfinite(self.cost[1:-1, 1:-1]))
        y, x = y + 1, x + 1
        back = self.back()[y, x]
        columns = np.full(len(y), self.row["plan_id"]), (y + self.y0).astype(np.int32), (x + self.x0).astype(np.int32), self.cost[y, x], back.astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["plan_id", "row", "col", "cost", "back"])

    def _next(self) -> np.ndarray:
        """Place of the cell before, as flat index; a cell that ends a way within the block is its own."""
        wide = self.cost.shape[1]
        jumps = np.array([dy * wide + dx for dy, dx in EIGHT] + [0])
        return np.arange(self.cost.size) + jumps[self.back().ravel()]

    def name(self, flat: np.ndarray) -> np.ndarray:
        y, x = np.divmod(flat, self.cost.shape[1])
        return (y + self.y0).astype(np.int64) * ROW + x + self.x0

    def exits(self) -> pa.RecordBatch:
        """(plan_id, node, next, steps): from each reached border cell, and the goal, to the first cell outside; null where the way
        ends at the start."""
        at = self._next()
        steps = (at != np.arange(len(at))).astype(np.int64)
        while True:
            then = at[at]
            if (then == at).all():
                break
            steps, at = steps + steps[at], then
        edge = np.zeros(self.cost.shape, bool)
        edge[1, 1:-1] = edge[-2, 1:-1] = edge[1:-1, 1] = edge[1:-1, -2] = True
        goal = self.row["goal_row"] - self.y0, self.row["goal_col"] - self.x0
        if self.holds(goal):
            edge[goal] = True
        node = np.flatnonzero(edge & np.isfinite(self.cost))
        y, x = np.divmod(at[node], self.cost.shape[1])
        outside = (y == 0) | (x == 0) | (y == self.cost.shape[0] - 1) | (x == self.cost.shape[1] - 1)
        columns = np.full(len(node), self.row["plan_id"]), self.name(node), pa.array(self.name(at[node]), mask=~outside), steps[node]
        return pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], ["plan_id", "node", "next", "steps"])

    def walk(self) -> pa.RecordBatch:
        """(plan_id, row, col, nth): the cells from each of the row's nodes, whose place on the way is told, to the way's exit."""
        at, wide, out = self._next(), self.cost.shape[1], []
        for node in self.row["nodes"]:
            y, x = divmod(node["node"], ROW)
            now, nth = (y - self.y0) * wide + x - self.x0, node["nth"]
            while self.holds(divmod(now, wide)):
                out.append((now, nth))
                if at[now] == now:
                    break
                now, nth = at[now], nth + 1
        cells = np.array(out, np.int64).reshape(-1, 2)
        y, x = np.divmod(cells[:, 0], wide)
        columns = np.full(len(out), self.row["plan_id"]), (y + self.y0).astype(np.int32), (x + self.x0).astype(np.int32), cells[:, 1]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["plan_id", "row", "col", "nth"])


class Surfaces:
    """Plans (plan_id, tile_id, start_row, start_col, goal_row, goal_col, meters_per_cell, max_slope_deg, max_hazard) over
    ``grids``, relaxed to rest when made. ``rounds``: how many it took."""

    def __init__(self, plans: DataFrame, grids: DataFrame, k: float, block: int = BLOCK, most_rounds: int = 100_000) -> None:
        self.block, self.k, self.rounds = block, k, 0
        self.plans = cut(plans.select("plan_id", "tile_id", "start_row", "start_col", "goal_row", "goal_col", "meters_per_cell", "max_slope_deg", "max_hazard"))
        self.blocks = grid_blocks(grids.join(self.plans.select("tile_id").distinct(), "tile_id", "left_semi"), block)
        at = lambda c: F.floor(F.col(c) / block).cast("int")
        active = self.plans.select("plan_id", "tile_id", at("start_row").alias("by"), at("start_col").alias("bx"))
        older: DataFrame | None = None
        recent: list[DataFrame] = []
        for _ in range(most_rounds):
            n = active.count()
            if not n:
                break
            self.rounds += 1
            found = cut(self._each(active, self._together(older, recent), lambda rest: _batch(rest.strips()), _STRIPS, n).withColumn("round", F.lit(self.rounds)))
            recent.append(found)
            active = found.where(F.col("side") < _OWN).select(KEYS).distinct()
            if len(recent) >= KEPT_ROUNDS:
                older, recent = cut(self._together(older, recent).groupBy(*KEYS, "side").agg(F.max_by("costs", "round").alias("costs"), F.max("round").alias("round"))), []
        else:
            raise RuntimeError(f"costs still improve after {most_rounds} rounds")
        self.held = self._together(older, recent) if self.rounds else self.plans.sparkSession.createDataFrame([], _STRIPS)

    @staticmethod
    def _together(older: DataFrame | None, recent: list[DataFrame]) -> DataFrame | None:
        every = [*([] if older is None else [older]), *recent]
        return functools.reduce(DataFrame.unionByName, every) if every else None

    def _each(self, active: DataFrame, held: DataFrame | None, do: Callable[[Rest], pa.RecordBatch], schema: str, n: int | None = None) -> DataFrame:
        """``do`` for each active block of a plan, at rest. A block's strips are the last of each side, of few rounds."""
        block, k = self.block, self.k
        if held is None:
            mine = active.withColumn("strips", F.lit(None).cast("array<struct<side: int, costs: array<double>>>"))
        else:
            own = held.join(active.select(KEYS), KEYS, "left_semi").groupBy(*KEYS).agg(F.collect_list(F.struct("side", "costs")).alias("strips"))
            mine = active.join(own, KEYS, "left")
        mine = mine.join(self.plans.drop("tile_id"), "plan_id")
        if n is not None and n <= BROADCAST_BLOCKS:
            mine = F.broadcast(mine)
        names = [*KEYS, "height", "width", "last_by", "last_bx", "hazard", "elevation", "strips", "start_row", "start_col", "goal_row", "goal_col", "meters_per_cell", "max_slope_deg", "max_hazard"]
        names += ["nodes"] if "nodes" in active.columns else []
        met = self.blocks.join(mine, ["tile_id", "by", "bx"]).select(*names)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(len(batch)):
                    row = {c: batch.column(c)[i] for c in batch.schema.names}
                    row = {c: v.values.to_numpy() if c in ("hazard", "elevation") else v.as_py() for c, v in row.items()}
                    yield do(Rest(row, block, k))

        return met.mapInArrow(run, schema)

    def _reached(self) -> DataFrame:
        return self.held.where(F.col("side") == _OWN).select(KEYS).distinct()

    def costs(self) -> DataFrame:
        """(plan_id, row, col, cost, back) of all cells that a plan's start leads to."""
        return self._each(self._reached(), self.held, Rest.surface, "plan_id long, row int, col int, cost double, back int")

    def routes(self) -> DataFrame:
        """(plan_id, segment_id, row, col) from start to goal of the plans whose goal is reached."""
        nodes = cut(self._each(self._reached(), self.held, Rest.exits, "plan_id long, node long, next long, steps long"))
        node = F.col("goal_row").cast("long") * ROW + F.col("goal_col")
        way = self.plans.select("plan_id", node.alias("node"), F.lit(0).cast("long").alias("nth")).join(nodes.select("plan_id", "node"), ["plan_id", "node"], "left_semi")
        way = on_the_way(nodes, way)
        at = lambda c: F.floor(c / self.block).cast("int")
        crossed = way.withColumns({"by": at(F.shiftright("node", 32)), "bx": at(F.col("node").bitwiseAND(ROW - 1))}).join(self.plans.select("plan_id", "tile_id"), "plan_id")
        crossed = cut(crossed.groupBy(*KEYS).agg(F.collect_list(F.struct("node", "nth")).alias("nodes")))  # at most the border cells of a block
        cells = cut(self._each(crossed, self.held, Rest.walk, "plan_id long, row int, col int, nth long"))
        last = cells.groupBy("plan_id").agg(F.max("nth").alias("last"))
        return cells.join(last, "plan_id").select("plan_id", (F.col("last") - F.col("nth")).cast("int").alias("segment_id"), "row", "col")


def on_the_way(nodes: DataFrame, starts: DataFrame, rounds: int = 40) -> DataFrame:
    """(plan_id, node, nth): every node that ``starts`` (plan_id, node, nth) meet by following ``nodes`` (plan_id, node, next, steps),
    and its steps from the start. Jumps of 1, 2, 4, ... nodes are made by joining them with themselves, then taken from the
    longest to the shortest: two joins for each doubling of the way."""
    jump = nodes.where("next is not null").select("plan_id", "node", "next", "steps")
    jumps = [jump]
    for _ in range(rounds):
        then = jump.select("plan_id", F.col("node").alias("next"), F.col("next").alias("_next"), F.col("steps").alias("_steps"))
        jump = cut(jump.join(then, ["plan_id", "next"]).select("plan_id", "node", F.col("_next").alias("next"), (F.col("steps") + F.col("_steps")).alias("steps")))
        if not jump.limit(1).count():
            break
        jumps.append(jump)
    else:
        raise RuntimeError(f"a way goes on after 2^{rounds} nodes")
    way = starts.select("plan_id", "node", "nth")
    for jump in reversed(jumps):
        far = way.join(jump, ["plan_id", "node"]).select("plan_id", F.col("next").alias("node"), (F.col("nth") + F.col("steps")).alias("nth"))
        way = cut(way.unionByName(far))
    return way


def _batch(rows: Iterator[dict]) -> pa.RecordBatch:
    rows = list(rows)
    kinds = {"plan_id": pa.int64(), "tile_id": pa.string(), "by": pa.int32(), "bx": pa.int32(), "side": pa.int32(), "costs": pa.list_(pa.float64())}
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in kinds.items()], list(kinds))
