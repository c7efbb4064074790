"""Neighbourhood operators on cells(tile_id, y, x, ...) as separable window passes.

Every pass partitions by (tile, row) or (tile, column), never by tile alone, so a mosaic of any size is many small
groups. Borders reflect without repeating the edge cell: index -1 is 1, n is n - 2. Sums stay integers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from regolith.settings import DEFAULT, Settings


def along_x() -> WindowSpec:
    return Window.partitionBy("tile_id", "y").orderBy("x")


def along_y() -> WindowSpec:
    return Window.partitionBy("tile_id", "x").orderBy("y")


def _sides(value: str, along: WindowSpec) -> tuple[Column, Column]:
    """The neighbours before and after, reflected at the ends; a line of one cell neighbours itself."""
    before, after = F.lag(value).over(along), F.lead(value).over(along)
    return F.coalesce(before, after, F.col(value)), F.coalesce(after, before, F.col(value))


def sobel(cells: DataFrame, value: str = "intensity") -> DataFrame:
    """``cells`` with integer 3x3 Sobel sums gx and gy of ``value``: differences and sums along x, then along y."""
    left, right = _sides(value, along_x())
    across = cells.withColumns({"_d": right - left, "_s": left + 2 * F.col(value) + right})
    (d0, d1), (s0, s1) = _sides("_d", along_y()), _sides("_s", along_y())
    return across.withColumns({"gx": d0 + 2 * F.col("_d") + d1, "gy": s1 - s0}).drop("_d", "_s")


def slope(cells: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """``cells`` with gradient (rise over run) and slope_deg of the elevation that intensity stands for."""
    return sobel(cells).withColumn("gradient", _steepness(settings)).withColumn("slope_deg", F.degrees(F.atan("gradient"))).drop("gx", "gy")


def _steepness(settings: Settings, gx: str = "gx", gy: str = "gy") -> Column:
    unit = settings.elevation_range_m / 255.0 / (8.0 * settings.meters_per_pixel)
    return F.sqrt((F.col(gx) * F.col(gx) + F.col(gy) * F.col(gy)).cast("double")) * F.lit(unit)


def _five(value: str, along: WindowSpec) -> list[Column]:
    """Five neighbours along a line, reflected; in a line of one or two cells more than once."""
    one, two = F.lag(value).over(along), F.lag(value, 2).over(along)
    next_, after = F.lead(value).over(along), F.lead(value, 2).over(along)
    own = F.col(value)
    return [
        F.coalesce(two, F.when(one.isNull(), after), own),
        F.coalesce(one, next_, own),
        own,
        F.coalesce(next_, one, own),
        F.coalesce(after, F.when(next_.isNull(), two), own),
    ]


def gaussian_blur(cells: DataFrame, value: str = "intensity") -> DataFrame:
    """``cells`` with blurred: the 1-4-6-4-1 kernel along y and x, rounded to 8 bits once at the end. The pass along x comes
    last, so that one along x may follow without another exchange."""
    weigh = lambda c: c[0] + 4 * c[1] + 6 * c[2] + 4 * c[3] + c[4]
    down = cells.withColumn("_b", weigh(_five(value, along_y())))
    return down.withColumn("blurred", F.floor((weigh(_five("_b", along_x())) + 128) / 256).cast("int")).drop("_b")


def edge_gradient(cells: DataFrame) -> DataFrame:
    """``cells`` with blurred, gx, gy and m2 = gx^2 + gy^2 of the blurred image."""
    return sobel(gaussian_blur(cells), "blurred").withColumn("m2", F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))


def _with_halo(df: DataFrame, axis: str, across: str, radius: int) -> DataFrame:
    """Adds the reflected copies that lie up to ``radius`` outside each line: only cells near an end are copied. A line of
    fewer cells is reflected as often as it takes."""
    last = F.max(axis).over(Window.partitionBy("tile_id", across))
    at = F.col(axis)
    places = F.array_compact(
        F.array(at, F.when((at >= 1) & (at <= radius), -at), F.when((at < F.col("_last")) & (at >= F.col("_last") - radius), 2 * F.col("_last") - at))
    )
    fold = "case when _last = 0 then 0 else least(pmod(p, 2 * _last), 2 * _last - pmod(p, 2 * _last)) end"
    narrow = F.expr(f"filter(sequence(-{radius}, _last + {radius}), p -> {fold} = {axis})")
    places = F.when(F.col("_last") >= radius, places).otherwise(narrow)
    return df.withColumn("_last", last).withColumn(axis, F.explode(places))


def layers(cells: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """``cells`` with gradient, slope_deg and roughness by one pass along x and one along y: the reflected copies that
    roughness needs serve the Sobel sums too."""
    n = settings.roughness_window + (settings.roughness_window + 1) % 2
    r = n // 2

    def passed(df: DataFrame, axis: str, across: str, own) -> DataFrame:
        line = Window.partitionBy("tile_id", across).orderBy(axis)
        sums = {c: F.sum(c).over(line.rowsBetween(-r, r)) for c in ("_s", "_q")}
        return _with_halo(df, axis, across, r).withColumns(sums | own(line)).where(F.col(axis).between(0, F.col("_last"))).drop("_last")

    near = lambda c, line: (F.lag(c).over(line), F.col(c), F.lead(c).over(line))

    def first(line: WindowSpec) -> dict[str, Column]:
        left, own, right = near("intensity", line)
        return {"_d": right - left, "_t": left + 2 * own + right}

    def second(line: WindowSpec) -> dict[str, Column]:
        (d0, d, d1), (t0, _, t1) = near("_d", line), near("_t", line)
        return {"_gx": d0 + 2 * d + d1, "_gy": t1 - t0}

    start = cells.withColumns({"_s": F.col("intensity").cast("long"), "_q": (F.col("intensity") * F.col("intensity")).cast("long")})
    both = passed(passed(start, "x", "y", first), "y", "x", second)
    return from_sums(both.drop("_d", "_t"), settings)


def from_sums(sums: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """``sums`` with gradient, slope_deg and roughness instead of the integers that they follow from: Sobel sums _gx, _gy, and sums
    _s of intensity and _q of its square over the roughness window."""
    n = settings.roughness_window + (settings.roughness_window + 1) % 2
    spread = F.sqrt((n * n * F.col("_q") - F.col("_s") * F.col("_s")).cast("double")) / F.lit(float(n * n) * 255.0)
    found = sums.withColumns({"gradient": _steepness(settings, "_gx", "_gy"), "roughness": F.least(F.lit(1.0), spread / 0.5)})
    return found.withColumn("slope_deg", F.degrees(F.atan("gradient"))).drop("_s", "_q", "_gx", "_gy")


def roughness(cells: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """``cells`` with roughness: standard deviation of intensity / 255 in a square window, over 0.5, at most 1. An even
    window is widened by one. Sums of intensity and its square along x, then y: exact integers."""
    return layers(cells, settings).drop("gradient", "slope_deg")


# Tangents of the sectors' borders, 22.5 and 67.5 degrees.
TAN_LOW, TAN_HIGH = math.sqrt(2) - 1, math.sqrt(2) + 1


def edge_nms(cells: DataFrame) -> DataFrame:
    """edge_gradient with ``ridge``: the magnitude exceeds the neighbour before and reaches the one after, along the
    gradient's direction in four sectors. Outside the image magnitudes are 0."""
    g = edge_gradient(cells)  # ends with a pass along y, so that direction goes on
    near = lambda f, v, along: F.coalesce(f(v).over(along), F.lit(0))
    g = g.withColumns({"_n": near(F.lag, "m2", along_y()), "_s": near(F.lead, "m2", along_y())})
    for side, f in (("w", F.lag), ("e", F.lead)):
        g = g.withColumns({f"_{side}": near(f, "m2", along_x()), f"_n{side}": near(f, "_n", along_x()), f"_s{side}": near(f, "_s", along_x())})
    ax, ay = F.abs("gx").cast("double"), F.abs("gy").cast("double")
    falling = F.col("gx") * F.col("gy") >= 0  # towards south-east
    before = F.when(ay <= ax * TAN_LOW, F.col("_w")).when(ay >= ax * TAN_HIGH, F.col("_n")).when(falling, F.col("_nw")).otherwise(F.col("_ne"))
    after = F.when(ay <= ax * TAN_LOW, F.col("_e")).when(ay >= ax * TAN_HIGH, F.col("_s")).when(falling, F.col("_se")).otherwise(F.col("_sw"))
    return g.withColumn("ridge", (F.col("m2") > before) & (F.col("m2") >= after)).drop("_w", "_e", "_n", "_s", "_nw", "_ne", "_sw", "_se")


def _ellipse(df: DataFrame, value: str, pick) -> DataFrame:
    """Max or min over a 5x5 ellipse: rows of widths 1, 5, 5, 5, 1. Cells outside the image do not count."""
    wide = pick(value).over(along_x().rowsBetween(-2, 2))
    df = df.withColumn("_wide", wide)
    rows = [pick("_wide").over(along_y().rowsBetween(-1, 1)), F.lag(value, 2).over(along_y()), F.lead(value, 2).over(along_y())]
    join = F.greatest if pick is F.max else F.least  # both pass over nulls
    return df.withColumn(value, join(*rows)).drop("_wide")


def morph_close(cells: DataFrame, value: str = "edge") -> DataFrame:
    """``cells`` with the 0/1 column ``value`` closed by a 5x5 ellipse: dilation, then erosion."""
    return _ellipse(_ellipse(cells, value, F.max), value, F.min)


def _averaged(df: DataFrame, line: list[str], at: str, n: str, m: str, value: str, out: str) -> DataFrame:
    """Averages along ``at`` of lines of ``n`` cells into ``m``: a target is the difference of the running sums at its two ends,
    within a cell in proportion. Only the cells that hold an end go on; both windows share one exchange."""
    along = Window.partitionBy(*line).orderBy(at)
    step = F.col(n) / F.col(m)
    first = F.ceil((F.col(at) - 1e-9) / step).cast("int")  # the first target that begins at this cell or behind it
    df = df.withColumns({
        "_before": F.coalesce(F.sum(value).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "_all": F.sum(value).over(Window.partitionBy(*line)), out: first,
    })
    begins = df.where((F.col(out) < F.col(m)) & (F.floor(F.col(out) * step + 1e-9) == F.col(at)))
    begins = begins.withColumn("_upto", F.col("_before") + F.greatest(F.lit(0.0), F.col(out) * step - F.col(at)) * F.col(value))
    mean = (F.coalesce(F.lead("_upto").over(along), F.col("_all").cast("double")) - F.col("_upto")) / step
    return begins.withColumn("_mean", mean).withColumn(value, F.when(F.col(n) == F.col(m), F.col(value).cast("double")).otherwise(F.col("_mean"))).drop("_before", "_all", "_upto", "_mean", at)


def downsample(cells: DataFrame, value: str, max_dim: int = DEFAULT.grid_max_dim) -> DataFrame:
    """(tile_id, row, col, value, scale): each axis averaged by area so that the longest side is ``max_dim``; a tile that
    fits is unchanged. Rows first, then the columns of what is left: no cell is copied."""
    dims = cells.groupBy("tile_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    longest = F.greatest("h", "w")
    scale = F.when(longest <= max_dim, F.lit(1.0)).otherwise(longest / F.lit(float(max_dim)))
    new = lambda n: F.greatest(F.lit(1), F.rint(F.col(n) / F.col("scale")).cast("int"))
    dims = dims.withColumn("scale", scale).withColumns({"nh": new("h"), "nw": new("w")})
    met = cells.select("tile_id", "y", "x", value).join(dims, "tile_id")
    across = _averaged(met, ["tile_id", "y"], "x", "w", "nw", value, "col")
    down = _averaged(across, ["tile_id", "col"], "y", "h", "nh", value, "row")
    return down.select("tile_id", "row", "col", value, "scale")
