"""Raster queries up to edges, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regolith.operators import hazard, stencil
from regolith.settings import NOISE_TILES as S
from regolith.sources.tables import CELLS, cells, with_ctes

UNIT = S.elevation_range_m / 255.0 / (8.0 * S.meters_per_pixel)
X, Y = "over (partition by tile_id, y order by x)", "over (partition by tile_id, x order by y)"


def _side(f: str, g: str, value: str, line: str) -> str:
    return f"coalesce({f}({value}) {line}, {g}({value}) {line}, {value})"


def sobel_sql(name: str, source: str, value: str) -> str:
    left, right = _side("lag", "lead", value, X), _side("lead", "lag", value, X)
    up = lambda v: _side("lag", "lead", v, Y)
    down = lambda v: _side("lead", "lag", v, Y)
    return f"""{name} as (
  select * exclude (dd, ss), {up("dd")} + 2 * dd + {down("dd")} as gx, {down("ss")} - {up("ss")} as gy
  from (select *, {right} - {left} as dd, {left} + 2 * {value} + {right} as ss from {source}))"""


SLOPE = sobel_sql("sloped0", "cells", "intensity") + f""",
sloped as (
  select tile_id, y, x, intensity, sqrt((gx * gx + gy * gy)::double) * {UNIT!r}::double as gradient,
         degrees(atan(sqrt((gx * gx + gy * gy)::double) * {UNIT!r}::double)) as slope_deg from sloped0)"""


def _five_sql(v: str, line: str) -> str:
    lag = lambda k: f"lag({v}, {k}) {line}"
    lead = lambda k: f"lead({v}, {k}) {line}"
    return (
        f"coalesce({lag(2)}, case when {lag(1)} is null then {lead(2)} else {v} end) + 4 * coalesce({lag(1)}, {lead(1)}) + 6 * {v}"
        f" + 4 * coalesce({lead(1)}, {lag(1)}) + coalesce({lead(2)}, case when {lead(1)} is null then {lag(2)} else {v} end)"
    )


BLUR = f"""blur as (
  select tile_id, y, x, intensity, ((({_five_sql("bb", Y)}) + 128) // 256)::int as blurred
  from (select *, {_five_sql("intensity", X)} as bb from cells))"""
EDGES = BLUR + ",\n" + sobel_sql("edge0", "blur", "blurred") + ",\nedges as (select *, gx * gx + gy * gy as m2 from edge0)"

R = S.roughness_window // 2
ROUGH = f"""ext as (select tile_id, max(y) as ly, max(x) as lx from cells group by tile_id),
hx as (
  select c.tile_id, y, v.x, intensity::bigint as s, (intensity * intensity)::bigint as q, lx, ly from cells c join ext using (tile_id),
  lateral (select unnest([c.x] || case when c.x between 1 and {R} then [-c.x] else [] end
    || case when c.x between lx - {R} and lx - 1 then [2 * lx - c.x] else [] end) as x) v),
sx as (
  select * from (select tile_id, y, x, lx, ly, sum(s) over r as s, sum(q) over r as q from hx
  window r as (partition by tile_id, y order by x rows between {R} preceding and {R} following)) where x between 0 and lx),
hy as (
  select c.tile_id, v.y, x, s, q, ly from sx c,
  lateral (select unnest([c.y] || case when c.y between 1 and {R} then [-c.y] else [] end
    || case when c.y between ly - {R} and ly - 1 then [2 * ly - c.y] else [] end) as y) v),
rough as (
  select tile_id, y, x, least(1, sqrt((81 * q - s * s)::double) / (81.0::double * 255) / 0.5) as roughness
  from (select tile_id, y, x, ly, sum(s) over r as s, sum(q) over r as q from hy
  window r as (partition by tile_id, x order by y rows between {R} preceding and {R} following)) where y between 0 and ly)"""

NMS = EDGES + f""",
side as (select *, coalesce(lag(m2) {X}, 0) as w_, coalesce(lead(m2) {X}, 0) as e_ from edges),
ring as (
  select *, coalesce(lag(m2) {Y}, 0) as n_, coalesce(lag(w_) {Y}, 0) as nw, coalesce(lag(e_) {Y}, 0) as ne,
         coalesce(lead(m2) {Y}, 0) as s_, coalesce(lead(w_) {Y}, 0) as sw, coalesce(lead(e_) {Y}, 0) as se from side),
nms as (
  select tile_id, y, x, m2,
    m2 > case when abs(gy) <= abs(gx) * {stencil.TAN_LOW!r}::double then w_ when abs(gy) >= abs(gx) * {stencil.TAN_HIGH!r}::double then n_ when gx * gy >= 0 then nw else ne end
    and m2 >= case when abs(gy) <= abs(gx) * {stencil.TAN_LOW!r}::double then e_ when abs(gy) >= abs(gx) * {stencil.TAN_HIGH!r}::double then s_ when gx * gy >= 0 then se else sw end as ridge
  from ring)"""

THRESHOLDS = f"""thresholds as (
  select tile_id, greatest(1, quantile_cont(sqrt(m2::double), {S.edge_percentile})) as high,
         {S.edge_low_ratio} * greatest(1, quantile_cont(sqrt(m2::double), {S.edge_percentile})) as low
  from edges group by tile_id)"""


def close_sql(name: str, source: str, v: str) -> str:
    def step(src: str, f: str, g: str) -> str:
        return (
            f"(select tile_id, y, x, {g}({f}(wide) over (partition by tile_id, x order by y rows between 1 preceding and 1 following),"
            f" lag({v}, 2) {Y}, lead({v}, 2) {Y}) as {v} from (select *, {f}({v}) over (partition by tile_id, y order by x rows between 2 preceding and 2 following) as wide from {src}))"
        )

    return f"{name} as {step(step(source, 'max', 'greatest'), 'min', 'least')}"


def downsample_sql(name: str, source: str, value: str, max_dim: int) -> str:
    axis = lambda at, n, m, out: f"""
  select *, least({at} + 1, ({out} + 1) * st_{at}) - greatest({at}, {out} * st_{at}) as o_{at} from (
    select *, unnest(range(floor({at} / st_{at})::int, least({m} - 1, floor(({at} + 1 - 1e-9) / st_{at})::int) + 1))::int as {out}
    from (select *, {n} / {m}::double as st_{at} from"""  # noqa: E731
    return f"""{name} as (
  select tile_id, "row", col, sum({value} * o_y * o_x) / sum(o_y * o_x) as {value}, any_value(scale) as scale from (
  {axis("x", "w", "nw", "col")} ({axis("y", "h", "nh", '"row"')} (
    select c.*, d.* exclude (tile_id), greatest(1, round_even(w / scale, 0)::int) as nw, greatest(1, round_even(h / scale, 0)::int) as nh
    from {source} c join (select *, case when greatest(h, w) <= {max_dim} then 1 else greatest(h, w) / {max_dim}::double end as scale
      from (select tile_id, max(y) + 1 as h, max(x) + 1 as w from {source} group by tile_id)) d on d.tile_id = c.tile_id))))
  ))) group by all)"""


def _r(df: DataFrame, **places: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in places.items()})


def elevation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).select("tile_id", "y", "x", F.round(hazard.elevation_m("intensity", S), 6).alias("elevation_m"))


def slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(stencil.slope(cells(spark, sf_dir), S), gradient=6, slope_deg=6)


def gaussian_blur(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.gaussian_blur(cells(spark, sf_dir))


def edge_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = stencil.edge_gradient(cells(spark, sf_dir))
    return g.select("tile_id", "y", "x", "gx", "gy", F.sqrt(F.col("m2").cast("double")).alias("magnitude"))


def roughness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(stencil.roughness(cells(spark, sf_dir), S), roughness=9)


def edge_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.edge_nms(cells(spark, sf_dir)).where("ridge").select("tile_id", "y", "x", "m2")


def edge_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(hazard.edge_thresholds(stencil.edge_gradient(cells(spark, sf_dir)), S), low=6, high=6)


def morph_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.morph_close(cells(spark, sf_dir).select("tile_id", "y", "x", (F.col("intensity") > 170).cast("int").alias("edge")))


def downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(stencil.downsample(cells(spark, sf_dir), "intensity", 24), intensity=6, scale=6)


def display_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.slope(cells(spark, sf_dir), S).select("tile_id", "y", "x", hazard.display_level(F.round(F.col("slope_deg"), 6) / 45.0).alias("slope_level"))


QUERIES = {f.__name__: f for f in (elevation, slope, gaussian_blur, edge_gradient, roughness, edge_nms, edge_thresholds, morph_close, downsample, display_levels)}

ORACLE = {
    "elevation": with_ctes(CELLS) + f"select tile_id, y, x, round(intensity / 255.0::double * {S.elevation_range_m}, 6) as elevation_m from cells",
    "slope": with_ctes(CELLS, SLOPE) + "select tile_id, y, x, intensity, round(gradient, 6) as gradient, round(slope_deg, 6) as slope_deg from sloped",
    "gaussian_blur": with_ctes(CELLS, BLUR) + "select * from blur",
    "edge_gradient": with_ctes(CELLS, EDGES) + "select tile_id, y, x, gx, gy, sqrt(m2::double) as magnitude from edges",
    "roughness": with_ctes(CELLS, ROUGH) + "select c.*, round(roughness, 9) as roughness from rough join cells c using (tile_id, y, x)",
    "edge_nms": with_ctes(CELLS, NMS) + "select tile_id, y, x, m2 from nms where ridge",
    "edge_thresholds": with_ctes(CELLS, EDGES, THRESHOLDS) + "select tile_id, round(low, 6) as low, round(high, 6) as high from thresholds",
    "morph_close": with_ctes(CELLS, "marks as (select tile_id, y, x, (intensity > 170)::int as edge from cells)", close_sql("closed", "marks", "edge")) + "select * from closed",
    "downsample": with_ctes(CELLS, downsample_sql("down", "cells", "intensity", 24)) + 'select tile_id, "row", col, round(intensity, 6) as intensity, round(scale, 6) as scale from down',
    "display_levels": with_ctes(CELLS, SLOPE) + "select tile_id, y, x, floor(greatest(0, least(1, round(slope_deg, 6) / 45.0::double)) * 255)::int as slope_level from sloped",
}
