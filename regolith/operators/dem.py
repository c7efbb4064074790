"""Windows of a large elevation model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regolith.settings import DEM_COLUMNS, DEM_METERS_PER_PIXEL, DEM_ROWS, NO_DATA

BLOCK = 64


def lonlat_pixel(requests: DataFrame) -> DataFrame:
    """``requests`` (lon, lat) with column, row on the global raster and reject_reason; out of domain has no pixel."""
    reason = F.when(~F.col("lon").between(-180, 180), "longitude out of range").when(~F.col("lat").between(-90, 90), "latitude out of range")
    pixel = lambda share, n: F.when(reason.isNull(), F.rint(share * n).cast("int"))
    return requests.withColumns({
        "column": pixel((F.col("lon") + 180.0) / 360.0, DEM_COLUMNS), "row": pixel((90.0 - F.col("lat")) / 180.0, DEM_ROWS), "reject_reason": reason,
    })


def offset(pixel: str, size: str, n: int) -> Column:
    """First line of a window around a pixel, kept inside the raster."""
    return F.greatest(F.lit(0), F.least(F.lit(n) - F.col(size), F.col(pixel) - F.floor(F.col(size) / 2).cast("int")))


def write_blocks(dem: DataFrame, folder: str, block: int = BLOCK) -> None:
    """The raster as a table by band of ``block`` rows, sorted by column of blocks: a window reads its bands only, and of
    these the row groups whose columns it meets."""
    placed = dem.withColumns({"by_band": F.expr(f"cast(py as bigint) div {block}"), "bx": F.expr(f"cast(px as bigint) div {block}")})
    placed.repartition("by_band", "bx").sortWithinPartitions("by_band", "bx", "py", "px").write.mode("overwrite").partitionBy("by_band").parquet(folder)


def read_blocks(spark: SparkSession, folder: str, requests: DataFrame, rows: int, columns: int, block: int = BLOCK) -> DataFrame:
    """The stored raster (py, px, elevation_m), only those bands and columns of blocks that a window of ``requests`` meets:
    the numbers of bands and of block columns are gathered, at most raster size / block each."""
    asked = requests.select("size", offset("px", "size", columns).alias("x0"), offset("py", "size", rows).alias("y0"))
    bands = [r[0] for r in asked.select(F.explode(F.expr(f"sequence(y0 div {block}, (y0 + size - 1) div {block})"))).distinct().collect()]
    across = [r[0] for r in asked.select(F.explode(F.expr(f"sequence(x0 div {block}, (x0 + size - 1) div {block})"))).distinct().collect()]
    return spark.read.parquet(folder).where(F.col("by_band").isin(bands) & F.col("bx").isin(across)).select("py", "px", "elevation_m")


#: Windows over one block that meet its cells in one group.
PORTION = 500


def crop(requests: DataFrame, dem: DataFrame, rows: int, columns: int, block: int = BLOCK, portion: int = PORTION) -> DataFrame:
    """(request_id, y, x, elevation_m) of each request's window, no-data as null. The blocks that a window covers are
    listed, so that cells and requests meet by an equi-join on the block, then exactly. The windows over a block are dealt into
    portions, each of which meets a copy of its cells: a popular area is many groups, and an area that none asks for is not read on."""
    asked = requests.select("request_id", "size", offset("px", "size", columns).alias("x0"), offset("py", "size", rows).alias("y0"))
    covered = asked.withColumn("bx", F.explode(F.expr(f"sequence(x0 div {block}, (x0 + size - 1) div {block})"))).withColumn("by", F.explode(F.expr(f"sequence(y0 div {block}, (y0 + size - 1) div {block})")))
    placed = dem.withColumns({"bx": F.expr(f"cast(px as bigint) div {block}"), "by": F.expr(f"cast(py as bigint) div {block}")})
    load = covered.groupBy("bx", "by").agg(F.ceil(F.count("*") / portion).cast("int").alias("portions"))
    covered = covered.join(load, ["bx", "by"]).withColumn("portion", F.pmod(F.xxhash64("request_id"), F.col("portions")).cast("int")).drop("portions")
    placed = placed.join(load, ["bx", "by"]).withColumn("portion", F.explode(F.sequence(F.lit(0), F.col("portions") - 1))).drop("portions")
    met = placed.join(covered, ["bx", "by", "portion"]).where("px between x0 and x0 + size - 1 and py between y0 and y0 + size - 1")
    value = F.when(F.col("elevation_m") > NO_DATA, F.col("elevation_m"))
    return met.select("request_id", (F.col("py") - F.col("y0")).cast("int").alias("y"), (F.col("px") - F.col("x0")).cast("int").alias("x"), value.alias("elevation_m"))


def relief(crops: DataFrame) -> DataFrame:
    """(request_id, low, high, relief, reject_reason) of valid cells; windows without any, and flat ones, are refused."""
    sums = crops.groupBy("request_id").agg(F.min("elevation_m").alias("low"), F.max("elevation_m").alias("high")).withColumn("relief", F.col("high") - F.col("low"))
    return sums.withColumn("reject_reason", F.when(F.col("low").isNull(), "no valid elevation").when(F.col("relief") < 1e-6, "flat window"))


def rescale(crops: DataFrame, ranges: DataFrame) -> DataFrame:
    """(request_id, y, x, intensity) of accepted windows: 0 to 255 over the window's valid range, truncated; no-data is 0."""
    met = crops.join(ranges.where("reject_reason is null"), "request_id")
    share = (F.coalesce("elevation_m", F.col("low")) - F.col("low")) / F.col("relief")
    return met.select("request_id", "y", "x", F.floor(share * 255.0).cast("int").alias("intensity"))


def sidecar(ranges: DataFrame, requests: DataFrame) -> DataFrame:
    """One row of metadata for each accepted window: place, size, coverage and the true range of its elevations."""
    two = lambda c: F.round(F.col(c).cast("double"), 2)
    return ranges.join(requests, "request_id").where("reject_reason is null").select(
        "request_id", "px", "py", F.col("size").alias("tile_size_px"), F.round(F.col("size") * DEM_METERS_PER_PIXEL / 1000, 2).alias("ground_coverage_km"),
        two("low").alias("min_elevation_m"), two("high").alias("max_elevation_m"), two("relief").alias("elevation_range_m"), F.lit(DEM_METERS_PER_PIXEL).alias("meters_per_pixel"),
    )


def write_sidecars(sidecars: DataFrame, folder: str) -> None:
    """The metadata as JSON lines, one folder for each request."""
    sidecars.repartition("request_id").write.mode("overwrite").partitionBy("request_id").json(folder)
