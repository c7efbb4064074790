"""Grey rasters from image files, and a screen for uploads."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regolith.settings import IMAGE_SUFFIXES, MAX_UPLOAD_BYTES

_CELLS = "tile_id string, y int, x int, intensity int"


def screen(files: DataFrame) -> DataFrame:
    """``files`` (path, length) with reject_reason by suffix and size."""
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    reason = F.when(~suffix.isin(*IMAGE_SUFFIXES), "unsupported type").when(F.col("length") > MAX_UPLOAD_BYTES, "too large")
    return files.withColumn("reject_reason", reason)


def uploads(spark: SparkSession, folder: str) -> DataFrame:
    """Path, length and reject_reason of the files in a folder; contents are not read."""
    return screen(spark.read.format("binaryFile").load(folder).select("path", "length"))


def read_images(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Cells of all readable images in a folder, tile_id being the file's name, and the paths of the unreadable ones.

    Images have 8 bits a channel: wider ones lose their low byte in Spark's image source (png.read_png keeps it). Colour (stored blue, green, red) becomes grey by 0.299 R + 0.587 G + 0.114 B, rounded."""
    images = spark.read.format("image").option("dropInvalid", False).load(folder).select("image.*")
    rejects = images.where("height < 1").select(F.col("origin").alias("path"), F.lit("unreadable image").alias("reason"))
    name = F.element_at(F.split("origin", "/"), -1)
    good = images.where("height >= 1").select(name.alias("tile_id"), "height", "width", "nChannels", "data")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tile, h, w, channels, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pixels = np.frombuffer(data, np.uint8).reshape(h, w, channels)
                if channels == 1:
                    grey = pixels[:, :, 0]
                else:
                    grey = np.rint(pixels[:, :, :3].astype(float) @ np.array([0.114, 0.587, 0.299]))
                y, x = np.indices((h, w), np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(pa.scalar(tile), h * w), pa.array(y.ravel()), pa.array(x.ravel()), pa.array(grey.ravel().astype(np.int32))], ["tile_id", "y", "x", "intensity"]
                )

    return good.mapInArrow(unpack, _CELLS), rejects
