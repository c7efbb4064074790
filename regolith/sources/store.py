"""Tables that are kept: planning grids by bucket, and latest-wins tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regolith.operators.paths import latest


def write_grids(grids: DataFrame, folder: str, buckets: int = 64) -> None:
    """Grids under bucket=...; a bucket that is written again replaces only itself."""
    bucket = F.pmod(F.hash("tile_id"), F.lit(buckets))
    grids.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(folder)


def read_grids(spark: SparkSession, folder: str, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Grids of the requests' tiles, and the requests without one."""
    stored = spark.read.parquet(folder).drop("bucket")
    wanted = requests.select("tile_id").distinct()
    return stored.join(wanted, "tile_id", "left_semi"), requests.join(stored.select("tile_id").distinct(), "tile_id", "left_anti").withColumn("reason", F.lit("no planning grid"))


def merge_latest(new: DataFrame, folder: str, key: str, order: str, buckets: int = 16) -> None:
    """Upserts ``new`` into the table in ``folder``: only buckets that new rows fall into are read and written again, and
    writing the same rows twice changes nothing. The merged rows are written beside the table before they replace it; a run
    that failed between buckets is mended by running it again."""
    spark = new.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    rows = new.withColumn("bucket", F.pmod(F.hash(key), F.lit(buckets)))
    if fs.exists(path):
        touched = [r.bucket for r in rows.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        old = spark.read.parquet(folder).where(F.col("bucket").isin(touched)).withColumn("_new", F.lit(0))
        rows = old.unionByName(rows.withColumn("_new", F.lit(1))).select(*rows.columns, "_new")
    else:
        rows = rows.withColumn("_new", F.lit(1))
    merged = latest(rows, key, F.desc(order), F.desc("_new")).drop("_new")
    aside = f"{folder}__next-{uuid.uuid4().hex}"  # of this run alone
    merged.write.partitionBy("bucket").parquet(aside)
    spark.read.parquet(aside).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(folder)
    fs.delete(spark._jvm.org.apache.hadoop.fs.Path(aside), True)
