"""Streaming jobs: tiles that arrive are analysed and upserted; mission status follows its events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from regolith.operators.analysis import analyse
from regolith.settings import DEFAULT, Settings
from regolith.sources.png import follow_png
from regolith.sources.store import merge_latest
from regolith.sources.tables import status_events

CELLS = "tile_id string, y int, x int, intensity int, arrived_at timestamp"


def tile_rows(cells: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """The whole analysis of each tile in a batch of whole tiles, one row for each: statistics, obstacles, hazard, class and the
    evidence for it. Of a tile that came twice the later cells count; of equal times, cell by cell, the greater ones."""
    last = cells.groupBy("tile_id").agg(F.max("arrived_at").alias("arrived_at"))
    now = cells.join(last, ["tile_id", "arrived_at"]).groupBy("tile_id", "y", "x").agg(F.max("intensity").alias("intensity"))
    rows = analyse(now, settings).rows
    size = now.groupBy("tile_id").agg(F.count("*").alias("cells"))
    return rows.join(size, "tile_id").join(last.withColumnRenamed("arrived_at", "analyzed_at"), "tile_id")


def ingest_tiles(spark: SparkSession, arrivals: str, table: str, checkpoint: str, settings: Settings = DEFAULT) -> StreamingQuery:
    """Analyses the tile files (Parquet of CELLS) that are there and ends; a rerun takes only new ones, and a batch that is repeated
    after a failure leaves the table as it was."""
    return analyse_stream(spark.readStream.schema(CELLS).parquet(arrivals), table, checkpoint, settings)


def ingest_images(spark: SparkSession, folder: str, table: str, checkpoint: str, settings: Settings = DEFAULT) -> StreamingQuery:
    """The same for PNG files in a folder, each one tile."""
    return analyse_stream(follow_png(spark, folder), table, checkpoint, settings)


def analyse_stream(stream: DataFrame, table: str, checkpoint: str, settings: Settings = DEFAULT) -> StreamingQuery:
    """Upserts the analysis of each tile of a stream of CELLS into ``table``."""

    def upsert(batch: DataFrame, _: int) -> None:
        if batch.limit(1).count():
            merge_latest(tile_rows(batch, settings), table, "tile_id", "analyzed_at")

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follow_status(spark: SparkSession, events: str, schema, table: str, checkpoint: str, per_trigger: int = 1000) -> StreamingQuery:
    """Keeps the latest status of each mission: the state holds one row for each, changed rows are upserted."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(events)
    last = status_events(stream).groupBy("mission_id").agg(F.max(F.struct("ts", "event_id", "status")).alias("last"))
    rows = last.select("mission_id", F.col("last.status").alias("status"), F.col("last.ts").alias("ts"))

    def upsert(batch: DataFrame, _: int) -> None:
        merge_latest(batch, table, "mission_id", "ts")

    return rows.writeStream.outputMode("update").foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
