"""What several corpus operators share: tables, sorted groups, blocks of hot groups, the rows that models learn from."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch handed to Python at most: long documents then stay far from a worker's memory.
BATCH_ROWS, BATCH_BYTES = 1000, 8_000_000


def small_batches(spark: SparkSession) -> None:
    """Bounds the batches that go to Python. Spark has this by session only, and reads it when a result is asked for, so
    the session keeps it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of one table, for batches of bounded size."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def sorted_groups(frames: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Groups of equal ``key`` from batches that are sorted by it; a group may run over several batches."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        values = frame[key].to_numpy()
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if held and last != values[a]:
                yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
                held = []
            last = values[a]
            held.append(frame.iloc[a:b])
    if held:
        yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]


def in_groups(df: DataFrame, key: str, each: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``each`` applied to every group of ``key``; groups are bounded by the caller. Cheaper for many small groups than
    one call per group. The partitions are as many as shuffles have, since the work of a group is more than its bytes tell."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting, rows = [], 0
        for group in sorted_groups(frames, key):
            out = each(group)
            if len(out):
                waiting.append(out)
                rows += len(out)
            if rows >= 20_000:
                yield pd.concat(waiting, ignore_index=True)
                waiting, rows = [], 0
        if waiting:
            yield pd.concat(waiting, ignore_index=True)

    spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(spread, F.col(key)).sortWithinPartitions(key).mapInPandas(run, schema)


def in_runs(df: DataFrame, key: str, each: Callable[[pd.DataFrame], pd.DataFrame], schema: str, rows: int = 20_000) -> DataFrame:
    """``each`` applied to frames of about ``rows`` rows that hold whole groups of ``key``, sorted by it: for groups so small that a
    call for each costs more than its work. Groups are bounded by the caller."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for frame in frames:
            held.append(frame)
            size += len(frame)
            if size >= rows:
                whole = pd.concat(held, ignore_index=True)
                last = int(np.searchsorted(whole[key].to_numpy(), whole[key].iloc[-1]))  # the last group may go on
                if last:
                    yield each(whole.iloc[:last].reset_index(drop=True))
                held = [whole.iloc[last:]]
                size = len(held[0])
        if size:
            yield each(pd.concat(held, ignore_index=True))

    spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(spread, F.col(key)).sortWithinPartitions(key).mapInPandas(run, schema)


def in_blocks(df: DataFrame, key: str, size: str, member: str, block_rows: int) -> DataFrame:
    """Deal each group of ``key`` (with its row count in ``size``) into blocks of about ``block_rows`` rows and list all
    pairs of blocks, so that any two rows of the group meet in exactly one pair and no task holds the whole group.
    Adds ``pair`` (names the group and the two blocks), ``block`` (the row's own) and ``mixed`` (two different blocks)."""
    blocks = F.ceil(F.col(size) / F.lit(block_rows)).cast("int")
    own = F.pmod(F.xxhash64(F.lit(7), F.col(member)), blocks).cast("int")
    return (
        df.withColumn("block", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumn("pair", F.xxhash64(key, F.least("block", "other"), F.greatest("block", "other")))
        .withColumn("mixed", F.col("block") != F.col("other"))
        .drop("other")
    )


def roots(links: np.ndarray) -> np.ndarray:
    """For a symmetric boolean matrix: each row's smallest reachable row."""
    n = len(links)
    root = np.full(n, -1)
    for i in range(n):
        if root[i] < 0:
            front = np.array([i])
            root[i] = i
            while len(front):
                front = np.flatnonzero(links[front].any(axis=0) & (root < 0))
                root[front] = i
    return root


def held_out(id_col: str) -> F.Column:
    """Rows that models never learn from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
