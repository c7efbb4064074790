"""Grey rasters out of PNG files of 8 and 16 bits, for batch and streams.

Spark's image source keeps only the high byte of wide samples; here files come through its binary reader, from any store, and are
decoded where they are read. Files that cannot be read are rows with a reason.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELLS = "path string, tile_id string, y int, x int, intensity int, reason string"
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples of a pixel by colour type; indexed colour (3) is not a measurement and is refused.
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
#: Pixels of an image at most, and cells that are handed on together.
MOST_PIXELS, BATCH_CELLS = 2**28, 500_000


def _chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = len(SIGNATURE)
    while at + 12 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if len(body) < size or data[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(kind + body)):
            raise ValueError("damaged chunk")
        yield kind, body
        at += 12 + size
    raise ValueError("no end")


def _unfiltered(raw: np.ndarray, step: int) -> np.ndarray:
    """Rows of samples' bytes out of rows that begin with their filter; ``step`` bytes make a pixel."""
    out = np.zeros((raw.shape[0] + 1, raw.shape[1] - 1 + step), np.uint8)  # with a row and a pixel of zeros before
    for y, row in enumerate(raw, 1):
        kind, line, up = row[0], row[1:], out[y - 1, step:]
        now = out[y, step:]
        if kind == 0:
            now[:] = line
        elif kind == 1:
            now[:] = np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            now[:] = line + up
        elif kind in (3, 4):
            left, line, above = [0] * step, line.tolist(), out[y - 1].tolist()
            done = left[:]
            for i, value in enumerate(line):
                a, b, c = done[i], above[i + step], above[i]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    pa_, pb, pc = abs(p - a), abs(p - b), abs(p - c)
                    guess = a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c
                done.append((value + guess) & 255)
            now[:] = done[step:]
        else:
            raise ValueError("unknown filter")
    return out[1:, step:]


def decode(data: bytes) -> np.ndarray:
    """Intensities of a PNG: grey as it is, of 8 or 16 bits; colour by 0.299 R + 0.587 G + 0.114 B, rounded. Raises ValueError
    for what is no such image, damaged, interlaced or indexed."""
    if not data.startswith(SIGNATURE):
        raise ValueError("no PNG")
    head, body = None, []
    for kind, part in _chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part) if len(part) == 13 else None
        elif kind == b"IDAT":
            body.append(part)
        elif kind == b"IEND":
            break
    if head is None:
        raise ValueError("no header")
    width, height, bits, colour, packing, filters, interlaced = head
    if bits not in (8, 16) or colour not in CHANNELS or packing or filters or interlaced or not 0 < width * height <= MOST_PIXELS:
        raise ValueError("unsupported image")
    step = CHANNELS[colour] * bits // 8
    want = height * (width * step + 1)
    unpacker = zlib.decompressobj()
    try:
        raw = unpacker.decompress(b"".join(body), want)
    except zlib.error as broken:
        raise ValueError("damaged data") from broken
    if len(raw) != want:
        raise ValueError("too little data")
    samples = _unfiltered(np.frombuffer(raw, np.uint8).reshape(height, -1), step).copy().view(">u2" if bits == 16 else np.uint8).reshape(height, width, CHANNELS[colour])
    if CHANNELS[colour] < 3:
        return samples[:, :, 0].astype(np.int32)
    return np.rint(samples[:, :, :3].astype(float) @ np.array([0.299, 0.587, 0.114])).astype(np.int32)


def cells_of(path: str, data: bytes) -> Iterator[pa.RecordBatch]:
    """Rows of CELLS of one file, some at a time: its cells without a path, or its path and why it has none."""
    names = [f.split()[0] for f in CELLS.split(", ")]
    tile = os.path.basename(path)
    kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string())
    try:
        grey = decode(data)
    except ValueError as why:
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((path, tile, None, None, None, str(why)), kinds, strict=True)], names)
        return
    wide = grey.shape[1]
    for a in range(0, grey.shape[0], max(1, BATCH_CELLS // wide)):
        part = grey[a : a + max(1, BATCH_CELLS // wide)]
        y, x = np.indices(part.shape, np.int32)
        columns = (y + np.int32(a)).ravel(), x.ravel(), part.ravel()
        yield pa.RecordBatch.from_arrays([pa.nulls(part.size, pa.string()), pa.repeat(pa.scalar(tile), part.size), *map(pa.array, columns), pa.nulls(part.size, pa.string())], names)


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, data in zip(batch.column("path"), batch.column("content"), strict=True):
            yield from cells_of(path.as_py(), data.as_py())


def read_png(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(tile_id, y, x, intensity) of the PNG files in a folder of any store, and (path, reason) of those that cannot be read. Spark
    does not list files without a byte."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(folder).select("path", "content").mapInArrow(_unpack, CELLS)
    return found.where("reason is null").select("tile_id", "y", "x", "intensity"), found.where("reason is not null").select("path", "reason")


def follow_png(spark: SparkSession, folder: str) -> DataFrame:
    """Cells of PNG files as they arrive, for ingest_tiles: (tile_id, y, x, intensity, arrived_at), by the file's time. Files that cannot
    be read give none."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.png").load(folder)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, when, data in zip(batch.column("path"), batch.column("modificationTime"), batch.column("content"), strict=True):
                for cells in cells_of(path.as_py(), data.as_py()):
                    yield cells.append_column("arrived_at", pa.repeat(when, len(cells)))

    found = files.select("path", "modificationTime", "content").mapInArrow(unpack, CELLS + ", arrived_at timestamp")
    return found.where("reason is null").select("tile_id", "y", "x", "intensity", F.col("arrived_at"))
