"""PNG media columns.

Texts become 8-bit grey images of 64 pixels a row, stored as PNG: signature, IHDR, IDAT through zlib, IEND, each chunk
with its CRC. Reading tests every checksum, inflates the data and undoes the row filters with numpy, and a low-frequency
cosine-transform hash of the pixels gives a feature that similar images share. PNG bytes live in a binary column.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regolith.functions.lineage import shared_dir
from regolith.llm.common import read

WIDTH = 64
LEVEL = 6
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples of a pixel by PNG colour type (8-bit grey, RGB, grey with alpha, RGB with alpha).
_SAMPLES = {0: 1, 2: 3, 4: 2, 6: 4}
HASH_GRID, HASH_SIDE = 32, 8
#: Bytes of pixels that one image may have: a Parquet value cannot hold more.
MOST_BYTES = 2**31 - 1


class MediaError(ValueError):
    """The bytes are not a PNG that this module reads, or a checksum of them is wrong."""


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def payload(text: str | None) -> bytes:
    """The text's UTF-8 bytes, zeros appended up to a positive multiple of the width; null is empty text."""
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH))


def png(pixels: np.ndarray, level: int = LEVEL) -> bytes:
    """PNG of a (rows, columns) or (rows, columns, samples) array of bytes. One filter serves the whole image: none, left
    or up, whichever leaves the smallest sum of absolute differences (ties: in that order)."""
    rows = pixels.reshape(len(pixels), pixels.shape[1], -1)
    colour = {n: c for c, n in _SAMPLES.items()}[rows.shape[2]]
    left, up = rows.copy(), rows.copy()
    left[:, 1:] -= rows[:, :-1]
    up[1:] -= rows[:-1]
    costs = [int(np.abs(x.view(np.int8).astype(np.int16)).sum()) for x in (rows, left, up)]
    kind = int(np.argmin(costs))
    body = np.empty((len(rows), 1 + rows.shape[1] * rows.shape[2]), np.uint8)
    body[:, 0] = kind
    body[:, 1:] = (rows, left, up)[kind].reshape(len(rows), -1)
    header = struct.pack(">IIBBBBB", rows.shape[1], rows.shape[0], 8, colour, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(body.tobytes(), level)) + _chunk(b"IEND", b"")


def _across(kind: int, lines: np.ndarray, above: np.ndarray, samples: int) -> np.ndarray:
    """Undoes average (3) or Paeth (4) over a run of rows: a pixel needs those to its left, above and between, so all pixels
    of one slanting line (column plus row) are done at once."""
    n, wide = len(lines), lines.shape[1] // samples
    raw = lines.reshape(n, wide, samples).astype(np.int16)
    out = np.zeros((n + 1, wide + 1, samples), np.int16)  # a row above, a column of zeros to the left
    out[0, 1:] = above.reshape(wide, samples)
    for d in range(n + wide - 1):
        r = np.arange(max(0, d - wide + 1), min(n - 1, d) + 1)
        c = d - r
        left, up, corner = out[r + 1, c], out[r, c + 1], out[r, c]
        if kind == 3:
            guess = (left + up) >> 1
        else:
            to_left, to_up, to_corner = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
            guess = np.where((to_left <= to_up) & (to_left <= to_corner), left, np.where(to_up <= to_corner, up, corner))
        out[r + 1, c + 1] = (raw[r, c] + guess) & 255
    return out[1:, 1:].reshape(n, -1).astype(np.uint8)


def unfilter(body: np.ndarray, samples: int) -> np.ndarray:
    """Undoes the filters of (rows, 1 + bytes) filtered lines. Runs of rows with one filter are done together: left is
    a running sum along the row, up one down the column, average and Paeth go by slanting lines."""
    kinds, lines = body[:, 0], body[:, 1:]
    if kinds.size and kinds.max() > 4:
        raise MediaError("unknown filter")
    out = np.zeros((len(lines) + 1, lines.shape[1]), np.uint8)  # row 0: the zeros above the image
    cuts = [0, *(np.flatnonzero(kinds[1:] != kinds[:-1]) + 1).tolist(), len(lines)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if a == b:
            continue
        kind, part = kinds[a], lines[a:b]
        if kind == 0:
            out[a + 1 : b + 1] = part
        elif kind == 1:
            out[a + 1 : b + 1] = np.cumsum(part.reshape(b - a, -1, samples), axis=1, dtype=np.uint8).reshape(b - a, -1)
        elif kind == 2:
            out[a + 1 : b + 1] = np.cumsum(np.vstack([out[a], part]), axis=0, dtype=np.uint8)[1:]
        else:
            out[a + 1 : b + 1] = _across(int(kind), part, out[a], samples)
    return out[1:]


def _inflate(parts: list[bytes], size: int) -> bytes:
    """The ``size`` bytes that the chunks hold; no more than that is ever unpacked."""
    unpack = zlib.decompressobj()
    try:
        raw = unpack.decompress(b"".join(parts), size + 1)
        if len(raw) != size or not unpack.eof and unpack.decompress(unpack.unconsumed_tail, 1):
            raise MediaError("wrong number of bytes")
    except zlib.error as e:
        raise MediaError(str(e)) from e
    if not unpack.eof:
        raise MediaError("the data ends early")
    return raw


def pixels(data: bytes) -> np.ndarray:
    """(rows, columns, samples) of a PNG with 8 bits a sample, not interlaced. Every chunk's CRC and zlib's own checksum
    are tested; anything else (a missing chunk, a wrong length, no pixels, other methods) raises MediaError."""
    if data[:8] != _SIGNATURE:
        raise MediaError("no PNG signature")
    at, header, body, ended = 8, None, [], False
    while at + 12 <= len(data) and not ended:
        length, kind = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + length]
        if len(part) < length or data[at + 8 + length : at + 12 + length] != struct.pack(">I", zlib.crc32(kind + part)):
            raise MediaError(f"wrong checksum or length in {kind!r}")
        if kind == b"IHDR":
            if header is not None or at != 8 or length != 13:
                raise MediaError("wrong header")
            header = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        ended = kind == b"IEND"
        at += 12 + length
    if header is None or not ended:
        raise MediaError("a chunk is missing")
    width, height, depth, colour, packing, filtering, interlaced = header
    if depth != 8 or colour not in _SAMPLES or packing or filtering or interlaced:
        raise MediaError("only 8-bit samples, not interlaced, are read")
    if not 0 < width < 2**31 or not 0 < height < 2**31:
        raise MediaError("no pixels")
    samples = _SAMPLES[colour]
    size = height * (1 + width * samples)
    if size > MOST_BYTES:
        raise MediaError("too large")
    raw = _inflate(body, size)
    lines = np.frombuffer(raw, np.uint8).reshape(height, 1 + width * samples)
    return unfilter(lines, samples).reshape(height, width, samples)


def _shrink(n: int) -> np.ndarray:
    """Weights (HASH_GRID, n) of an area average over n lines."""
    edges = np.linspace(0, n, HASH_GRID + 1)
    low, high = edges[:-1, None], edges[1:, None]
    line = np.arange(n)[None, :]
    return np.clip(np.minimum(high, line + 1) - np.maximum(low, line), 0, None) / (n / HASH_GRID)


_COSINES = np.cos(np.pi * (2 * np.arange(HASH_GRID)[None, :] + 1) * np.arange(HASH_SIDE)[:, None] / (2 * HASH_GRID))
_ACROSS = _shrink(WIDTH)


def feature(image: np.ndarray) -> str:
    """64 bits as hex: signs, against their median, of the lowest 8 x 8 cosine coefficients of the grey image averaged
    to 32 x 32 (the constant one does not count for the median)."""
    grey = image.astype(np.float64).mean(axis=2) if image.ndim == 3 else image.astype(np.float64)
    h, w = grey.shape
    across = _ACROSS if w == WIDTH else _shrink(w)
    narrow = grey @ across.T
    edges = np.linspace(0, h, HASH_GRID + 1)
    sums = np.vstack([np.zeros(HASH_GRID), np.cumsum(narrow, axis=0)])
    whole = np.minimum(edges.astype(np.int64), h)
    upto = sums[whole] + (edges - whole)[:, None] * np.vstack([narrow, narrow[-1:]])[whole]
    small = np.round(np.diff(upto, axis=0) / (h / HASH_GRID), 6)
    low = np.round(_COSINES @ small @ _COSINES.T, 4).ravel()
    bits = low > np.median(low[1:])
    return np.packbits(bits).tobytes().hex()


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): every row's whole text as a PNG; null and empty texts are one row of zeros, a long text has
    as many rows as it needs. Repeated rows keep their rows, equal texts have equal media. An empty table gives no rows.
    Columns other than id and text are not read, so their names cannot clash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            media = [png(np.frombuffer(payload(t), np.uint8).reshape(-1, WIDTH)) for t in texts]
            sizes = [len((t or "").encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string"))
    return chosen.mapInArrow(run, "doc_id long, n_bytes long, media binary")


_READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"


def read_media(stored: DataFrame) -> DataFrame:
    """What the bytes in ``media`` hold: lengths and digests of the pixels and of the file, and the hash feature. Null
    or broken media give a row with ``error`` and no digests of pixels."""

    def one(media: bytes | None) -> tuple:
        if media is None:
            return None, None, None, None, None, None, "null"
        own = len(media), hashlib.sha256(media).hexdigest()
        try:
            image = pixels(media)
        except MediaError as e:
            return None, None, None, *own, None, str(e)
        raw = image.tobytes()
        return len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]), *own, feature(image), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(zip(*map(one, batch.column(2).to_pylist()), strict=True)) or [[]] * 7
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            columns = [batch.column(0), batch.column(1), *(pa.array(x, k) for x, k in zip(found, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _READ.split(", ")])

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, _READ)


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the media column to a table in the shared folder and reads the stored bytes back."""
    folder = f"{shared_dir(spark)}/media-{uuid.uuid4().hex}"
    stored = store_texts(read(spark, sf_dir, "documents", "doc_id", "text"))
    stored.write.option("compression", "none").parquet(folder)
    return read_media(spark.read.schema(stored.schema).parquet(folder)).drop("error")
