import math
import hashlib
import struct
import zlib

import numpy as np
import pytest

from regolith.llm import media

TEXTS = ["", None, "x", "y" * 64, "z" * 65, "tête " * 3000, "\x00", "abc\n" * 16, "x"]


def reference_unfilter(kinds, lines, samples):
    out = []
    for kind, line in zip(kinds, lines):
        above, now = out[-1] if out else [0] * len(line), []
        for i, x in enumerate(line):
            a, b, c = (now[i - samples] if i >= samples else 0), above[i], (above[i - samples] if i >= samples else 0)
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            now.append((x + [0, a, b, (a + b) // 2, near][kind]) % 256)
        out.append(now)
    return out


@pytest.mark.parametrize("samples", [1, 3, 4])
def test_unfilter_all_five(samples):
    rng = np.random.default_rng(samples)
    body = rng.integers(0, 256, (40, 1 + 6 * samples), dtype=np.uint8)
    body[:, 0] = np.sort(rng.integers(0, 5, 40)) if samples == 3 else rng.integers(0, 5, 40)
    assert media.unfilter(body, samples).tolist() == reference_unfilter(body[:, 0].tolist(), body[:, 1:].tolist(), samples)


@pytest.mark.parametrize("shape", [(1, 64), (5, 7, 3), (9, 2, 4), (64, 64), (30, 1, 2)])
def test_png_round_trip(shape):
    rng = np.random.default_rng(1)
    for image in (rng.integers(0, 256, shape, dtype=np.uint8), np.zeros(shape, np.uint8), np.arange(np.prod(shape), dtype=np.uint8).reshape(shape)):
        assert media.pixels(media.png(image)).reshape(shape).tolist() == image.tolist()


def test_broken_files_are_told():
    good = media.png(np.arange(128, dtype=np.uint8).reshape(2, 64))
    for bad in (b"", b"GIF89a", good[:-1], good[:20], good[:45] + b"\xff" + good[46:], good.replace(b"IDAT", b"IDAX")):
        with pytest.raises(media.MediaError):
            media.pixels(bad)
    deep = good[:16] + struct.pack(">IIBBBBB", 64, 2, 16, 0, 0, 0, 0)
    with pytest.raises(media.MediaError):
        media.pixels(deep + struct.pack(">I", zlib.crc32(deep[12:])) + good[33:])


def test_feature_follows_the_image():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 256, (50, 64)).astype(np.uint8)
    near = np.clip(base.astype(int) + rng.integers(-2, 3, base.shape), 0, 255).astype(np.uint8)
    other = rng.integers(0, 256, (50, 64)).astype(np.uint8)
    differ = lambda a, b: bin(int(media.feature(a), 16) ^ int(media.feature(b), 16)).count("1")
    assert differ(base, near) <= 8 < differ(base, other)
    assert len(media.feature(np.zeros((1, 64), np.uint8))) == 16


def test_texts_through_the_column(spark):
    rows = [(i, t, "m") for i, t in enumerate(TEXTS)] + [(None, "no id", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, media string")
    got = {r.doc_id: r for r in media.read_media(media.store_texts(df)).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        raw = (t or "").encode()
        held = raw + bytes((-len(raw) % 64) or (64 if not raw else 0))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.error) == (len(raw), len(held), hashlib.sha256(held).hexdigest(), zlib.crc32(held[-64:]), None)
    same = [(r.media_sha256, r.feature, r.media_bytes) for r in (got[2], got[8])]
    assert same[0] == same[1]
    assert media.read_media(media.store_texts(df.limit(0))).count() == 0


def test_null_and_broken_media_have_rows(spark):
    df = spark.createDataFrame([(1, 2, None), (2, 3, b"junk")], "doc_id long, n_bytes long, media binary")
    got = {r.doc_id: (r.payload_bytes, r.media_bytes, r.error is not None) for r in media.read_media(df).collect()}
    assert got == {1: (None, None, True), 2: (None, 4, True)}


def chunk(kind, data):
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def image(header, raw=b"\0ab", kinds=(b"IHDR", b"IDAT", b"IEND")):
    parts = {b"IHDR": header, b"IDAT": zlib.compress(raw), b"IEND": b""}
    return b"\x89PNG\r\n\x1a\n" + b"".join(chunk(k, parts[k]) for k in kinds)


def test_broken_headers_are_errors_of_their_row(spark):
    head = lambda *x: struct.pack(">IIBBBBB", *x)
    sound = image(head(2, 1, 8, 0, 0, 0, 0))
    assert media.pixels(sound).tolist() == [[[97], [98]]]
    broken = [
        image(head(2, 1, 8, 0, 0, 0, 0)[:12]), image(head(0, 1, 8, 0, 0, 0, 0)), image(head(2, 0, 8, 0, 0, 0, 0)), image(head(2, 1, 8, 0, 1, 0, 0)), image(head(2, 1, 8, 0, 0, 3, 0)), image(head(2**31, 2**31 - 1, 8, 0, 0, 0, 0)),
        image(head(2, 1, 8, 0, 0, 0, 0), b"\0ab" * 1000), image(head(2, 2, 8, 0, 0, 0, 0)), image(head(2, 1, 8, 0, 0, 0, 0), kinds=(b"IHDR", b"IHDR", b"IDAT", b"IEND")), image(head(2, 1, 8, 0, 0, 0, 0), kinds=(b"IDAT", b"IHDR", b"IEND")),
        image(head(2, 1, 8, 0, 0, 0, 0), b"\5ab"), image(head(2, 1, 8, 0, 0, 0, 0), kinds=(b"IHDR", b"IEND")), sound[:-1], b"", None,
    ]
    for data in broken[:-1]:
        with pytest.raises(media.MediaError):
            media.pixels(data)
    df = spark.createDataFrame([(i, 1, d) for i, d in enumerate([*broken, sound])], "doc_id long, n_bytes long, media binary")
    got = {r.doc_id: r for r in media.read_media(df).collect()}
    assert all(got[i].error and got[i].payload_sha256 is None for i in range(len(broken))) and got[len(broken)].error is None


def test_rows_that_repeat_and_columns_that_clash(spark):
    rows = [(1, "same", "x"), (1, "same", "y"), (2, "same", "z"), (3, None, None), (4, "", None), (5, "long " * 60_000, None)]
    got = media.store_texts(spark.createDataFrame(rows, "doc_id long, text string, media string")).collect()
    assert len(got) == 6 and len({bytes(r.media) for r in got if r.doc_id < 3}) == 1 and {r.n_bytes for r in got if r.doc_id in (3, 4)} == {0}
    assert media.pixels(bytes(max(got, key=lambda r: r.n_bytes).media)).tobytes().rstrip(b"\0") == b"long " * 60_000
    assert media.read_media(media.store_texts(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def plain_feature(image):
    """The hash by its definition: area averages, cosine sums, signs against the median."""
    h, w = image.shape
    weight = lambda n, k: [max(0.0, min((k + 1) * n / 32, i + 1) - max(k * n / 32, i)) / (n / 32) for i in range(n)]
    small = [[sum(a * b * float(image[y, x]) for y, a in enumerate(weight(h, r)) if a for x, b in enumerate(weight(w, c)) if b) for c in range(32)] for r in range(32)]
    low = [round(sum(small[y][x] * math.cos(math.pi * (2 * y + 1) * u / 64) * math.cos(math.pi * (2 * x + 1) * v / 64) for y in range(32) for x in range(32)), 4) for u in range(8) for v in range(8)]
    middle = sorted(low[1:])[31]
    return "".join("1" if x > middle else "0" for x in low)


def test_feature_as_its_definition():
    rng = np.random.default_rng(1)
    for h in (3, 32, 50):
        picture = rng.integers(0, 256, (h, 64), dtype=np.uint8)
        assert f"{int(media.feature(picture), 16):064b}" == plain_feature(picture)
