import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from regolith.operators import dem as dm
from regolith.sources import database, images, png as pngs, store
from regolith.streaming import jobs


def png(pixels):
    h, w, n = pixels.shape
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    raw = b"".join(b"\0" + row.tobytes() for row in pixels)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2}[n], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_images(spark, tmp_path):
    rng = np.random.default_rng(0)
    grey, colour = rng.integers(0, 256, (5, 7, 1), dtype=np.uint8), rng.integers(0, 256, (4, 3, 3), dtype=np.uint8)
    for name, data in (("grey.png", png(grey)), ("colour.png", png(colour)), ("broken.png", b"nothing"), ("tool.exe", b"MZ")):
        (tmp_path / name).write_bytes(data)
    cells, rejects = images.read_images(spark, str(tmp_path))
    got = {(r.tile_id, r.y, r.x): r.intensity for r in cells.collect()}
    want = np.rint(colour.astype(float) @ [0.299, 0.587, 0.114])
    assert len(got) == 35 + 12
    assert all(got["grey.png", y, x] == grey[y, x, 0] for y in range(5) for x in range(7))
    assert all(abs(got["colour.png", y, x] - want[y, x]) <= 1 for y in range(4) for x in range(3))
    assert {r.path.rsplit("/")[-1] for r in rejects.collect()} == {"broken.png", "tool.exe"}
    screened = {r.path.rsplit("/")[-1]: r.reject_reason for r in images.uploads(spark, str(tmp_path)).collect()}
    assert screened["tool.exe"] == "unsupported type" and screened["grey.png"] is None


def test_grids_are_kept_by_bucket(spark, tmp_path):
    grids = spark.createDataFrame([(f"t{i}", 0, 0, 0.5) for i in range(6)], "tile_id string, row int, col int, hazard double")
    store.write_grids(grids, str(tmp_path / "g"), 4)
    store.write_grids(grids.where("tile_id = 't1'").withColumn("hazard", F.lit(0.9)), str(tmp_path / "one"), 4)
    asked = spark.createDataFrame([(1, "t1"), (2, "t9")], "plan_id int, tile_id string")
    got, missing = store.read_grids(spark, str(tmp_path / "g"), asked)
    assert [r.tile_id for r in got.collect()] == ["t1"] and [(r.plan_id, r.reason) for r in missing.collect()] == [(2, "no planning grid")]


def test_tiles_are_ingested_once(spark, tmp_path):
    tile = lambda name, level, at: spark.createDataFrame([(name, y, x, level * x, at) for y in range(4) for x in range(5)], "tile_id string, y int, x int, intensity int, at string").select("tile_id", "y", "x", "intensity", F.to_timestamp("at").alias("arrived_at"))
    come, table, check = (str(tmp_path / n) for n in ("in", "table", "check"))
    seen = lambda: {r.tile_id: (r.cells, r.max_slope_deg) for r in spark.read.parquet(table).collect()}
    wanted = {"terrain_class", "obstacles", "packed", "mean_hazard", "p95_hazard", "mean_roughness", "evidence", "analyzed_at"}
    tile("a", 0, "2024-01-01").unionByName(tile("b", 9, "2024-01-01")).coalesce(1).write.mode("append").parquet(come)
    jobs.ingest_tiles(spark, come, table, check).awaitTermination(120)
    first = seen()
    assert first["a"] == (20, 0.0) and first["b"][1] > 0 and wanted <= set(spark.read.parquet(table).columns)
    tile("a", 20, "2024-01-02").coalesce(1).write.mode("append").parquet(come)
    for _ in range(2):
        jobs.ingest_tiles(spark, come, table, check).awaitTermination(120)
    assert seen()["a"][1] > first["b"][1] and seen()["b"] == first["b"] and len(seen()) == 2


def test_status_follows_the_last_event(spark, tmp_path):
    schema = "event_id long, ts timestamp, user_id long, event_type string"
    rows = [(1, 10, 5, "error"), (2, 20, 5, "view"), (3, 5, 6, "signup"), (4, 5, 6, "click")]
    for k, some in enumerate((rows[:2], rows[2:], [(9, 15, 5, "purchase")])):
        spark.createDataFrame(some, "event_id long, t long, user_id long, event_type string").select("event_id", F.timestamp_seconds("t").alias("ts"), "user_id", "event_type").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        jobs.follow_status(spark, str(tmp_path / "in"), schema, str(tmp_path / "t"), str(tmp_path / "c"), 1).awaitTermination(120)
    assert {r.mission_id: r.status for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {5: "ANALYZED", 6: "PATH_PLANNED"}


def test_dem_windows(spark):
    rng = np.random.default_rng(1)
    z = rng.integers(0, 50, (40, 90)) * 10
    z[5, 7] = -200000
    dem = spark.createDataFrame([(y, x, int(z[y, x])) for y in range(40) for x in range(90)], "py int, px int, elevation_m int")
    asked = spark.createDataFrame([(1, 8, 6, 16), (2, 89, 39, 20), (3, 45, 20, 1)], "request_id int, px int, py int, size int")
    for block in (64, 10):
        got = {(r.request_id, r.y, r.x): r.elevation_m for r in dm.crop(asked, dem, 40, 90, block).collect()}
        assert len(got) == 16 * 16 + 20 * 20 + 1 and got[1, 5, 7] is None
        assert all(v == z[y, x] for (i, y, x), v in got.items() if i == 1 and v is not None)
        assert all(v == z[20 + y, 70 + x] for (i, y, x), v in got.items() if i == 2)
    crops = dm.crop(asked, dem, 40, 90)
    why = {r.request_id: r.reject_reason for r in dm.relief(crops).collect()}
    assert why == {1: None, 2: None, 3: "flat window"}
    levels = dm.rescale(crops, dm.relief(crops))
    assert levels.where("request_id = 1 and y = 5 and x = 7").first().intensity == 0 and levels.agg(F.max("intensity")).first()[0] == 255


def test_dem_bands_are_pruned(spark, tmp_path):
    dem = spark.createDataFrame([(y, x, 1000 * y + x) for y in range(40) for x in range(50)], "py int, px int, elevation_m int")
    asked = spark.createDataFrame([(1, 8, 12, 4), (2, 30, 14, 4)], "request_id int, px int, py int, size int")
    dm.write_blocks(dem, str(tmp_path / "d"), 10)
    stored = dm.read_blocks(spark, str(tmp_path / "d"), asked, 40, 50, 10)
    assert stored.select(F.min("py"), F.max("py")).first()[:] == (10, 19)
    plan = stored._jdf.queryExecution().toString()
    assert "by_band" in plan[plan.index("PartitionFilters: [") :].split("]")[0]
    one, other = (sorted(map(tuple, dm.crop(asked, d, 40, 50, 10).collect())) for d in (dem, stored))
    assert one == other and len(one) == 32
    sides = dm.sidecar(dm.relief(dm.crop(asked, stored, 40, 50, 10)), asked)
    dm.write_sidecars(sides, str(tmp_path / "s"))
    assert {(r.request_id, r.tile_size_px, r.elevation_range_m) for r in spark.read.json(str(tmp_path / "s")).collect()} == {(1, 4, 3003.0), (2, 4, 3003.0)}


def test_lonlat(spark):
    df = spark.createDataFrame([(-180.0, 90.0), (180.0, -90.0), (0.0, 0.0), (181.0, 0.0), (0.0, -91.0)], "lon double, lat double")
    got = [(r.column, r.row, r.reject_reason) for r in dm.lonlat_pixel(df).collect()]
    assert got == [(0, 0, None), (106694, 53347, None), (53347, 26674, None), (None, None, "longitude out of range"), (None, None, "latitude out of range")]


def deep_png(samples, bits=16, filters=None, colour=None):
    """PNG of (h, w, channels) samples, each row with the filter told."""
    h, w, n = samples.shape
    raw = samples.astype(">u2" if bits == 16 else np.uint8).tobytes()
    step, wide = n * bits // 8, w * n * bits // 8
    lines = [bytes(wide), *(raw[i * wide : (i + 1) * wide] for i in range(h))]
    out = b""
    for y in range(1, h + 1):
        kind = (filters or [0])[(y - 1) % len(filters or [0])]
        line, up = lines[y], lines[y - 1]
        coded = []
        for i, v in enumerate(line):
            a, b, c = (line[i - step] if i >= step else 0), up[i], (up[i - step] if i >= step else 0)
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            coded.append((v - (0, a, b, (a + b) // 2, paeth)[kind]) & 255)
        out += bytes([kind]) + bytes(coded)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    kind = {1: 0, 2: 4, 3: 2, 4: 6}[n] if colour is None else colour
    body = zlib.compress(out)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, bits, kind, 0, 0, 0)) + chunk(b"IDAT", body[:7]) + chunk(b"IDAT", body[7:]) + chunk(b"IEND", b"")


def test_wide_samples_keep_their_low_byte(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pngs, "BATCH_CELLS", 10)
    rng = np.random.default_rng(1)
    deep, colour, alpha = rng.integers(0, 65536, (9, 7, 1)), rng.integers(0, 65536, (5, 4, 3)), rng.integers(0, 256, (6, 3, 2))
    files = {"deep.png": deep_png(deep, filters=[0, 1, 2, 3, 4]), "colour.png": deep_png(colour, filters=[4, 3]), "alpha.png": deep_png(alpha, 8, [1, 4])}
    good = files["deep.png"]
    files |= {"cut.png": good[:-30], "flipped.png": good[:60] + bytes([good[60] ^ 1]) + good[61:], "none.png": b"\0", "endless.png": good[:-12], "indexed.png": deep_png(deep % 256, 8, colour=3), "skip.txt": b"x"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    cells, rejects = pngs.read_png(spark, str(tmp_path))
    got = {(r.tile_id, r.y, r.x): r.intensity for r in cells.collect()}
    want = {("deep.png", y, x): int(deep[y, x, 0]) for y in range(9) for x in range(7)}
    want |= {("colour.png", y, x): round(float(colour[y, x] @ np.array([0.299, 0.587, 0.114]))) for y in range(5) for x in range(4)}
    want |= {("alpha.png", y, x): int(alpha[y, x, 0]) for y in range(6) for x in range(3)}
    assert got == want
    assert {r.path.rsplit("/")[-1]: r.reason for r in rejects.collect()} == {"cut.png": "damaged chunk", "endless.png": "no end", "flipped.png": "damaged chunk", "none.png": "no PNG", "indexed.png": "unsupported image"}


def test_images_are_analysed_as_they_arrive(spark, tmp_path):
    come, table, check = (str(tmp_path / n) for n in ("in", "table", "check"))
    (tmp_path / "in").mkdir()
    hill = np.minimum(255, np.indices((12, 15)).sum(0) * 9)[:, :, None]
    (tmp_path / "in" / "hill.png").write_bytes(deep_png(hill, 8))
    (tmp_path / "in" / "bad.png").write_bytes(b"no")
    for _ in range(2):
        jobs.ingest_images(spark, come, table, check).awaitTermination(120)
    rows = spark.read.parquet(table).collect()
    assert [(r.tile_id, r.cells) for r in rows] == [("hill.png", 180)] and rows[0].max_slope_deg > 0


def test_database_tables(spark):
    """Spark's own embedded database."""
    db = database.Database("jdbc:derby:memory:regolith;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}, 3, "name varchar(40)")
    rows = spark.createDataFrame([(i, f"m{i}", i * 1.5, 1) for i in range(20)], "mission_id long, name string, score double, at_ long")
    db.write(rows, "missions")
    back = db.read(spark, "missions", "mission_id", 4)
    assert back.rdd.getNumPartitions() == 4 and sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    asked = back.where("mission_id = 7").select("name")
    assert "PushedFilters: [*IsNotNull(mission_id), *EqualTo(mission_id,7)]" in asked._jdf.queryExecution().toString().replace("MISSION_ID", "mission_id")
    assert [r.name for r in asked.collect()] == ["m7"]
    new = spark.createDataFrame([(7, "late", 1.0, 0), (8, "new", 2.0, 1), (8, "older", 9.0, 0), (99, "first", 3.0, 5), (None, "lost", 0.0, 9)], rows.schema)
    for _ in range(2):
        db.merge_latest(new, "missions", "mission_id", "at_")
    after = {r.mission_id: (r.name, r.score) for r in db.read(spark, "missions").collect()}
    assert len(after) == 21 and after[7] == ("m7", 10.5) and after[8] == ("new", 2.0) and after[99] == ("first", 3.0)
    db.write(rows.limit(0), "nothing")
    assert db.read(spark, "nothing", "mission_id").count() == 0


def test_a_popular_area_is_many_groups(spark):
    dem = spark.range(128 * 128).selectExpr("cast(id div 128 as int) as py", "cast(id % 128 as int) as px", "cast(id % 1000 as int) as elevation_m")
    asked = spark.range(100_000).selectExpr("id as request_id", "cast(34 + id % 5 as int) as px", "cast(40 as int) as py", "3 as size")
    crops = dm.crop(asked, dem, 128, 128, portion=1000)
    assert crops.count() == 900_000
    some = {(r.request_id, r.y, r.x): r.elevation_m for r in crops.where("request_id in (0, 99999)").collect()}
    assert some == {(i, y, x): ((39 + y) * 128 + 33 + i % 5 + x) % 1000 for i in (0, 99_999) for y in range(3) for x in range(3)}
    groups = dm.crop(asked, dem, 128, 128, portion=1000)._jdf.queryExecution().optimizedPlan().toString()
    assert "portion" in groups
