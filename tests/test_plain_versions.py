"""Operators without SQL, against plain versions."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from mosaiq import catalogue_probes as probes_of
from mosaiq.operators import delivery, geometry, layout
from mosaiq.sources import rigs, tiles


def test_correlation_of_stacks_finds_shifts():
    rng = np.random.default_rng(4)
    wanted = [(0, 0), (3, -2), (-5, 4), (1, 1), (16, 0)]
    big = rng.normal(100, 30, (5, 80, 80))
    a = big[:, 24:56, 24:56]
    b = np.stack([big[i, 24 + dy : 56 + dy, 24 + dx : 56 + dx] for i, (dy, dx) in enumerate(wanted)])
    assert [tuple(x) for x in layout.correlated(a, b)[:4]] == wanted[:4]


def test_planted_turns_are_found(spark):
    """Each pair's median is the planted turn, but for some of three pixels; RGB tiles give the same, missing tiles nothing."""
    views = rigs.fifteen_file_rig(spark)
    pairs = layout.view_pairs(rigs.horizon_pairs(views.withColumn("rig", F.lit(1)), "rig").drop("rig"), views)
    patches = layout.overlap_patches(pairs, probes_of.GATE_WIDTH, probes_of.GATE_PATCH, probes_of.GATE_STEP).cache()
    scene = probes_of._scene(spark, "/root/testdata/sf0.001").where("frame < 12").cache()
    shifts = layout.patch_shifts(scene, patches, probes_of.GATE_WIDTH, probes_of.GATE_PATCH).collect()
    by = {}
    for r in shifts:
        by.setdefault((r.frame, r.pair), []).append(r.px)
        assert r.px == np.hypot(r.dy, r.dx) and r.y % probes_of.GATE_STEP == 0 == r.x % probes_of.GATE_STEP
    assert len(by) == 120 and all(len(v) >= 11 for v in by.values())
    assert all(np.median(v) == frame % 4 for (frame, _), v in by.items() if frame % 4 < 3)
    assert np.mean([np.median(v) == 3 for (frame, _), v in by.items() if frame % 4 == 3]) > 0.8
    grey = scene.withColumn("pixels", F.flatten(F.transform("pixels", lambda p: F.array(p, p, p))))
    again = layout.patch_shifts(grey, patches, probes_of.GATE_WIDTH, probes_of.GATE_PATCH)
    assert {tuple(r)[:4] for r in again.collect()} == {tuple(r)[:4] for r in shifts}
    half = scene.withColumn("pixels", F.when(F.col("camera") < 6, F.col("pixels"))).where("camera <> 7")
    assert layout.patch_shifts(half, patches, probes_of.GATE_WIDTH, probes_of.GATE_PATCH).count() < len(shifts)
    assert layout.patch_shifts(scene.limit(0), patches, probes_of.GATE_WIDTH, probes_of.GATE_PATCH).count() == 0


def test_png_listing(spark, tmp_path):
    def png(w, h):
        chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0" * (3 * w + 1) * h)) + chunk(b"IEND", b"")

    for camera, size in ((1, 16), (2, 16), (3, 20)):
        folder = tmp_path / f"Camera{camera}" / ("Tempory" if camera == 2 else "")
        folder.mkdir(parents=True)
        for frame in range(4):
            (folder / f"S.{frame:04d}.png").write_bytes(png(size, size))
    (tmp_path / "Camera1" / "notes.txt").write_text("x")
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path)).select(F.col("path"), "length", F.substring("content", 1, 32).alias("head"))
    files = tiles.tile_files(listing)
    cameras = {r.camera: (r.width, r.height, r.frames) for r in tiles.camera_files(files).collect()}
    assert cameras == {1: (16, 16, 4), 2: (16, 16, 4), 3: (20, 20, 4)}
    assert {r.problem for r in tiles.problems(tiles.camera_files(files)).collect()} == {"resolution"}
    assert tiles.shared_tile_frames(files).count() == 4
    assert tiles.source_sets(files).head().usable is False
    assert tiles.tile_files(listing.limit(0)).count() == 0


def test_bad_field_of_view_is_refused(spark):
    views = spark.createDataFrame([(1, 0.0, 0.0, 180.0)], "camera int, yaw double, elevation double, fov double")
    with pytest.raises(PySparkException):
        geometry.warp_plan(geometry.directions(spark, 8, 4), views, 8).collect()


def test_frame_selection(spark):
    frames = spark.createDataFrame([(i,) for i in (0, 5, 6, 7, 9, 20)], "frame int")
    pick = lambda text: sorted(r.frame for r in delivery.select_frames(text, frames).collect())
    assert pick("all") == pick(" ") == [0, 5, 6, 7, 9, 20] and pick("5-7") == [5, 6, 7] and pick("9-, 0") == [0, 9, 20] and pick("-5") == [0, 5]
    for text in ("8", "7-5"):
        with pytest.raises(ValueError):
            pick(text)


def test_tiles_of_a_set_are_not_shuffled(spark):
    """Sets of tiles give what tiles in rows give; a tile went through a shuffle for each of its pairs before."""
    data = "/root/testdata/sf0.001"
    views = rigs.fifteen_file_rig(spark)
    pairs = layout.view_pairs(rigs.horizon_pairs(views.withColumn("rig", F.lit(1)), "rig").drop("rig"), views)
    patches = layout.overlap_patches(pairs, probes_of.GATE_WIDTH, probes_of.GATE_PATCH, probes_of.GATE_STEP).cache()
    sets = probes_of._scene_sets(spark, data).where("frame < 6")
    found = layout.set_shifts(sets, patches, probes_of.GATE_WIDTH, probes_of.GATE_PATCH)
    rows = layout.patch_shifts(probes_of._scene(spark, data).where("frame < 6"), patches, probes_of.GATE_WIDTH, probes_of.GATE_PATCH)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, rows.collect())) and found.count() > 0
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert "Join" not in plan and plan.count("Exchange") == 1  # of the vectors


def test_listing_is_grouped_once_and_by_hashes(spark):
    """The listing's grouping sorted all paths, and each reader of its frames ran it again (F16, F19, F20, F22)."""
    from mosaiq import catalogue_sources

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan(catalogue_sources._listing(spark, "/root/testdata/sf0.001"))
    assert "events.parquet" not in plan(catalogue_sources.QUERIES["source_survey"](spark, "/root/testdata/sf0.001"))
    listing = spark.createDataFrame([("/a/Camera1/S.0001.png\n", 1), ("/a/CAMERA_02/in/S$1.00012.Exr", 2), ("/a/x/S.0001.png", 3), (None, 4)], "path string, length long")
    got = {r.length: (r.root, r.directory, r.camera, r.inner, r.stem, r.frame, r.digits, r.format) for r in tiles.tile_files(listing).collect()}
    assert got == {1: ("/a", "Camera1", 1, "", "S", 1, 4, "png"), 2: ("/a", "CAMERA_02", 2, "in", "S$1", 12, 5, "exr")}


def test_survey_keeps_sets_of_unknown_rigs(spark, tmp_path):
    """Sets of other than four cameras were left out, by the query and its SQL (F1); they have a size and no distinct views."""
    import duckdb

    from mosaiq import catalogue_sources

    kind, user = F.col("event_type"), F.col("user_id")
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("user_id", F.when(kind == "click", user % 3).when(kind == "view", user * 0).otherwise(user))
    events.write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(tuple(r) for r in catalogue_sources.QUERIES["source_survey"](spark, str(tmp_path)).collect())
    db = duckdb.connect()
    db.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(db.sql(catalogue_sources.ORACLE_SQL["source_survey"]).fetchall())
    assert [r[0] for r in got] == [f"/data/{k}" for k in ("click", "error", "purchase", "signup", "view")]
    assert [r[2] is None for r in got] == [True, False, False, False, True] and all(r[1] > 0 for r in got)
    assert got == [tuple(v if not isinstance(v, float) else pytest.approx(v, abs=2e-9) for v in r) for r in want]
    sets = spark.createDataFrame([("a", "S", n, n << 20, f) for n, f in ((1, 0), (15, 1), (20, 4))], "root string, stem string, cameras long, total_bytes long, frames long")
    known = spark.createDataFrame([(20, 15), (15, 15)], "cameras long, distinct_views long")
    assert sorted(tuple(r)[2:] for r in tiles.survey(sets, known).collect()) == [(1.0, None), (5.0, 3.75), (15.0, 15.0)]


def test_survey_counts_every_frame(spark, tmp_path):
    """Frame numbers of more than five digits were cut to five, by the query and its SQL, so frames fell together (F1)."""
    import duckdb

    from mosaiq import catalogue_sources

    spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("event_id", F.col("event_id") + 12 * 1234000).write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(tuple(r) for r in catalogue_sources.QUERIES["source_survey"](spark, str(tmp_path)).collect())
    db = duckdb.connect()
    db.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(db.sql(catalogue_sources.ORACLE_SQL["source_survey"]).fetchall())
    assert got == [tuple(v if not isinstance(v, float) else pytest.approx(v, abs=2e-9) for v in r) for r in want]
    frames = tiles.source_sets(tiles.tile_files(catalogue_sources._listing(spark, str(tmp_path), every_digit=True))).where("root = '/data/signup'").head().frames
    assert frames == db.sql("select count(distinct event_id // 12) from events where event_type = 'signup' and event_id % 41 <> 0").fetchall()[0][0] > 60


def test_gather_shuffles_tiles_alone(spark):
    """Samples were shuffled, or summed for whole tables in one task (F14, F18): now a frame's tiles meet and the plan is broadcast."""
    from mosaiq import catalogue

    for name in ("panorama", "panorama_bicubic"):
        plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        dealt = [line for line in plan.splitlines() if "hashpartitioning(frame" in line]
        assert len(dealt) == 1 and "out_index" not in dealt[0] and "SortMergeJoin camera" not in plan and "BroadcastHashJoin [camera" in plan
