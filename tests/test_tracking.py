"""Correlation, object search and tracking against loops over single pixels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaiq import catalogue_objects as planted
from mosaiq.operators import tracking

S = planted.SCALE


def test_correlation_maps_equal_a_loop():
    rng = np.random.default_rng(2)
    patches, windows = rng.normal(100, 20, (4, 7, 7)), rng.normal(100, 20, (4, 15, 15))
    windows[1], patches[2] = 5.0, 3.0  # no contrast: no correlation
    windows[3, 2:9, 5:12] = 2 * patches[3] + 1
    maps = tracking.correlation_maps(patches, windows)
    for n in range(4):
        for y in range(9):
            for x in range(9):
                a, b = patches[n].ravel(), windows[n, y : y + 7, x : x + 7].ravel()
                want = np.corrcoef(a, b)[0, 1] if a.std() and b.std() else 0.0
                assert abs(maps[n, y, x] - want) < 1e-6
    best = tracking.best_places(maps[3:], 9.0)[0]
    assert abs(best[2] - 1) < 1e-9 and np.abs(best[:2] - (-2, 1)).max() <= 0.5
    assert np.hypot(*tracking.best_places(maps[3:], 1.0)[0, :2]) <= 1 + 0.5 * 2**0.5  # within the limit, then refined


def test_places_are_refined_by_parabolas():
    y, x = np.meshgrid(np.arange(-4, 5), np.arange(-4, 5), indexing="ij")
    maps = np.stack([1 - ((y - cy) ** 2 + (x - cx) ** 2) / 100 for cy, cx in ((0.25, -1.4), (4, -4), (0, 0))])
    got = tracking.best_places(maps, 6.0)
    assert np.allclose(got[:, :2], [(0.25, -1.4), (4, -4), (0, 0)])  # a peak on the edge is not refined there


def test_means_and_objects_equal_loops():
    rng = np.random.default_rng(3)
    luma = 100 + rng.normal(0, 1, (60, 70))
    for y, x, v in ((20, 20, 60), (30, 45, -50), (45, 20, 40), (3, 3, 90), (31, 50, 30)):
        luma[y : y + 2, x : x + 2] += v
    padded = np.pad(luma, 6, mode="edge")
    plain = np.array([[padded[y : y + 13, x : x + 13].mean() for x in range(70)] for y in range(60)])
    assert np.allclose(tracking.box_means(luma, 6), plain)
    seen, want = set(), []
    for y in range(60):
        for x in range(70):
            if abs(luma[y, x] - plain[y, x]) > S.contrast and 6 < y < 54 and 6 < x < 64 and (y // 6, x // 6) not in seen:
                seen.add((y // 6, x // 6))
                ring = [luma[y + d, x + side] for side in (-6, 6) for d in range(-6, 6)]
                if np.std(ring) < S.flat:
                    want.append((y, x))
    got = sorted(zip(*(v.tolist() for v in tracking.find_objects(luma, S, 6))))
    assert got == sorted(want) and len(want) >= 3
    level, sign = tracking.strengths(luma, *np.array(got).T, S)
    for (y, x), v, up in zip(got, level, sign):
        around = np.median([luma[y + d, x + side] for side in (-6, 6) for d in range(-6, 6)])
        patch = luma[y - 3 : y + 4, x - 3 : x + 4]
        assert v == pytest.approx(max(patch.max() - around, around - patch.min())) and (up > 0) == (patch.max() - around >= around - patch.min())


def test_motions_within_a_tenth_of_a_pixel(spark):
    pictures = planted._pictures(spark, "/root/testdata/sf0.001").cache()
    rows = tracking.moving_objects(pictures, "clip", scale=S).collect()
    assert rows
    for r in rows:
        swing = (-3 if r.frame % 4 == 0 else 1) * (1 if r.sign > 0 else -1) * 0.5
        assert abs(r.vy - swing * (r.clip % 5 - 2)) < 0.1 and abs(r.vx - swing * (r.clip // 5 % 5 - 2)) < 0.1


def test_missing_pictures(spark):
    pictures = planted._pictures(spark, "/root/testdata/sf0.001").cache()
    holes = pictures.withColumn("luma", F.when(F.col("frame") % 5 != 0, F.col("luma")))
    got = {(r.clip, r.frame) for r in tracking.moving_objects(holes, "clip", scale=S).collect()}
    assert got and all(frame % 5 > 1 for _, frame in got)
    pairs = spark.createDataFrame([(1, 2)], "a int, b int")
    found = tracking.correspondences(tracking.moving_objects(holes, "clip", scale=S), holes, pairs, "clip", scale=S)
    assert {(r.frame + r.ahead) % 5 == 0 for r in found.collect()} == {False}
    none = pictures.limit(0)
    assert tracking.moving_objects(none, "clip", scale=S).count() == 0 == tracking.objects(none, "clip", scale=S).count()
    assert tracking.pair_report(tracking.correspondences(tracking.moving_objects(none, "clip", scale=S), none, pairs, "clip", scale=S), "clip", scale=S).count() == 0


def test_pictures_are_never_broadcast(spark):
    """They look small to the planner before they are drawn: all of them went to the driver."""
    for name in ("moving_objects", "object_survival"):
        plan = planted.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" in plan and "BroadcastExchange" not in plan


def test_motions_across_the_edges_of_runs(spark):
    """Frames far along, below zero and twice: each pair of neighbours is met once for each pair of rows, as by a join."""
    pictures = planted._pictures(spark, "/root/testdata/sf0.001").where("clip < 8 and camera = 1").cache()
    want = {(r.clip, r.frame, r.y, r.x) for r in tracking.moving_objects(pictures, "clip", scale=S).collect()}
    for shift in (-tracking.RUN - 3, 5, 11):
        moved = pictures.withColumn("frame", F.col("frame") + shift)
        assert {(r.clip, r.frame - shift, r.y, r.x) for r in tracking.moving_objects(moved, "clip", scale=S).collect()} == want
    twice = pictures.unionAll(pictures.where("frame = 4"))
    assert tracking.moving_objects(twice, "clip", scale=S).count() == len(want) + sum((frame in (4, 5)) for _, frame, _, _ in want)
