"""Hold-out, rig fit and the doubled stream on small fixtures, against plain versions."""

import numpy as np
import pytest
from pyspark.errors import PySparkException

from mosaiq import catalogue_trials as of
from mosaiq.operators import holdout, rigfit

SHAPE = "k long, pixels array<double>, panorama array<double>, fov double, yaw double, elevation double, roll double"


def test_sweep_scores_equal_plain_correlations(spark):
    """Each candidate's score is numpy's correlation over one pixel at a time; a flat tile and a null one score 0."""
    rng = np.random.default_rng(5)
    sphere, tile = rng.random(24 * 12), rng.random(16)
    sweep = rigfit.Sweep(fov=(70.0, 100.0), yaw=(0.0, 90.0, 200.0), elevation=(-30.0, 20.0), roll=(0.0, 15.0))
    rows = [(1, tile.tolist(), sphere.tolist(), 0.0, 0.0, 0.0, 0.0), (2, [3.0] * 16, sphere.tolist(), 0.0, 0.0, 0.0, 0.0), (3, None, sphere.tolist(), 0.0, 0.0, 0.0, 0.0)]
    got = {(r.k, r.candidate): r for r in rigfit.scored(spark.createDataFrame(rows, SHAPE), "k", sweep, 4, 24, 12).collect()}
    assert len(got) == 3 * sweep.candidates == 72 and all(r.score == 0 for (k, _), r in got.items() if k > 1)
    number = 0
    for fov in sweep.fov:
        for yaw in sweep.yaw:
            for elevation in sweep.elevation:
                for roll in sweep.roll:
                    f, y, e, r = np.radians([fov, yaw, elevation, roll])
                    seen = []
                    for i in range(16):
                        ray = np.array([1.0, ((i % 4 + 0.5) / 2 - 1) * np.tan(f / 2), -((i // 4 + 0.5) / 2 - 1) * np.tan(f / 2)])
                        ray = np.array([[1, 0, 0], [0, np.cos(r), -np.sin(r)], [0, np.sin(r), np.cos(r)]]) @ ray
                        ray = np.array([[np.cos(e), 0, -np.sin(e)], [0, 1, 0], [np.sin(e), 0, np.cos(e)]]) @ ray
                        ray = np.array([[np.cos(y), -np.sin(y), 0], [np.sin(y), np.cos(y), 0], [0, 0, 1]]) @ ray
                        column = int((np.arctan2(ray[1], ray[0]) / 2 / np.pi + 0.5) * 24) % 24
                        seen.append(sphere[int((0.5 - np.arcsin(ray[2] / np.linalg.norm(ray)) / np.pi) * 12) * 24 + column])
                    row = got[1, number]
                    assert (row.fov, row.yaw, row.elevation, row.roll) == (fov, yaw, elevation, roll)
                    assert row.score == pytest.approx(np.corrcoef(tile, seen)[0, 1], abs=1e-9)
                    number += 1


def test_impossible_fields_of_view_end_the_sweep_and_no_tiles_give_none(spark):
    rows = [(1, [0.0, 1.0, 2.0, 3.0], [1.0] * 32, 180.0, 0.0, 0.0, 0.0)]
    with pytest.raises(PySparkException):
        rigfit.scored(spark.createDataFrame(rows, SHAPE), "k", rigfit.Sweep(), 2, 8, 4).collect()
    assert rigfit.fitted(spark.createDataFrame([], SHAPE).select("k", "pixels", "panorama"), "k", of.SWEEPS[1:], 2, 8, 4).count() == 0


def test_fit_leaves_a_wrong_basin_and_climbs_to_the_end(spark):
    """Panoramas of ten waves each on which a search from the best coarse turn alone ended up to six degrees off (F7)."""
    planted = {246: (80.0, 102.0, -7.0, -2.0), 293: (94.0, 41.0, 24.0, -5.0), 407: (94.0, 299.0, -18.0, 4.0), 571: (87.0, 247.0, 4.0, 8.0)}
    lon, lat = np.meshgrid(((np.arange(of.WIDTH) + 0.5) / of.WIDTH - 0.5) * 2 * np.pi, (0.5 - (np.arange(of.HEIGHT) + 0.5) / of.HEIGHT) * np.pi)
    rows = []
    for seed, turn in planted.items():
        x, y, z, at = np.random.default_rng(seed).normal(size=(10, 4)).round(3).T
        x, y, z = np.array((x, y, z)) * 4 / np.sqrt(x * x + y * y + z * z)
        sphere = np.cos(np.cos(lat)[..., None] * (np.cos(lon)[..., None] * x + np.sin(lon)[..., None] * y) + np.sin(lat)[..., None] * z + 3 * at).sum(2).ravel()
        rows.append((seed, sphere[rigfit._shown(np.array([turn]), of.TILE, of.WIDTH, of.HEIGHT)[0]].tolist(), sphere.tolist()))
    tiles = spark.createDataFrame(rows, "k long, pixels array<double>, panorama array<double>")
    got = {r.k: ((r.fov, r.yaw % 360, r.elevation, r.roll), round(r.score, 9)) for r in rigfit.fitted(tiles, "k", of.SWEEPS, of.TILE, of.WIDTH, of.HEIGHT).collect()}
    assert got == {k: (turn, 1.0) for k, turn in planted.items()}


def test_fit_of_flat_and_null_tiles_scores_0(spark):
    rows = [(1, [3.0] * 4, [1.0, 2.0] * 16), (2, None, [1.0, 2.0] * 16), (3, [1.0, 2.0, 3.0, 4.0], None)]
    tiles = spark.createDataFrame(rows, "k long, pixels array<double>, panorama array<double>")
    sweeps = [rigfit.Sweep(fov=(80.0, 90.0), yaw=(0.0, 90.0)), rigfit.Sweep.around(1.0, 1)]
    assert {r.k: r.score for r in rigfit.fitted(tiles, "k", sweeps, 2, 8, 4).collect()} == {1: 0.0, 2: 0.0, 3: 0.0}


def test_stream_does_not_depend_on_the_split(spark):
    sets = [{tuple(r) for r in of._slots(spark, "/root/testdata/sf0.001", parts).collect()} for parts in (1, 4)]
    assert sets[0] == sets[1] and sets[0]


def test_held_out_frames(spark):
    """Frame 1 lies between 0 and 2; frame 3 has no later neighbour; a null pixel is left out."""
    rows = [(0, [0, 0, 10, 10] * 2), (1, [6, 5, 10, None] * 2), (2, [9, 10, 10, 10] * 2), (3, [1] * 8)]
    frames = spark.createDataFrame(rows, "frame int, pixels array<int>")
    view = holdout.View(4, 2, 1, 90.0)
    gaps = holdout.differences(holdout.predicted(frames, []), frames, [], view)
    assert {(r.method, r.frame, r.x): r.difference for r in gaps.where("y = 0").collect()} == {("blend", 1, 0): 1, ("blend", 1, 1): 0, ("blend", 1, 2): 0, ("repeat", 1, 0): 6, ("repeat", 1, 1): 5, ("repeat", 1, 2): 0}
    scores = {r.method: r for r in holdout.frame_scores(gaps, [], view).collect()}
    assert scores["repeat"].wrap == 6.0 and scores["repeat"].rest == 2.5 and scores["repeat"].zenith is None and (scores["repeat"].worst, scores["repeat"].worst_row, scores["repeat"].worst_column) == (6.0, 0, 0)
    assert holdout.method_scores(gaps.limit(0), [], view).count() == 0
