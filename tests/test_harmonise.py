"""The harmoniser on planted differences, empty input and tiles that lack a channel."""

import numpy as np
from pyspark.sql import functions as F

from mosaiq import catalogue_harmony as of
from mosaiq.operators import geometry, harmonise


def _tiles(spark, rows):
    return spark.createDataFrame(rows, "frame long, camera long, red array<double>, green array<double>, blue array<double>")


def _seen(spark):
    return geometry.contributors(geometry.directions(spark, of.SIZE.width, of.SIZE.height), of._views(spark))


def test_planted_fog_is_taken_out(spark):
    """Grey tiles with an offset of their own: each round leaves less difference, two less than half; a tile without blue is none."""
    rows = [(f, c, *([[100.0 + 6 * ((c * 5 + f) % 4 - 1.5)] * 64] * 3)) for f in range(2) for c in range(8)]
    rows.append((2, 0, [1.0] * 64, [1.0] * 64, None))
    samples = geometry.samples(_seen(spark), _tiles(spark, rows), 8, channels=tuple(of.RGB))
    assert {r.frame for r in samples.select("frame").distinct().collect()} == {0, 1}
    means = []
    for rounds in (1, 2):
        size = harmonise.Estimate(48, 24, 6, 12, 1, rounds)
        kept, grids = harmonise.converged(samples, of.RGB, size)
        report = harmonise.agreements(kept, grids, of.RGB, size).collect()
        assert len(report) == 2 and grids.count() == 16
        assert all(0 < r.largest <= harmonise.LIMIT for r in report)
        means.append({r.frame: (r.raw_mean, r.corrected_mean) for r in report})
    once, twice = means
    assert all(twice[f][1] < once[f][1] < once[f][0] and twice[f][1] < 0.5 * twice[f][0] for f in (0, 1))


def test_no_tiles_no_grids(spark):
    samples = geometry.samples(_seen(spark), _tiles(spark, []), 8, channels=tuple(of.RGB))
    kept, grids = harmonise.converged(samples, of.RGB, of.SIZE)
    assert kept.count() == grids.count() == 0 == harmonise.agreements(kept, grids, of.RGB, of.SIZE).count()


def test_camera_without_grid_keeps_its_levels(spark):
    samples = spark.createDataFrame([(1, 1, 5, 1.0, 7.0)], "frame long, camera long, out_index long, weight double, v double")
    none = spark.createDataFrame([], "frame long, camera long, v array<double>")
    assert harmonise.corrected(samples, none, ["v"], of.SIZE).head().v == 7.0


def test_filled_cells_lie_between_covered_ones():
    rng = np.random.default_rng(3)
    covered = rng.random((9, 14)) < 0.15
    field = rng.normal(0, 5, (9, 14, 2))
    full = harmonise.spread(field, covered)
    assert np.array_equal(full[covered], field[covered])
    assert full.min() >= field[covered].min() - 1e-9 and full.max() <= field[covered].max() + 1e-9
    assert not harmonise.spread(field, np.zeros((9, 14), bool)).any()
    flat = harmonise.averaged(np.full((9, 14, 1), 3.0), 4)
    assert np.allclose(flat, 3.0)


def test_cells_are_arrays_of_rows(spark):
    grids = spark.range(1).select(F.lit(1).alias("camera"), F.array(*[F.lit(float(i)) for i in range(6)]).alias("v"))
    assert [(r.gy, r.gx, r.v) for r in harmonise.exploded(grids, ["camera"], ["v"], 3).orderBy("v").collect()] == [(i // 3, i % 3, float(i)) for i in range(6)]


def test_a_frame_is_dealt_once_and_smoothed_as_a_group(spark):
    """Each camera's grid was a group of its own, in a single task of 29 s, and samples moved twice a round (F21)."""
    samples = spark.range(4000).select((F.col("id") % 5).alias("frame"), F.floor(F.col("id") / 5 % 4).alias("camera"), F.floor(F.col("id") / 20).alias("out_index"), F.lit(1.0).alias("weight"), F.rand(3).alias("v"))
    means = harmonise._residual_means(samples, ["v"], of.SIZE)
    plan = means._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1 and "REPARTITION_BY_NUM" in plan
    means = harmonise.written(means)
    own, shared = ({(r.frame, r.camera): r.v for r in harmonise.smoothed(means, ["frame", "camera"], ["v"], 6, 12, 1, by).collect()} for by in (None, ["frame"]))
    assert own == shared and len(own) == 20
