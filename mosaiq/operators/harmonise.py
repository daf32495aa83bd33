"""Correction grids per camera: residuals against the blend by cell, filled and averaged over the grid, round after round.

A grid is dense and small (a few thousand cells a camera and frame): it, or those of a frame, is one group of a NumPy step. All else, samples,
blends and cell sums, are joins and groupings over all frames.
"""

from __future__ import annotations

import tempfile
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mosaiq.operators import capture, sampling
from mosaiq.operators.geometry import LEAST_WEIGHT

LIMIT, FLOOR = 32.0, 0.05


def dense(cells: DataFrame, keys: list[str], rows: int, columns: int) -> DataFrame:
    """Every cell of each key's grid; absent ones have value 0 and covered false."""
    grid = cells.select(*keys).distinct().withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(rows * columns - 1))))
    grid = grid.select(*keys, F.floor(F.col("_i") / columns).cast("int").alias("gy"), (F.col("_i") % columns).cast("int").alias("gx"))
    full = grid.join(cells, [*keys, "gy", "gx"], "left").withColumn("covered", F.col("value").isNotNull())
    return full.fillna(0.0, ["value"])


@lru_cache(maxsize=64)
def _averaging(n: int, radius: int) -> np.ndarray:
    """Matrix of three running means of 2 * radius + 1 places along a line of n, whose ends are continued."""
    once = np.zeros((n, n))
    for step in range(-radius, radius + 1):
        once[np.arange(n), np.clip(np.arange(n) + step, 0, n - 1)] += 1.0
    return np.linalg.matrix_power(once / (2 * radius + 1), 3)


def averaged(field: np.ndarray, radius: int) -> np.ndarray:
    """Threefold mean over squares of 2 * radius + 1 cells of a stack (rows, columns, channels)."""
    down, across = (_averaging(n, radius) for n in field.shape[:2])
    return np.swapaxes(np.tensordot(np.tensordot(down, field, (1, 0)), across, (1, 1)), 1, 2)


def spread(field: np.ndarray, covered: np.ndarray) -> np.ndarray:
    """Uncovered cells take the averaged value of the covered ones in reach; the reach doubles from two until none is left."""
    field, covered, radius = np.where(covered[..., None], field, 0.0), covered.copy(), 2
    while not covered.all() and radius <= min(256, 2 * max(covered.shape)):
        share = averaged(covered[..., None].astype(float), radius)
        total = averaged(field * covered[..., None], radius)
        fresh = ~covered & (share[..., 0] > 1e-12)
        field[fresh] = total[fresh] / share[fresh]
        covered |= fresh
        radius *= 2
    return field


def smoothed(means: DataFrame, keys: list[str], channels: list[str], rows: int, columns: int, radius: int, by: list[str] | None = None) -> DataFrame:
    """A row of each key: its whole grid, filled and averaged, as an array a channel, row by row. means: (keys, gy, gx, channels).

    A group is one key's cells, at most rows * columns of them, so its task is bounded by the grid; with some of the keys
    named in `by`, it is all grids that share those (the cameras of a frame), as a group costs more than a small grid."""
    by = by or keys

    def run(key, part):
        found = []
        for own, cells in [(key, part)] if by == keys else part.groupby(keys, sort=False, dropna=False):
            field, covered = np.zeros((rows, columns, len(channels))), np.zeros((rows, columns), bool)
            y, x = cells["gy"].to_numpy(), cells["gx"].to_numpy()
            field[y, x], covered[y, x] = cells[channels].to_numpy(), True
            field = averaged(spread(field, covered), radius)
            found.append([*own, *(field[..., i].ravel() for i in range(len(channels)))])
        return pd.DataFrame(found, columns=[*keys, *channels])

    shape = T.StructType([means.schema[k] for k in keys] + [T.StructField(c, T.ArrayType(T.DoubleType())) for c in channels])
    return means.select(*keys, "gy", "gx", *channels).groupBy(*by).applyInPandas(run, shape)


def exploded(grids: DataFrame, keys: list[str], channels: list[str], columns: int) -> DataFrame:
    """Grids as rows (keys, gy, gx, channels)."""
    cells = grids.select(*keys, F.posexplode(F.arrays_zip(*channels)).alias("_i", "_v"))
    return cells.select(*keys, F.floor(F.col("_i") / columns).cast("int").alias("gy"), (F.col("_i") % columns).alias("gx"), *[F.col(f"_v.{c}").alias(c) for c in channels])


def cell_means(residuals: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted mean residual of each cell that holds more than `FLOOR` of its key's best weight."""
    cells = residuals.groupBy(*keys, "gy", "gx").agg(F.sum(F.col("residual") * F.col("weight")).alias("s"), F.sum("weight").alias("w"))
    best = F.max("w").over(Window.partitionBy(*keys))
    return cells.withColumn("_b", best).where(F.col("w") > FLOOR * F.col("_b")).select(*keys, "gy", "gx", (F.col("s") / F.col("w")).alias("value"))


def _held(value: Column) -> Column:
    return F.greatest(F.least(value, F.lit(LIMIT)), F.lit(-LIMIT))


def correction(residuals: DataFrame, keys: list[str], rows: int, columns: int, radius: int = 3) -> DataFrame:
    """One estimate of each key's grid: cell means, filled, averaged, held within `LIMIT`."""
    grids = smoothed(cell_means(residuals, keys), keys, ["value"], rows, columns, radius)
    return exploded(grids.withColumn("value", F.transform("value", _held)), keys, ["value"], columns)


@dataclass(frozen=True)
class Estimate:
    """Sizes of an estimate: the coarse panorama, the grid over it, how far it is averaged, and how often it is made."""

    width: int = 240
    height: int = 120
    rows: int = 60
    columns: int = 120
    radius: int = 3
    rounds: int = 2

    def __post_init__(self):
        if min(self.width, self.height, self.rows, self.columns) < 2 or self.rounds < 1:
            raise ValueError("an estimate needs two rows and columns and a round")


def corrected(samples: DataFrame, grids: DataFrame, channels: list[str], size: Estimate) -> DataFrame:
    """Samples less their camera's correction, read between the cells; a camera without a grid keeps its levels."""
    named = grids.select("frame", "camera", *[F.col(c).alias(f"_g_{c}") for c in channels])
    less = lambda c: F.coalesce(sampling.upsample(F.col(f"_g_{c}"), size.columns, size.rows, F.col("out_index"), size.width, size.height), F.lit(0.0))
    return samples.join(named, ["frame", "camera"], "left").withColumns({c: F.col(c) - less(c) for c in channels}).drop(*[f"_g_{c}" for c in channels])


def mixed(samples: DataFrame, channels: list[str]) -> DataFrame:
    """The weighted mean of each direction of each frame, a column a channel."""
    return samples.groupBy("frame", "out_index").agg(*[(F.sum(F.col(c) * F.col("weight")) / F.greatest(F.sum("weight"), F.lit(LEAST_WEIGHT))).alias(c) for c in channels])


def _residual_means(samples: DataFrame, channels: list[str], size: Estimate) -> DataFrame:
    """Weighted mean by cell of what each camera's levels differ from the blend that they are part of; thin cells fall out.

    Samples are dealt by frame once, where the blend, the cells and a frame's grids all find them."""
    n = int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes and much work: as many tasks as the session has
    samples = samples.repartition(n, "frame")
    seen = Window.partitionBy("frame", "out_index")
    total = F.greatest(F.sum("weight").over(seen), F.lit(LEAST_WEIGHT))
    place = lambda i, cells, pixels: F.least(F.floor(i * cells / pixels), F.lit(cells - 1)).cast("int")
    left = samples.select(
        "frame", "camera", "weight", place(F.floor(F.col("out_index") / size.width), size.rows, size.height).alias("gy"), place(F.col("out_index") % size.width, size.columns, size.width).alias("gx"),
        *[(F.col(c) - F.sum(F.col(c) * F.col("weight")).over(seen) / total).alias(c) for c in channels],
    )
    cells = left.groupBy("frame", "camera", "gy", "gx").agg(F.sum("weight").alias("_w"), *[(F.sum(F.col(c) * F.col("weight")) / F.sum("weight")).alias(c) for c in channels])
    return cells.withColumn("_b", F.max("_w").over(Window.partitionBy("frame", "camera"))).where(F.col("_w") > FLOOR * F.col("_b")).drop("_w", "_b")


def written(rows: DataFrame) -> DataFrame:
    """The rows from the shared folder, so that a later round does not read the tiles again; survives lost executors."""
    context = rows.sparkSession.sparkContext
    if not context.getCheckpointDir():
        shared = rows.sparkSession.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(shared or "file://" + tempfile.mkdtemp(prefix="mosaiq-"))
    return rows.checkpoint()


def converged(samples: DataFrame, channels: list[str], size: Estimate = Estimate()) -> tuple[DataFrame, DataFrame]:
    """Samples (frame, camera, out_index, weight, channels) as written, and each camera's grids (frame, camera, an array a channel).

    A blend holds the camera that is measured against it, so one estimate is too small: the next starts from the samples less
    what is known, and adds. Samples lie by frame and camera, where a round joins the grids without moving them; only the
    blend, over cameras, is a shuffle of a round. Rows with a null in a channel or weight must be gone. No rows: no grids."""
    samples = written(samples.select("frame", "camera", "out_index", "weight", *channels).repartition("frame", "camera"))
    grids = None
    for _ in range(size.rounds):
        now = samples if grids is None else corrected(samples, grids, channels, size)
        field = smoothed(_residual_means(now, channels, size), ["frame", "camera"], channels, size.rows, size.columns, size.radius, by=["frame"])
        if grids is not None:
            before = grids.select("frame", "camera", *[F.col(c).alias(f"_g_{c}") for c in channels])
            field = field.join(before, ["frame", "camera"]).select("frame", "camera", *[F.zip_with(c, f"_g_{c}", lambda a, b: a + b).alias(c) for c in channels])
        grids = written(field.withColumns({c: F.transform(c, _held) for c in channels}))
    return samples, grids


def agreements(samples: DataFrame, grids: DataFrame, channels: list[str], size: Estimate) -> DataFrame:
    """Per frame, how far cameras differ in luma before and after, and the largest correction. channels: red, green, blue."""
    def of(rows, name):
        luma = rows.select("frame", F.col("out_index").alias("direction"), "camera", "weight", sampling.luma(*[F.col(c) for c in channels]).alias("sample"))
        return capture.agreement(luma).select("frame", *[F.col(c).alias(f"{name}_{c}") for c in ("median", "mean", "p95", "large_share", "verdict")])

    most = grids.groupBy("frame").agg(F.max(F.greatest(*[F.array_max(F.transform(c, F.abs)) for c in channels])).alias("largest"))
    return of(samples, "raw").join(of(corrected(samples, grids, channels, size), "corrected"), "frame").join(most, "frame")


def largest(grid: DataFrame, keys: list[str]) -> DataFrame:
    return grid.groupBy(*keys).agg(F.max(F.abs("value")).alias("largest"))


def eroded(mask: DataFrame, keys: list[str], rows: int, columns: int, radius: int) -> DataFrame:
    """Cells whose whole square is set; outside counts as unset. mask: (keys, gy, gx, set)."""
    one = mask.withColumn("value", F.col("set").cast("double"))
    for axis, other in (("gy", "gx"), ("gx", "gy")):
        line = Window.partitionBy(*keys, other).orderBy(axis).rowsBetween(-radius, radius)
        one = one.withColumn("value", F.sum("value").over(line))
    return one.select(*keys, "gy", "gx", (F.col("value") == (2 * radius + 1) ** 2).alias("set"))
