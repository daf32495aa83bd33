"""Measures of pictures against each other, over rows of levels; all are aggregations with map-side partials."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def psnr(a: str, b: str) -> Column:
    """Aggregate: decibels of peak 255; infinite where all levels are equal."""
    mse = F.avg((F.col(a) - F.col(b)) * (F.col(a) - F.col(b)))
    return F.when(mse == 0, F.lit(float("inf"))).otherwise(10 * F.log10(65025.0 / mse))


def correlation(a: str, b: str) -> Column:
    """Aggregate: zero-mean normalised cross-correlation; 0 where a side is flat."""
    return F.coalesce(F.nanvl(F.corr(a, b), F.lit(0.0)), F.lit(0.0))


def difference_stats(rows: DataFrame, a: str, b: str, *keys: str) -> DataFrame:
    """Bias, mean, share over one level, 99th and 99.9th percentile and largest of the differences b - a."""
    d = F.col(b) - F.col(a)
    return rows.groupBy(*keys).agg(
        F.avg(d).alias("bias"), F.avg(F.abs(d)).alias("mean"), F.avg((F.abs(d) > 1).cast("double")).alias("over_one"),
        F.percentile(F.abs(d), F.lit(0.99)).alias("p99"), F.percentile(F.abs(d), F.lit(0.999)).alias("p999"), F.max(F.abs(d)).alias("largest"))


def pooled_errors(rows: DataFrame, a: str, b: str, *keys: str) -> DataFrame:
    """Sums that add up over bands and frames: number, squared and absolute errors."""
    d = F.col(a) - F.col(b)
    return rows.groupBy(*keys).agg(F.count(d).alias("n"), F.sum(d * d).alias("squared"), F.sum(F.abs(d)).alias("absolute"))


def encode_tally(rows: DataFrame, got: str, exact: str, at: str, *keys: str) -> DataFrame:
    """Mean and largest error with where it is (the least such place), and shares that round to another code."""
    e = F.abs(F.col(got) - F.col(exact))
    off = lambda scale: F.avg((F.rint(F.col(got) * scale) != F.rint(F.col(exact) * scale)).cast("double"))
    return rows.groupBy(*keys).agg(F.avg(e).alias("mean"), F.max(e).alias("largest"), F.max_by(at, F.struct(e, -F.col(at))).alias("at"), off(1.0).alias("off8"), off(257.0).alias("off16"))


def band_statistics(rows: DataFrame, *keys: str) -> DataFrame:
    """Partials of a direction's levels: number, sum and sum of squares."""
    return rows.groupBy(*keys).agg(F.count("luma").alias("n"), F.sum("luma").alias("s"), F.sum(F.col("luma") * F.col("luma")).alias("q"))


def merged_statistics(bands: DataFrame, *keys: str) -> DataFrame:
    """Bands put together: number, mean and population deviation, from partials alone."""
    total = bands.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    mean = F.col("s") / F.col("n")
    return total.select(*keys, "n", mean.alias("mean"), F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))).alias("deviation"))


def solid_angle(row: Column, height: int) -> Column:
    """Weight of a panorama row."""
    return F.cos((0.5 - (row + 0.5) / height) * F.pi())


def sphere_coverage(seen: DataFrame, width: int, height: int) -> DataFrame:
    """Share of the sphere by number of views that see it; seen: (out_index, camera)."""
    per = seen.groupBy("out_index").agg(F.count_distinct("camera").alias("views"))
    weight = solid_angle(F.floor(F.col("out_index") / width), height)
    total = sum(math.cos((0.5 - (r + 0.5) / height) * math.pi) for r in range(height)) * width
    return per.groupBy("views").agg((F.sum(weight) / total).alias("share"))


def worst_block(pixels: DataFrame, block: int, *keys: str) -> DataFrame:
    """The block of largest mean difference of each key; the first of equal ones. pixels: (keys, y, x, difference)."""
    place = (F.floor(F.col("y") / block).alias("by"), F.floor(F.col("x") / block).alias("bx"))
    means = pixels.groupBy(*keys, *place).agg(F.avg("difference").alias("mean"))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("mean"), "by", "bx"))
    return means.withColumn("_r", first).where("_r = 1").drop("_r")


def seam_ratio(values: Column, side: int) -> Column:
    """Mean step across over mean step along a vertical seam in a square patch; 1 where it is flat along."""
    at = lambda i: F.get(values, i.cast("int")).cast("double")
    n = side * (side - 1)
    total = lambda f: F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), f), F.lit(0.0), lambda a, x: a + x) / n
    across = total(lambda i: F.abs(at(F.floor(i / (side - 1)) * side + i % (side - 1) + 1) - at(F.floor(i / (side - 1)) * side + i % (side - 1))))
    along = total(lambda i: F.abs(at(i + side) - at(i)))
    return F.when(along < 1e-3, 1.0).otherwise(across / along)


def is_between(apart: Column, before: Column, after: Column, margin: float = 10.0) -> Column:
    """Whether a frame is no further from its neighbours than they are apart, and the margin."""
    return F.greatest(before, after) <= apart + margin


def parabola(left: Column, centre: Column, right: Column) -> Column:
    """Place of a peak sampled at -1, 0, 1; 0 where the three form none."""
    bend = left - 2 * centre + right
    return F.when(bend >= 0, 0.0).otherwise(F.greatest(F.least(0.5 * (left - right) / bend, F.lit(0.5)), F.lit(-0.5)))


def thinned(objects: DataFrame, most: int, *keys: str) -> DataFrame:
    """At most so many rows of each key, by an even stride over `place`."""
    key = Window.partitionBy(*keys)
    n, i = F.count(F.lit(1)).over(key), F.row_number().over(key.orderBy("place")) - 1
    rows = objects.withColumns({"_n": n, "_i": i}).withColumn("_step", F.ceil(F.col("_n") / most))
    return rows.where("_i % _step = 0").drop("_n", "_i", "_step")
