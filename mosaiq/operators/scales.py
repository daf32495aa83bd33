"""Sampling density: how many tile pixels a panorama pixel crosses, and Lanczos resampling to a delivery size.

Both are column arithmetic: a view's grid is laid out within its own row, weights are a table of a few rows a position.
Defined results: directions that no view sees have no row; equal sizes resample to the same levels; missing pixels count as
absent, so a row of weights is normalised over what it has by rule, not by what is there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.operators.geometry import half_extent

# Lobes of the kernel; latitudes that part the bands.
LOBES = 3
BANDS = ((30, "equator"), (70, "middle"), (85, "polar"), (91, "cap"))


def _on_tile(row: Column, col: Column, width: int, tile: int) -> tuple[Column, Column, Column]:
    """Continuous x and y on the view's tile of a place of the panorama, and whether the view sees it."""
    lon, lat = ((col + 0.5) / width - 0.5) * F.radians(F.lit(360.0)), (0.5 - (row + 0.5) / (width // 2)) * F.radians(F.lit(180.0))
    turn, tilt, reach = lon - F.radians("yaw"), F.radians("elevation"), half_extent(F.col("fov"))
    level = F.cos(lat) * F.cos(turn)
    ahead = level * F.cos(tilt) + F.sin(lat) * F.sin(tilt)
    u, v = F.cos(lat) * F.sin(turn) / ahead / reach, (level * F.sin(tilt) - F.sin(lat) * F.cos(tilt)) / ahead / reach
    return (u + 1) * (tile / 2), (v + 1) * (tile / 2), (ahead > 0) & (F.abs(u) <= 1) & (F.abs(v) <= 1)


def pixel_scales(views: DataFrame, width: int, tile: int, *keys: str) -> DataFrame:
    """(keys, row, col, major, minor, views): singular values of the map from a panorama pixel's step to the tile, of the view
    whose larger one is smallest, and how many views see the pixel's centre."""
    run = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    grid = views.select(*keys, "yaw", "elevation", "fov").distinct().withColumn("row", run(width // 2)).withColumn("col", run(width))
    row, col = F.col("row"), F.col("col")
    (x, y, seen), (x1, y1, _), (x2, y2, _) = (_on_tile(row + dr, col + dc, width, tile) for dr, dc in ((0, 0), (0, 1), (1, 0)))
    steps = grid.where(seen).select(*keys, "row", "col", (x1 - x).alias("a"), (x2 - x).alias("b"), (y1 - y).alias("c"), (y2 - y).alias("d"))
    mean = F.expr("(a * a + b * b + c * c + d * d) / 2")
    spread = F.sqrt(F.pow(F.expr("(a * a + b * b - c * c - d * d) / 2"), 2) + F.pow(F.expr("a * c + b * d"), 2))
    values = steps.select(*keys, "row", "col", F.struct(F.sqrt(mean + spread).alias("major"), F.sqrt(F.greatest(mean - spread, F.lit(0.0))).alias("minor")).alias("s"))
    return values.groupBy(*keys, "row", "col").agg(F.min("s").alias("s"), F.count(F.lit(1)).alias("views")).select(*keys, "row", "col", "s.major", "s.minor", "views")


def scales_by_band(scales: DataFrame, height: int, *keys: str) -> DataFrame:
    """(keys, band, least, median and largest of both values, anisotropy, minified): by distance from the equator."""
    lat = F.abs(90 - (F.col("row") + 0.5) / height * 180)
    band = F.coalesce(*[F.when(lat < most, name) for most, name in BANDS])
    three = [f(c).alias(f"{c}_{n}") for c in ("major", "minor") for f, n in ((F.min, "least"), (F.median, "median"), (F.max, "most"))]
    return scales.groupBy(*keys, band.alias("band")).agg(
        *three, F.median(F.col("major") / F.greatest("minor", F.lit(1e-9))).alias("anisotropy"), F.avg((F.col("major") > 1).cast("double")).alias("minified"))


def lanczos_weights(spark: SparkSession, size: int, new: int) -> DataFrame:
    """(to, at, w): the weights, summing to one, of the old positions that each new one takes; edges are cut off."""
    step = size / new
    wide = max(step, 1.0)
    reach = LOBES * wide
    centre = (F.col("to") + 0.5) * step
    low, high = F.greatest(F.floor(centre - reach + 0.5), F.lit(0)), F.least(F.floor(centre + reach + 0.5), F.lit(size))
    taps = spark.range(new).select(F.col("id").cast("int").alias("to")).withColumn("at", F.explode(F.sequence(low, high - 1)))
    t = (F.col("at") + 0.5 - centre) / wide * 3.141592653589793
    sinc = lambda v: F.when(F.abs(v) < 1e-12, 1.0).otherwise(F.sin(v) / v)
    taps = taps.withColumn("w", F.when(F.abs(t) < LOBES * 3.141592653589793, sinc(t) * sinc(t / LOBES)).otherwise(0.0))
    total = taps.groupBy("to").agg(F.sum("w").alias("total"))
    return taps.join(total, "to").select("to", F.col("at").cast("int").alias("at"), (F.col("w") / F.col("total")).alias("w"))


def lanczos(pixels: DataFrame, old: tuple[int, int], new: tuple[int, int], *keys: str) -> DataFrame:
    """Pixels (keys, y, x, level) of pictures of old width and height at the new ones: along rows, then along columns. The
    weights are at most 2 * LOBES * old + new rows an axis, so they are broadcast."""
    spark = pixels.sparkSession
    for axis, size, to in (("x", old[0], new[0]), ("y", old[1], new[1])):
        weights = lanczos_weights(spark, size, to).withColumnRenamed("at", axis)
        rest = [c for c in ("y", "x") if c != axis]
        moved = pixels.join(F.broadcast(weights), axis).groupBy(*keys, *rest, "to").agg(F.sum(F.col("level") * F.col("w")).alias("level"))
        pixels = moved.withColumnRenamed("to", axis)
    return pixels.select(*keys, "y", "x", "level")
