"""Camera rigs as tables (rig, camera, yaw, elevation, fov): the registered ones, lookups, matching and pairing.

Registered rigs have at most `MOST_CAMERAS` rows in all, so they are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Five sectors of 72 degrees; elevations of a sector's files, the fourth looking from the next sector.
SECTORS, STEP, TILT, FOV = 5, 72.0, 45.0, 90.0
ANGLE_DECIMALS = 3
MOST_CAMERAS = 64
MOST_WIDTH = 3840


def twenty_file_rig(spark: SparkSession) -> DataFrame:
    """Twenty files of fifteen views: each sector up, down, level, and the next sector's up again."""
    slot, sector = F.col("id") % 4, F.floor(F.col("id") / 4)
    yaw = F.when(slot == 3, (sector + 1) % SECTORS).otherwise(sector) * STEP
    elevation = F.when(slot == 1, -TILT).when(slot == 2, 0.0).otherwise(TILT)
    return spark.range(4 * SECTORS).select(F.lit("twenty").alias("rig"), (F.col("id") + 1).cast("int").alias("camera"), yaw.cast("double").alias("yaw"), elevation.alias("elevation"), F.lit(FOV).alias("fov"))


def fifteen_file_rig(spark: SparkSession) -> DataFrame:
    """The twenty-file rig's distinct views in file order, numbered anew."""
    first = twenty_file_rig(spark).groupBy("yaw", "elevation", "fov").agg(F.min("camera").alias("_file"))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_file"))  # at most twenty rows
    return first.select(F.lit("fifteen").alias("rig"), place.cast("int").alias("camera"), "yaw", "elevation", "fov")


def registered(spark: SparkSession) -> DataFrame:
    return twenty_file_rig(spark).unionByName(fifteen_file_rig(spark))


def fold_yaw(yaw: Column) -> Column:
    return F.pmod(yaw, F.lit(360.0))


def native_width(tile: Column, fov: Column) -> Column:
    """Even panorama width of a tile's own density; null where the field of view is not inside (0, 180)."""
    width = F.rint(tile * 360.0 / fov).cast("long")
    return F.when((fov > 0) & (fov < 180) & (tile >= 1), width + width % 2)


def analysis_width(tile: Column, fov: Column) -> Column:
    """The native width, at most MOST_WIDTH; null where there is no native width."""
    width = native_width(tile, fov)
    return F.when(width > MOST_WIDTH, F.lit(MOST_WIDTH).cast("long")).otherwise(width)


def rig_of_count(counts: DataFrame, rigs: DataFrame) -> DataFrame:
    """The registered rig of each set's number of cameras; null where none is."""
    known = rigs.groupBy("rig").agg(F.count(F.lit(1)).alias("cameras"))
    return counts.join(F.broadcast(known), "cameras", "left")


def _angles(views: DataFrame, *keys: str) -> DataFrame:
    key = (F.pmod(F.round("yaw", ANGLE_DECIMALS), F.lit(360.0)).alias("_y"), F.round("elevation", ANGLE_DECIMALS).alias("_e"), F.round("fov", ANGLE_DECIMALS).alias("_f"))
    return views.select(*keys, *key).groupBy(*keys, "_y", "_e", "_f").agg(F.count(F.lit(1)).alias("_n"))


def matching_rigs(captures: DataFrame, rigs: DataFrame) -> DataFrame:
    """(capture, rig): captures whose views are a registered rig's as multisets, whatever their order."""
    want = _angles(rigs, "rig")
    size = want.groupBy("rig").agg(F.count(F.lit(1)).alias("_kinds"))
    have = _angles(captures, "capture")
    total = have.groupBy("capture").agg(F.count(F.lit(1)).alias("_kinds"))
    same = have.join(F.broadcast(want), ["_y", "_e", "_f", "_n"]).groupBy("capture", "rig").agg(F.count(F.lit(1)).alias("_same"))
    return same.join(total, "capture").join(F.broadcast(size), ["rig", "_kinds"]).where("_same = _kinds").select("capture", "rig")


def horizon_pairs(views: DataFrame, *keys: str) -> DataFrame:
    """(a, b): each tilted camera with the level one of equal yaw; repeated views count once, by their first camera."""
    own = views.groupBy(*keys, fold_yaw(F.col("yaw")).alias("yaw"), "elevation").agg(F.min("camera").alias("camera"))
    level = own.where("elevation = 0").select(*keys, "yaw", F.col("camera").alias("b"))
    return own.where(F.abs("elevation") == TILT).join(level, [*keys, "yaw"]).select(*keys, F.col("camera").alias("a"), "b")


def ring_pairs(views: DataFrame, *keys: str) -> DataFrame:
    """(a, b): each level camera with the next by yaw, the last with the first."""
    own = views.where("elevation = 0").groupBy(*keys, fold_yaw(F.col("yaw")).alias("yaw")).agg(F.min("camera").alias("camera"))
    ring = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("yaw")
    first = F.first("camera").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return own.select(*keys, F.col("camera").alias("a"), F.coalesce(F.lead("camera").over(ring), first).alias("b"))
