"""Sphere geometry: directions of an equirectangular grid, which views see them, and blending tiles through that plan.

A rig is a table (camera, yaw, elevation, fov) in degrees, one row a camera. It is broadcast only up to `MOST_VIEWS` rows;
a larger one is refused. Everything else is column arithmetic, so the plan of an 8K grid is made where it is used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.operators import sampling

# The smallest blending weight, and the luminance break of the sRGB curve.
LEAST_WEIGHT = 1e-6
SRGB_BREAK, SRGB_SLOPE, SRGB_GAIN, SRGB_OFFSET, SRGB_POWER = 0.0031308, 12.92, 1.055, 0.055, 2.4
MOST_VIEWS = 256
MOST_SPOTS = 1 << 20
#: Tiles whose samples a task sums: a hundred frames or so.
TILES_A_TASK = 1 << 12


def directions(spark: SparkSession, width: int, height: int) -> DataFrame:
    """Unit vectors (vx forward, vy, vz up) of all pixel centres, by row-major out_index."""
    if width < 2 or height < 2:
        raise ValueError(f"a grid needs two rows and columns, not {width} by {height}")
    longitude = ((F.col("out_index") % width + 0.5) / width - 0.5) * F.radians(F.lit(360.0))
    latitude = (0.5 - (F.floor(F.col("out_index") / width) + 0.5) / height) * F.radians(F.lit(180.0))
    grid = spark.range(width * height).withColumnRenamed("id", "out_index").withColumns({"lon": longitude, "lat": latitude})
    return grid.select("out_index", (F.cos("lat") * F.cos("lon")).alias("vx"), (F.cos("lat") * F.sin("lon")).alias("vy"), F.sin("lat").alias("vz"))


def half_extent(fov):
    """tan(fov / 2) of a field of view in degrees; one outside (0, 180) ends the query."""
    return F.when((fov > 0) & (fov < 180), F.tan(F.radians(fov) / 2)).otherwise(F.raise_error(F.format_string("a field of view of %s degrees", fov.cast("string"))))


def rotations(views: DataFrame) -> DataFrame:
    """Camera-to-world matrices: turned by yaw after a tilt that looks up for positive elevation."""
    y, e = F.radians("yaw"), F.radians("elevation")
    rows = ((F.cos(y) * F.cos(e), -F.sin(y), -F.cos(y) * F.sin(e)), (F.sin(y) * F.cos(e), F.cos(y), -F.sin(y) * F.sin(e)), (F.sin(e), F.lit(0.0), F.cos(e)))
    return views.select("camera", *[c.alias(f"m{i}{j}") for i, row in enumerate(rows) for j, c in enumerate(row)])


def tile_rays(views: DataFrame, size: int) -> DataFrame:
    """Unit rays (rx forward, ry aside, rz up) of a tile's pixels, in camera axes."""
    plane = lambda i: (i + 0.5) / size * 2 - 1
    rows = views.select("camera", half_extent(F.col("fov")).alias("h"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size * size - 1).cast("long"))).alias("pixel"))
    y, z = plane(F.col("pixel") % size) * F.col("h"), -plane(F.floor(F.col("pixel") / size)) * F.col("h")
    n = F.sqrt(1 + y * y + z * z)
    return rows.select("camera", "pixel", (1 / n).alias("rx"), (y / n).alias("ry"), (z / n).alias("rz"))


def contributors(grid: DataFrame, views: DataFrame, mirrored: bool = True) -> DataFrame:
    """(out_index, camera, u, v): where on a view's image plane, from -1 to 1 on both axes, a direction falls; edges count.
    Tiles are mirrored as captures deliver them; for others u has the other sign."""
    if views.limit(MOST_VIEWS + 1).count() > MOST_VIEWS:
        raise ValueError(f"a rig has at most {MOST_VIEWS} views")
    y, e, half = F.radians("yaw"), F.radians("elevation"), half_extent(F.col("fov"))
    axes = views.select(
        "camera", half.alias("half"), F.cos(y).alias("cy"), F.sin(y).alias("sy"), F.cos(e).alias("ce"), F.sin(e).alias("se")
    )
    level = F.col("vx") * F.col("cy") + F.col("vy") * F.col("sy")
    ahead = level * F.col("ce") + F.col("vz") * F.col("se")
    aside = F.col("vy") * F.col("cy") - F.col("vx") * F.col("sy")
    below = level * F.col("se") - F.col("vz") * F.col("ce")
    return (
        grid.crossJoin(F.broadcast(axes)).where(ahead > 0)
        .select("out_index", "camera", ((aside if mirrored else -aside) / ahead / F.col("half")).alias("u"), (below / ahead / F.col("half")).alias("v"))
        .where("abs(u) <= 1 and abs(v) <= 1")
    )


def feather(power: float) -> Column:
    """Weight of a contribution from its distance to the tile's edge."""
    edge = F.least(1 - F.abs("u"), 1 - F.abs("v"))
    return (edge * edge if power == 2 else F.pow(edge, F.lit(float(power)))) + LEAST_WEIGHT


def warp_plan(grid: DataFrame, views: DataFrame, tile: int, power: float = 2, mirrored: bool = True) -> DataFrame:
    """(out_index, camera, source, weight): the nearest tile pixel and the feathered weight of each contribution."""
    near = lambda c: F.least(F.floor((F.col(c) + 1) * (tile / 2)), F.lit(tile - 1)).cast("int")
    return contributors(grid, views, mirrored).select("out_index", "camera", (near("v") * tile + near("u")).alias("source"), feather(power).alias("weight"))


def _few(plan: DataFrame) -> DataFrame:
    """A plan, to be broadcast if it has up to `MOST_SPOTS` rows, counted before."""
    return F.broadcast(plan) if plan.limit(MOST_SPOTS + 1).count() <= MOST_SPOTS else plan


def _by_frame(tiles: DataFrame) -> DataFrame:
    """Tiles dealt by frame, `TILES_A_TASK` a task or fewer, so that a broadcast plan's samples are summed where they are read:
    only tiles are shuffled, and a task's sums do not grow with the table."""
    n = max(int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-tiles.count() // TILES_A_TASK))
    return tiles.repartition(n, "frame")


def gather(plan: DataFrame, tiles: DataFrame) -> DataFrame:
    """The blended level of each direction, from tiles (frame, camera, pixels); rounded half to even as `level`."""
    seen = _by_frame(tiles).join(_few(plan), "camera").withColumn("sample", F.get("pixels", F.col("source")).cast("double")).where("sample is not null")
    out = seen.groupBy("frame", "out_index").agg(
        (F.sum(F.col("sample") * F.col("weight")) / F.greatest(F.sum("weight"), F.lit(LEAST_WEIGHT))).alias("blended"), F.count(F.lit(1)).alias("contributors")
    )
    return out.withColumn("level", F.rint(F.least(F.greatest("blended", F.lit(0.0)), F.lit(255.0))).cast("int"))


#: How a tile is read at a place between its pixels.
SAMPLERS = {"bilinear": sampling.bilinear, "catmullrom": sampling.bicubic}


def samples(seen: DataFrame, tiles: DataFrame, tile: int, sampler: str = "bilinear", power: float = 2, channels: tuple = ("pixels",)) -> DataFrame:
    """(frame, out_index, camera, weight, a level a channel): what each contributor reads between its tile's pixels.

    tiles: (frame, camera, an array a channel); a contribution with a null level is none. Up to `MOST_SPOTS` contributors
    are broadcast, counted before, so that tiles stay where they are; more are joined by camera."""
    place = lambda c: sampling.pixel_position(F.col(c), tile)
    # a row of its own for the place, so that its expressions are not written out again for every tap
    spots = seen.select("out_index", "camera", F.inline(F.array(F.struct(place("u").alias("px"), place("v").alias("py"), feather(power).alias("weight")))))
    spots = _few(spots)
    level = lambda c: SAMPLERS[sampler](F.col(c), tile, F.col("px"), F.col("py")).cast("double")
    rows = tiles.select("frame", "camera", *channels).join(spots, "camera").select("frame", "out_index", "camera", "weight", *[level(c).alias(c) for c in channels])
    return rows.where(" and ".join(f"`{c}` is not null" for c in channels))


def gather_sampled(seen: DataFrame, tiles: DataFrame, tile: int, sampler: str = "bilinear", power: float = 2) -> DataFrame:
    """As `gather`, from contributors, with tiles read between their pixels: (frame, out_index, blended, contributors)."""
    blended = F.sum(F.col("pixels") * F.col("weight")) / F.greatest(F.sum("weight"), F.lit(LEAST_WEIGHT))
    return samples(seen, _by_frame(tiles), tile, sampler, power).groupBy("frame", "out_index").agg(blended.alias("blended"), F.count(F.lit(1)).alias("contributors"))


def _orientation(views: DataFrame) -> DataFrame:
    return views.withColumns({"_yaw": F.pmod(F.bround("yaw", 3), F.lit(360.0)), "_elevation": F.bround("elevation", 3)})


def orientation_groups(views: DataFrame) -> DataFrame:
    """Cameras that look the same way, by their first one."""
    groups = _orientation(views).groupBy("_yaw", "_elevation").agg(F.min("camera").alias("first_camera"), F.count(F.lit(1)).alias("cameras"))
    return groups.select("first_camera", F.col("_yaw").alias("yaw"), F.col("_elevation").alias("elevation"), "cameras")


def duplicate_views(views: DataFrame) -> DataFrame:
    """Cameras that repeat the orientation of an earlier one."""
    return views.select("camera").join(orientation_groups(views).select(F.col("first_camera").alias("camera")), "camera", "left_anti")


def srgb_encode(linear):
    """Display level from 0 to 255 of a linear value; below zero and NaN 0, from one 255, null null."""
    curve = F.when(linear <= SRGB_BREAK, linear * SRGB_SLOPE).otherwise(SRGB_GAIN * F.pow(linear, F.lit(1 / SRGB_POWER)) - SRGB_OFFSET)
    return F.when(linear.isNull(), None).when(F.isnan(linear) | (linear <= 0), 0.0).when(linear >= 1, 255.0).otherwise(curve * 255)
