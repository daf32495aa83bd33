"""Capture folders as tables: which tile files there are, what they form, and what does not add up.

A listing has a row per file (path, length, and head: the file's first bytes where sizes matter), as `spark.read` of the
binaryFile format gives it with `substring(content, 1, 32) as head`. All steps are groupings on (root, stem, camera).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.operators import harmonise

# Names of camera folders and tiles, the PNG signature.
TILE = r"(?i)^(.*)/(camera[\s_-]*([0-9]+))(?:/([^/]+))?/([^/]+)\.([0-9]{2,8})\.(png|exr)$"
PNG_SIGNATURE = "89504E470D0A1A0A"


def tile_files(listing: DataFrame) -> DataFrame:
    """Listed files that are tiles, in a camera's folder or one level below it, with the parts of their names."""
    # all groups by one match, held apart by the character that no path can have; what follows the match is the eighth
    rows = listing.withColumn("_p", F.split(F.regexp_replace("path", TILE, "".join(f"${i}\0" for i in range(1, 8))), "\0")).where(F.size("_p") == 8)
    part = lambda i: F.col("_p")[i - 1]
    return rows.withColumns({
        "root": part(1), "directory": part(2), "camera": part(3).cast("int"), "inner": part(4), "stem": part(5),
        "frame": part(6).cast("int"), "digits": F.length(part(6)), "format": F.lower(part(7)),
    }).drop("_p")


def tile_directories(files: DataFrame) -> DataFrame:
    """The folder that a camera's tiles are read from: its own where it holds any, else the first below it."""
    return files.groupBy("root", "camera", "directory").agg(F.min("inner").alias("inner"))


def _used(files: DataFrame) -> DataFrame:
    return files.join(tile_directories(files), ["root", "camera", "directory", "inner"], "left_semi")


def frame_files(files: DataFrame) -> DataFrame:
    """A row per root, stem, camera and frame of the folders that are used, and what its files are: the one grouping of
    the listing that all below is made from. It is written to the shared folder, as Spark would group the listing anew for
    each of its readers, which want different columns."""
    each = files.groupBy("root", "stem", "camera", "directory", "inner", "frame").agg(
        F.min("format").alias("format"), F.max("format").alias("last_format"), F.sum("length").alias("total_bytes"),
        F.min("digits").alias("least_digits"), F.max("digits").alias("digits"), F.min(F.struct("format", "path", "head")).alias("first"),
    )
    return _used(harmonise.written(each))


def png_size(head: Column) -> tuple[Column, Column]:
    """Width and height from a PNG's first 24 bytes; null where the signature is another."""
    number = lambda at: F.conv(F.hex(F.substring(head, at, 4)), 16, 10).cast("int")
    real = F.hex(F.substring(head, 1, 8)) == PNG_SIGNATURE
    return F.when(real, number(17)), F.when(real, number(21))


def camera_files(files: DataFrame) -> DataFrame:
    """A row per root, stem and camera: its files' format (the first of several), frames, bytes, paddings and tile size."""
    return _cameras(frame_files(files))


def _cameras(frames: DataFrame) -> DataFrame:
    width, height = png_size(F.min("first")["head"])
    formats = F.when(F.min("format") != F.max("last_format"), 2).otherwise(1).cast("long")
    return frames.groupBy("root", "stem", "camera").agg(
        F.min("format").alias("format"), formats.alias("formats"), F.count_distinct("frame").alias("frames"),
        F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.sum("total_bytes").alias("total_bytes"),
        F.min("least_digits").alias("least_digits"), F.max("digits").alias("digits"), width.alias("width"), height.alias("height"),
    )


def _faults():
    """Array of what does not add up in the cameras of a set."""
    differ = lambda c: F.count_distinct(c) > 1
    return F.filter(F.array(
        F.when((F.min("camera") != 1) | (F.max("camera") != F.count_distinct("camera")) | (F.count(F.lit(1)) != F.count_distinct("camera")), "numbering"),
        F.when(F.count_distinct("width", "height") > 1, "resolution"),
        F.when((F.count_distinct("width", "height") == 1) & (F.max("width") != F.max("height")), "square"),
        F.when(differ("format"), "format"), F.when(F.max("formats") > 1, "mixed"), F.when(differ("frames"), "count"),
        F.when(F.min("least_digits") != F.max("digits"), "padding"), F.when(F.count("width") < F.count(F.lit(1)), "unreadable"),
    ), lambda p: p.isNotNull())


def problems(cameras: DataFrame) -> DataFrame:
    """(root, stem, problem): numbering, resolution, square, format, mixed, count, padding, unreadable."""
    sets = cameras.groupBy("root", "stem").agg(_faults().alias("problems"))
    return sets.select("root", "stem", F.explode("problems").alias("problem"))


def shared_tile_frames(files: DataFrame) -> DataFrame:
    """Frames that all cameras of a stem have."""
    return _shared(frame_files(files))


def _shared(frames: DataFrame) -> DataFrame:
    each = frames.select("root", "stem", "camera", "frame").distinct()
    cameras = each.groupBy("root", "stem").agg(F.count_distinct("camera").alias("cameras"))
    seen = each.groupBy("root", "stem", "frame").agg(F.count(F.lit(1)).alias("n"))
    return seen.join(cameras, ["root", "stem"]).where("n = cameras").select("root", "stem", "frame")


def source_sets(files: DataFrame) -> DataFrame:
    """A row per stem: cameras, shared frames, total bytes, whether it can be used. A frame is shared if as many cameras
    have it as the set has, so frames are counted by their cameras first and the set keeps a count for each number."""
    frames = frame_files(files)
    sets = _cameras(frames).groupBy("root", "stem").agg(F.count(F.lit(1)).alias("cameras"), F.sum("total_bytes").alias("total_bytes"), F.size(_faults()).alias("faults"))
    seen = frames.groupBy("root", "stem", "frame").agg(F.count_distinct("camera").alias("cameras"))
    held = seen.groupBy("root", "stem", "cameras").agg(F.count(F.lit(1)).alias("frames"))
    rows = sets.join(held, ["root", "stem", "cameras"], "left").fillna(0, ["frames"])
    rows = rows.withColumn("usable", (F.col("cameras") >= 2) & (F.col("frames") > 0) & (F.col("faults") == 0))
    return rows.select("root", "stem", "cameras", "total_bytes", "frames", F.col("faults").cast("long").alias("faults"), "usable")


def first_usable(sets: DataFrame, roots: DataFrame) -> DataFrame:
    """The usable sets of the first root (by `place`) that has any."""
    found = sets.where("usable").join(roots, "root")
    first = found.groupBy("place").agg(F.collect_list(F.struct("root", "stem", "cameras", "frames")).alias("sets"))  # stems of one root
    return first.orderBy("place").limit(1).select(F.inline("sets"))


def candidate_roots(folders: DataFrame, base: str) -> DataFrame:
    """Folders to look in, by place: the base, its children, then its siblings; each once, children and siblings by name."""
    parent = base.rsplit("/", 1)[0]
    child = lambda top: F.col("path").startswith(top + "/") & ~F.substring(F.col("path"), len(top) + 2, 1 << 20).contains("/")
    rank = F.when(F.col("path") == base, 0).when(child(base), 1).when(child(parent), 2)
    rows = folders.select("path", rank.alias("rank")).distinct().where("rank is not null")
    return rows.select(F.col("path").alias("root"), F.struct("rank", "path").alias("place"))


def tile_path(root: str, stem: str, format: str) -> Column:
    """Path of a camera's frame, from the columns camera_dir, frame and digits; the frame keeps the set's zero padding."""
    number = F.when(F.length(F.col("frame").cast("string")) >= F.col("digits"), F.col("frame").cast("string")).otherwise(F.lpad(F.col("frame").cast("string"), F.col("digits"), F.lit("0")))
    return F.concat(F.col(root), F.lit("/"), F.col("camera_dir"), F.lit("/"), F.col(stem), F.lit("."), number, F.lit("."), F.col(format))


def first_frames(files: DataFrame, frames: int, *, common: bool = True) -> DataFrame:
    """Tiles to copy for a sample: of each camera the first so many frames, common ones of the stem or its own. The listing is
    read several times; it had better be written before."""
    files = _used(files)
    pool = _shared(files) if common else files.select("root", "stem", "camera", "frame").distinct()
    group = ["root", "stem"] if common else ["root", "stem", "camera"]
    chosen = pool.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy("frame"))).where(F.col("_n") <= frames).drop("_n")
    return files.join(chosen, chosen.columns, "left_semi").select("path", "length")


def still_to_copy(wanted: DataFrame, there: DataFrame) -> DataFrame:
    """Files that the target lacks or has in another size."""
    return wanted.join(there, ["path", "length"], "left_anti")


def survey(sets: DataFrame, rigs: DataFrame) -> DataFrame:
    """MiB a frame of each set, and without the views that its rig repeats, null where no rig has as many cameras; rigs:
    (cameras, distinct_views), a row per number of cameras."""
    per = F.col("total_bytes") / F.greatest("frames", F.lit(1)) / F.lit(1048576.0)
    return sets.join(F.broadcast(rigs), "cameras", "left").select("root", "stem", per.alias("mib"), (per * F.col("distinct_views") / F.col("cameras")).alias("distinct_mib"))


def frame_gaps(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of missing numbers in each sequence: first and last missing frame."""
    ahead = F.lead("frame").over(Window.partitionBy(*keys).orderBy("frame"))
    rows = frames.select(*keys, "frame").distinct().withColumn("ahead", ahead).where("ahead > frame + 1")
    return rows.select(*keys, (F.col("frame") + 1).alias("first_missing"), (F.col("ahead") - 1).alias("last_missing"))
