"""Frame sequences: runs, segments, resuming and doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _positions(frames: DataFrame) -> DataFrame:
    """Frames by group with their position from 0; a group is one job's frames, which bounds its window."""
    return frames.distinct().withColumn("position", F.row_number().over(Window.partitionBy("job").orderBy("frame")) - 1)


def contiguous_tail(frames: DataFrame) -> DataFrame:
    """First and last frame of each job's final consecutive run."""
    islands = _positions(frames).groupBy("job", (F.col("frame") - F.col("position")).alias("island")).agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"))
    return islands.groupBy("job").agg(F.max_by("first_frame", "last_frame").alias("first_frame"), F.max("last_frame").alias("last_frame"))


def segment_plan(frames: DataFrame, *, length: int = 30) -> DataFrame:
    """Tumbling segments by position."""
    return _positions(frames).groupBy("job", F.floor(F.col("position") / length).cast("int").alias("segment")).agg(
        F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.count(F.lit(1)).alias("frames")
    )


def pending_frames(frames: DataFrame, done: DataFrame) -> DataFrame:
    """Frames that no committed result has yet."""
    return frames.distinct().join(done, ["job", "frame"], "left_anti")


def interleave_2x(frames: DataFrame) -> DataFrame:
    """Delivered slots at twice the rate: each frame, then the pair with its next one; the last repeats."""
    ahead = F.lead("frame").over(Window.partitionBy("job").orderBy("frame"))
    rows = _positions(frames).withColumn("ahead", ahead)
    slots = F.array(
        F.struct((F.col("position") * 2).alias("slot"), F.col("frame").alias("before"), F.col("frame").alias("after")),
        F.struct((F.col("position") * 2 + 1).alias("slot"), F.col("frame").alias("before"), F.coalesce("ahead", "frame").alias("after")),
    )
    return rows.select("job", F.explode(slots).alias("s")).select("job", "s.slot", "s.before", "s.after")


def sampled_gate(frames: DataFrame, *, every: int = 10) -> DataFrame:
    """Frames whose position the gate looks at."""
    return _positions(frames).where(F.col("position") % every == 0).select("job", "frame")


def moving_mean(times: DataFrame, *, key: str, order: list[str], value: str, rows: int = 20) -> DataFrame:
    """Mean of each row's value and the rows - 1 before it within its key."""
    recent = Window.partitionBy(key).orderBy(*order).rowsBetween(1 - rows, 0)
    return times.select(key, *order, F.avg(value).over(recent).alias("recent_mean"))


def segment_names(plan: DataFrame) -> DataFrame:
    """File names of planned segments."""
    return plan.select("job", "segment", F.format_string("%s.%04d.%d-%d.mp4", "job", "segment", "first_frame", "last_frame").alias("name"))
