"""Operators over captures: rows (frame, direction, camera, sample, weight), one per camera that sees a direction.

All are groupings, windows and joins of built-in functions, keyed by frame or direction, so partial aggregation and AQE
apply; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Gate tiers and limits of the quality checks.
PASS_MEDIAN, PASS_MEAN, STOP_MEDIAN, STOP_MEAN = 1.0, 1.5, 2.5, 4.0
CORRECTION_LIMIT, COVERAGE_FLOOR, CUT_LEVELS, LARGE_ERROR = 32.0, 0.05, 45.0, 8.0


def capture_of_events(events: DataFrame) -> DataFrame:
    """The capture view of an event table: a frame a quarter of a day since 1970, so frames grow with the time covered, a
    direction one of 24 groups of users, a camera an event type."""
    when = F.col("ts").cast("timestamp_ntz")
    frame = F.date_diff(F.to_date(when), F.lit("1970-01-01").cast("date")) * 4 + F.floor(F.hour(when) / 6).cast("int")
    return events.groupBy(frame.alias("frame"), (F.col("user_id") % 24).cast("int").alias("direction"), F.col("event_type").alias("camera")).agg(
        F.avg("value").alias("sample"), F.count(F.lit(1)).cast("double").alias("weight")
    )


def shared_frames(capture: DataFrame) -> DataFrame:
    """Frames that every camera has."""
    cameras = capture.agg(F.count_distinct("camera").alias("cameras"))
    per = capture.groupBy("frame").agg(F.count_distinct("camera").alias("n"))
    return per.join(F.broadcast(cameras), F.col("n") == F.col("cameras")).select("frame")  # one row is broadcast


def blend(capture: DataFrame) -> DataFrame:
    """Weighted mean of each direction of each frame."""
    return capture.groupBy("frame", "direction").agg((F.sum(F.col("sample") * F.col("weight")) / F.greatest(F.sum("weight"), F.lit(1e-6))).alias("blended"))


def leader_weight(capture: DataFrame) -> DataFrame:
    """The camera of greatest weight per direction; the first name wins a tie."""
    best = F.row_number().over(Window.partitionBy("frame", "direction").orderBy(F.desc("weight"), "camera"))
    return capture.withColumn("_r", best).where("_r = 1").select("frame", "direction", F.col("camera").alias("leader"), F.col("weight").alias("leader_weight"))


def disagreement(capture: DataFrame) -> DataFrame:
    """Population deviation of the directions that two cameras or more see."""
    seen = capture.groupBy("frame", "direction").agg(F.count(F.lit(1)).alias("n"), F.avg("sample").alias("m"), F.avg(F.col("sample") * F.col("sample")).alias("q"))
    return seen.where("n >= 2").select("frame", "direction", "n", F.sqrt(F.greatest(F.col("q") - F.col("m") * F.col("m"), F.lit(0.0))).alias("deviation"))


def agreement(capture: DataFrame) -> DataFrame:
    """Per frame: median, mean, 95th percentile and share of large deviations, and the gate's verdict; a frame without any
    overlap has zeros and passes."""
    out = disagreement(capture).groupBy("frame").agg(
        F.median("deviation").alias("median"),
        F.avg("deviation").alias("mean"),
        F.percentile("deviation", F.lit(0.95)).alias("p95"),
        F.avg((F.col("deviation") > LARGE_ERROR).cast("double")).alias("large_share"),
        F.count(F.lit(1)).alias("directions"),
        F.max("n").alias("max_contributors"),
    )
    frames = capture.groupBy("frame", "direction").count().groupBy("frame").agg(F.max("count").alias("most"))
    zeros = {"median": 0.0, "mean": 0.0, "p95": 0.0, "large_share": 0.0, "directions": 0}
    out = frames.join(out, "frame", "left").fillna(zeros).withColumn("max_contributors", F.coalesce("max_contributors", "most")).drop("most")
    stop = (F.col("median") > STOP_MEDIAN) | (F.col("mean") > STOP_MEAN)
    fine = (F.col("median") <= PASS_MEDIAN) & (F.col("mean") <= PASS_MEAN)
    return out.withColumn("verdict", F.when(stop, "FAIL").when(fine, "PASS").otherwise("WARN"))


def overlap_fraction(capture: DataFrame) -> DataFrame:
    seen = capture.groupBy("frame", "direction").count()
    return seen.groupBy("frame").agg(F.avg((F.col("count") >= 2).cast("double")).alias("overlap_fraction"))


def harmonise_residual(capture: DataFrame, *, cell: int = 6) -> DataFrame:
    """Weighted mean residual against the blend per camera and cell of directions, clamped; thin cells fall out."""
    residual = capture.join(blend(capture), ["frame", "direction"]).withColumn("cell", F.floor(F.col("direction") / cell).cast("int"))
    cells = residual.groupBy("camera", "cell").agg(F.sum((F.col("sample") - F.col("blended")) * F.col("weight")).alias("s"), F.sum("weight").alias("w"))
    cells = cells.withColumn("best", F.max("w").over(Window.partitionBy("camera"))).where(F.col("w") > COVERAGE_FLOOR * F.col("best"))
    return cells.select("camera", "cell", F.greatest(F.least(F.col("s") / F.col("w"), F.lit(CORRECTION_LIMIT)), F.lit(-CORRECTION_LIMIT)).alias("correction"))


def wrap_seam_error(capture: DataFrame, *, last: int = 23) -> DataFrame:
    """Absolute difference of the first and the last direction's blend, per frame that has both."""
    ends = blend(capture).where(F.col("direction").isin(0, last)).groupBy("frame").pivot("direction", [0, last]).agg(F.first("blended"))
    return ends.where(f"`0` is not null and `{last}` is not null").select("frame", F.abs(F.col("0") - F.col(str(last))).alias("seam_error"))


def temporal_step(capture: DataFrame) -> DataFrame:
    """Per camera and direction: variance over frames and the biggest step between successive frames."""
    order = Window.partitionBy("camera", "direction").orderBy("frame")
    steps = capture.withColumn("step", F.abs(F.col("sample") - F.lag("sample").over(order)))
    return steps.groupBy("camera", "direction").agg(F.var_pop("sample").alias("variance"), F.max("step").alias("biggest_step"))


def frame_diff_cut(capture: DataFrame, *, levels: float = CUT_LEVELS) -> DataFrame:
    """Mean absolute difference of each frame and the next job frame; over `levels` it is a cut."""
    order = Window.partitionBy("direction").orderBy("frame")
    pairs = blend(capture).withColumn("next_frame", F.lead("frame").over(order)).withColumn("d", F.abs(F.lead("blended").over(order) - F.col("blended")))
    out = pairs.where("d is not null").groupBy("frame", "next_frame").agg(F.avg("d").alias("difference"))
    return out.withColumn("is_cut", F.col("difference") > levels)


def coverage_by_band(capture: DataFrame, *, bands: int = 4) -> DataFrame:
    """Contributors by camera and band of directions, with totals."""
    width = 24 // bands
    return capture.withColumn("band", F.floor(F.col("direction") / width).cast("int")).rollup("camera", "band").agg(F.count(F.lit(1)).alias("contributors"), F.sum("weight").alias("weight"))


def level_bins(capture: DataFrame, *, width: float = 10.0) -> DataFrame:
    """Bias against the blend by bin of the blended level."""
    rows = capture.join(blend(capture), ["frame", "direction"]).withColumn("level_bin", F.floor(F.col("blended") / width).cast("int"))
    return rows.groupBy("level_bin").agg((F.round(F.avg(F.col("sample") - F.col("blended")), 9) + 0.0).alias("bias"), F.count(F.lit(1)).alias("n"))
