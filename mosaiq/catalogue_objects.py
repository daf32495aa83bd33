"""Queries over small objects: pictures drawn from the vectors with planted motions, and SQL that knows what was planted."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from mosaiq.operators import tracking

SIDE = 96
SCALE = tracking.Scale(object=3, surround=6, half=5, radius=8, flat=6.0, moved=0.85)
PAIR = (1.0, -2.0)
#: Vectors whose pictures are drawn together.
DRAWN = 16
_SHAPE = "clip long, camera int, frame long, width int, luma array<float>"


def _pictures(spark, sf_dir, blend: float = 1.0):
    """Frame 20 c + t of the vectors is frame t of clip c: two blobs on a faint texture, which swing by the clip's step from
    frame to frame (-1, 0, 1, 2 steps of the middle, then again), seen by camera 2 a row lower and two columns to the left."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("long"), "embedding")
    line = np.arange(SIDE)

    def run(batches):
        for batch in (b.slice(i, DRAWN) for b in batches for i in range(0, b.num_rows, DRAWN)):
            columns = [[], [], [], [], []]
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                clip, t = divmod(k, 20)
                step = np.array([clip % 5 - 2, clip // 5 % 5 - 2]) * 0.5
                for camera in (1, 2):
                    luma = 100 + 0.5 * np.tile(np.reshape(np.clip(v, -2, 2), (8, 8)), (SIDE // 8, SIDE // 8))
                    for i, (cy, cx) in enumerate(((36, 36), (60, 60))):
                        cy, cx = np.array([cy, cx]) + step * (t % 4 - 1) * (1 if i else -1) + (np.array(PAIR) if camera == 2 else 0)
                        luma = luma + blend * (60 if i else -50) * np.exp(-((line - cy) ** 2) / 3.0)[:, None] * np.exp(-((line - cx) ** 2) / 3.0)
                    for column, value in zip(columns, (clip, camera, t, SIDE, luma.ravel().astype(np.float32))):
                        column.append(value)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.float32())))], [c.split()[0] for c in _SHAPE.split(", ")])

    return e.mapInArrow(run, _SHAPE)


def _halves(c):
    return F.round(F.col(c) * 2) / 2 + 0.0


def _blob():
    return F.when(F.col("sign") > 0, 1).otherwise(0).alias("blob")


def _objects(s, d):
    return tracking.objects(_pictures(s, d), "clip", scale=SCALE).select("clip", "camera", "frame", _blob()).distinct()


def _movers(s, d):
    rows = tracking.moving_objects(_pictures(s, d), "clip", scale=SCALE)
    return rows.select("clip", "camera", "frame", _blob(), _halves("vy").alias("vy"), _halves("vx").alias("vx")).distinct()


def _survival(s, d):
    found = tracking.objects(_pictures(s, d), "clip", scale=SCALE).where("camera = 1").drop("camera")
    rows = tracking.survival(found, _pictures(s, d, 0.6).where("camera = 1").drop("camera"), "clip", scale=SCALE)
    return rows.select("clip", "frame", F.round("median_kept", 1).alias("median_kept"), F.round("worst_kept", 1).alias("worst_kept"), "under_70")


def _report(s, d):
    pictures = _pictures(s, d)
    movers = tracking.moving_objects(pictures, "clip", scale=SCALE)
    pairs = s.createDataFrame([(1, 2)], "a int, b int")
    rows = tracking.pair_report(tracking.correspondences(movers, pictures, pairs, "clip", scale=SCALE), "clip", scale=SCALE)
    return rows.select("clip", "a", "b", _halves("static_dy").alias("static_dy"), _halves("static_dx").alias("static_dx"), _halves("residual").alias("residual"), "found_100", "shape_failures")


QUERIES = {"small_objects": _objects, "moving_objects": _movers, "object_survival": _survival, "correspondence": _report}

_PLANTED = """WITH planted AS (SELECT vec_id // 20 AS clip, camera, vec_id % 20 AS frame, blob, (CASE WHEN vec_id % 4 = 0 THEN -3 ELSE 1 END) * (2 * blob - 1) * 0.5::DOUBLE AS swing,
  vec_id // 20 % 5 - 2 AS sy, vec_id // 100 % 5 - 2 AS sx FROM embeddings, (VALUES (1), (2)) c(camera), (VALUES (0), (1)) b(blob))
"""
ORACLE_SQL = {
    "small_objects": _PLANTED + "SELECT clip, camera, frame, blob FROM planted",
    "moving_objects": _PLANTED + "SELECT clip, camera, frame, blob, swing * sy + 0.0::DOUBLE AS vy, swing * sx + 0.0::DOUBLE AS vx FROM planted WHERE frame > 0 AND sqrt(sy * sy + sx * sx) * abs(swing) >= 0.85",
    "object_survival": _PLANTED + "SELECT DISTINCT clip, frame, 0.6::DOUBLE AS median_kept, 0.6::DOUBLE AS worst_kept, 1.0::DOUBLE AS under_70 FROM planted",
    "correspondence": _PLANTED + """SELECT clip, 1 AS a, 2 AS b, 1.0::DOUBLE AS static_dy, -2.0::DOUBLE AS static_dx, 0.0::DOUBLE AS residual, 1.0::DOUBLE AS found_100, 0 AS shape_failures
FROM planted WHERE frame > 0 AND sqrt(sy * sy + sx * sx) * abs(swing) >= 0.85 GROUP BY clip""",
}
