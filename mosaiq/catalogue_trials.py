"""Queries of hold-out scores, fitted views and the doubling of a stream, and their SQL; planted turns are known to it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from mosaiq.catalogue_frames import shared_folder
from mosaiq.operators import geometry, holdout, rigfit, stream

VIEW = holdout.View(width=16, height=8, block=2, wrap=45.0)
#: Days from 1990 on that orders are cut into parts at; earlier and later ones are in the first and last part.
FIRST_DAY, DAYS = 700, 2500
TILE, WIDTH, HEIGHT, WAVES = 12, 180, 90, 10
SWEEPS = [
    rigfit.Sweep(fov=(72.0, 84.0, 96.0, 108.0), yaw=tuple(12.0 * i for i in range(30)), elevation=tuple(12.0 * i for i in range(-5, 6)), roll=(-6.0, 0.0, 6.0)),
    rigfit.Sweep.around(4.0, 3),
    rigfit.Sweep.around(1.0, 4),
    rigfit.Sweep.around(1.0, 4),
]


def _round(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _frames(s, d):
    """Vectors 2 f and 2 f + 1 are the left and right half of frame f; each clip has twenty frames."""
    k = F.col("vec_id").cast("long")
    level = F.transform("embedding", lambda v: F.least(F.greatest(F.floor(128 + 60 * v.cast("double")), F.lit(0)), F.lit(255)).cast("int"))
    halves = s.read.parquet(f"{d}/embeddings.parquet").select(F.floor(k / 40).alias("clip"), (F.floor(k / 2) % 20).alias("frame"), (k % 2).alias("side"), level.alias("levels"))
    whole = halves.groupBy("clip", "frame").agg(*[F.max(F.when(F.col("side") == i, F.col("levels"))).alias(f"_{i}") for i in (0, 1)]).where("_0 is not null and _1 is not null")
    rows = [F.slice(f"_{i % 2}", i // 2 * 8 + 1, 8) for i in range(16)]
    return whole.select("clip", "frame", F.concat(*rows).alias("pixels"))


def _gaps(s, d):
    frames = _frames(s, d)
    return holdout.differences(holdout.predicted(frames, ["clip"]), frames, ["clip"], VIEW)


def _planted(g):
    """The turn of group g, in whole degrees, as the finest sweep has them."""
    return {"fov": 80.0 + g * 7 % 21, "yaw": g * 37 % 360 + 0.0, "elevation": g * 11 % 81 - 40.0, "roll": g * 5 % 17 - 8.0}


def _shown(fov, yaw, elevation, roll, i):
    """The panorama's pixel that pixel i of a tile shows, for a view turned by roll about its axis, then up, then by yaw."""
    half, r, e, y = geometry.half_extent(fov), F.radians(roll), F.radians(elevation), F.radians(yaw)
    plane = lambda at: ((at + 0.5) / TILE * 2 - 1) * half
    a, b = plane(i % TILE), -plane(F.floor(i / TILE))
    aside, up = a * F.cos(r) - b * F.sin(r), a * F.sin(r) + b * F.cos(r)
    ahead, above = F.cos(e) - up * F.sin(e), F.sin(e) + up * F.cos(e)
    longitude = F.atan2(ahead * F.sin(y) + aside * F.cos(y), ahead * F.cos(y) - aside * F.sin(y))
    latitude = F.atan2(above, F.sqrt(ahead * ahead + aside * aside))
    cell = lambda turn, n: F.least(F.greatest(F.floor(turn * n), F.lit(0)), F.lit(n - 1))
    return (cell(0.5 - latitude / F.pi(), HEIGHT) * WIDTH + cell(longitude / (2 * F.pi()) + 0.5, WIDTH)).cast("int")


def _turned(s, d):
    """Ten vectors make a panorama of ten plane waves through the sphere; its tile is what a view turned as planted sees."""
    n = int(s.conf.get("spark.sql.shuffle.partitions"))  # few bytes and much work: as many tasks as the session has
    e = s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.floor(F.col("vec_id") / WAVES).cast("long").alias("group"), F.slice("embedding", 1, 4).alias("v"))
    waves = e.repartition(n, "group").groupBy("group").agg(F.sort_array(F.collect_list(F.struct("vec_id", "v"))).alias("w")).select("group", F.flatten("w.v").alias("waves"))
    lon, lat = (((np.arange(WIDTH) + 0.5) / WIDTH - 0.5) * 2 * np.pi)[None, :, None], ((0.5 - (np.arange(HEIGHT) + 0.5) / HEIGHT) * np.pi)[:, None, None]

    def draw(frames):
        for frame in frames:
            for group, flat in zip(frame["group"], frame["waves"]):
                x, y, z, at = np.reshape(np.asarray(flat, float), (-1, 4)).T
                x, y, z = np.array((x, y, z)) * 4 / np.sqrt(x * x + y * y + z * z)
                level = np.cos(np.cos(lat) * (np.cos(lon) * x + np.sin(lon) * y) + np.sin(lat) * z + 3 * at).sum(2)
                yield pd.DataFrame({"group": [group], "panorama": [level.ravel()]})

    spheres = waves.mapInPandas(draw, "group long, panorama array<double>")
    turn = list(_planted(F.col("group")).values())
    seen = F.transform(F.sequence(F.lit(0), F.lit(TILE * TILE - 1)), lambda i: F.get("panorama", _shown(*turn, i)))
    return spheres.select("group", seen.alias("pixels"), "panorama")


def _fitted(s, d):
    found = rigfit.fitted(_turned(s, d), "group", SWEEPS, TILE, WIDTH, HEIGHT)
    return _round(found.withColumn("yaw", F.pmod("yaw", F.lit(360.0)))).select("group", *rigfit.TURN, "score")


def _ranged(s, d, parts: int):
    """The order days of customers as frames, in so many ranges of days, and a last part that closes every job."""
    day = F.date_diff(F.to_date("o_orderdate"), F.lit("1990-01-01").cast("date")).cast("long")
    rows = s.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").cast("long").alias("job"), day.alias("frame"), F.lit(False).alias("done"))
    part = F.least(F.greatest(F.floor((F.col("frame") - FIRST_DAY) * parts / DAYS), F.lit(0)), F.lit(parts - 1))
    for i in range(parts):
        yield rows.where(part == i)
    yield rows.select("job", F.lit(None).cast("long").alias("frame"), F.lit(True).alias("done")).distinct()


def _slots(s, d, parts: int = 3):
    """Every part is taken by a run of its own, which finds the state that the one before left in the shared folder."""
    folder = shared_folder(s, "stream")
    for rows in _ranged(s, d, parts):
        rows.write.mode("append").parquet(f"{folder}/in")
        frames = s.readStream.schema("job long, frame long, done boolean").parquet(f"{folder}/in")
        stream.started(frames, folder).awaitTermination()
    return stream.doubled(s, folder)


QUERIES = {
    "holdout_frames": lambda s, d: _round(holdout.frame_scores(_gaps(s, d), ["clip"], VIEW)),
    "holdout_methods": lambda s, d: _round(holdout.method_scores(_gaps(s, d), ["clip"], VIEW)),
    "fitted_views": _fitted,
    "stream_slots": _slots,
}

_GAPS = """WITH levels AS (SELECT vec_id // 40 AS clip, vec_id // 2 % 20 AS frame, (i // 8) AS y, vec_id % 2 * 8 + i % 8 AS x, least(greatest(floor(128 + 60 * CAST(embedding[i + 1] AS DOUBLE)), 0), 255) AS v
  FROM embeddings, range(64) r(i) QUALIFY count(*) OVER (PARTITION BY vec_id // 2, i) = 2),
pairs AS (SELECT t.*, a.v AS a, b.v AS b, 'blend' AS method FROM levels t JOIN levels a ON a.clip = t.clip AND a.frame = t.frame - 1 AND a.y = t.y AND a.x = t.x JOIN levels b ON b.clip = t.clip AND b.frame = t.frame + 1 AND b.y = t.y AND b.x = t.x WHERE t.frame % 2 = 1),
gaps AS (SELECT clip, method, frame, y, x, abs(v - floor((a + b + 1) / 2)) AS gap, radians((0.5 - (y + 0.5::DOUBLE) / 8) * 180) AS lat FROM pairs UNION ALL SELECT clip, 'repeat', frame, y, x, abs(v - a), radians((0.5 - (y + 0.5::DOUBLE) / 8) * 180) FROM pairs),
blocks AS (SELECT clip, method, frame, CAST((y - 1) // 2 * 2 + 1 AS INTEGER) AS worst_row, CAST(x // 2 * 2 AS INTEGER) AS worst_column, avg(gap) AS value FROM gaps WHERE y BETWEEN 1 AND 6 GROUP BY ALL),
frames AS (SELECT clip, method, frame, sum(gap * cos(lat)) / sum(cos(lat)) AS weighted, avg(gap) FILTER (abs(lat) < radians(30)) AS equator, avg(gap) FILTER (abs(lat) >= radians(30) AND abs(lat) < radians(60)) AS middle,
  avg(gap) FILTER (lat >= radians(60)) AS zenith, avg(gap) FILTER (lat <= -radians(60)) AS nadir, avg(gap) FILTER (y BETWEEN 1 AND 6 AND (x < 2 OR x >= 14)) AS wrap, avg(gap) FILTER (y BETWEEN 1 AND 6 AND x BETWEEN 2 AND 13) AS rest,
  quantile_cont(gap, 0.999) FILTER (y BETWEEN 1 AND 6) AS p999 FROM gaps GROUP BY ALL)
"""
_NAMES = ("weighted", "equator", "middle", "zenith", "nadir", "wrap", "rest", "p999")
ORACLE_SQL = {
    "holdout_frames": _GAPS + f""", worst AS (SELECT clip, method, frame, round(value, 6) AS worst, worst_row, worst_column FROM blocks QUALIFY row_number() OVER (PARTITION BY clip, method, frame ORDER BY value DESC, worst_row, worst_column) = 1)
SELECT clip, method, frame, {", ".join(f"round({n}, 6) AS {n}" for n in _NAMES)}, worst, worst_row, worst_column FROM frames JOIN worst USING (clip, method, frame)""",
    "holdout_methods": _GAPS + f""", tails AS (SELECT clip, method, round(quantile_cont(value, 0.99), 6) AS block_p99, round(max(value), 6) AS block_most FROM blocks GROUP BY ALL)
SELECT clip, method, count(*) AS frames, {", ".join(f"round(avg({n}), 6) AS {n}" for n in _NAMES)}, any_value(block_p99) AS block_p99, any_value(block_most) AS block_most FROM frames JOIN tails USING (clip, method) GROUP BY clip, method""",
    "fitted_views": """SELECT g AS "group", CAST(80 + g * 7 % 21 AS DOUBLE) AS fov, CAST(g * 37 % 360 AS DOUBLE) AS yaw, CAST(g * 11 % 81 - 40 AS DOUBLE) AS elevation, CAST(g * 5 % 17 - 8 AS DOUBLE) AS roll, 1.0::DOUBLE AS score
FROM (SELECT DISTINCT CAST(vec_id // 10 AS BIGINT) AS g FROM embeddings)""",
    "stream_slots": """WITH frames AS (SELECT job, frame, row_number() OVER (PARTITION BY job ORDER BY frame) - 1 AS place FROM (SELECT DISTINCT CAST(o_custkey AS BIGINT) AS job, CAST(date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS frame FROM orders))
SELECT job, CAST(place // 30 AS INTEGER) AS segment, place * 2 AS slot, frame AS "before", frame AS "after" FROM frames
UNION ALL SELECT job, CAST(place // 30 AS INTEGER), place * 2 + 1, frame, coalesce(lead(frame) OVER (PARTITION BY job ORDER BY frame), frame) FROM frames""",
}
