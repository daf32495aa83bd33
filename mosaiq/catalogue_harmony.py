"""Queries of the harmoniser to convergence, on RGB tiles of the vectors, and SQL that runs both rounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from mosaiq.catalogue_probes import blur_sql, filled_sql
from mosaiq.operators import geometry, harmonise, sampling

SIZE = harmonise.Estimate(width=48, height=24, rows=6, columns=12, radius=1)
RGB = ["red", "green", "blue"]


def _views(spark):
    """Eight views around, on three elevations."""
    camera = F.col("camera")
    return spark.range(8).select(F.col("id").alias("camera")).select(camera, (camera * 45.0).alias("yaw"), ((camera % 3 - 1) * 20.0).alias("elevation"), F.lit(100.0).alias("fov"))


def _samples(spark, sf_dir):
    """Vectors 24 f + 3 c to 24 f + 3 c + 2 are the channels of camera c's tile in frame f; a tile with less is left out."""
    k = F.col("vec_id").cast("long")
    level = F.transform("embedding", lambda v: 128 + 60 * v.cast("double"))
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.floor(k / 24).alias("frame"), (F.floor(k / 3) % 8).alias("camera"), (k % 3).alias("channel"), level.alias("pixels"))
    tiles = e.groupBy("frame", "camera").agg(*[F.max(F.when(F.col("channel") == i, F.col("pixels"))).alias(c) for i, c in enumerate(RGB)])
    seen = geometry.contributors(geometry.directions(spark, SIZE.width, SIZE.height), _views(spark))
    return geometry.samples(seen, tiles, 8, channels=tuple(RGB))


def _grids(spark, sf_dir):
    _, grids = harmonise.converged(_samples(spark, sf_dir), RGB, SIZE)
    rows = harmonise.exploded(grids, ["frame", "camera"], RGB, SIZE.columns)
    return rows.select("frame", "camera", "gy", "gx", *[F.round(c, 6).alias(c) for c in RGB])


def _agreements(spark, sf_dir):
    samples, grids = harmonise.converged(_samples(spark, sf_dir), RGB, SIZE)
    rows = harmonise.agreements(samples, grids, RGB, SIZE)
    return rows.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes])


def _panorama(spark, sf_dir):
    """The blend of corrected tiles, in levels of eight bits."""
    samples, grids = harmonise.converged(_samples(spark, sf_dir), RGB, SIZE)
    rows = harmonise.mixed(harmonise.corrected(samples, grids, RGB, SIZE), RGB)
    return rows.select("frame", "out_index", *[sampling.quantise(F.col(c), 8).alias(c) for c in RGB])


QUERIES = {"harmonised_grids": _grids, "harmonised_agreement": _agreements, "harmonised_panorama": _panorama}

_SAMPLES = """WITH places AS (SELECT i AS out_index, ((i % 48 + 0.5::DOUBLE) / 48 - 0.5) * radians(360) AS lon, (0.5 - (i // 48 + 0.5::DOUBLE) / 24) * radians(180) AS lat FROM range(48 * 24) r(i)),
rig AS (SELECT i AS camera, radians(i * 45) AS yaw, radians((i % 3 - 1) * 20) AS tilt, tan(radians(100) / 2) AS half FROM range(8) r(i)),
turned AS (SELECT out_index, camera, half, cos(lat) * cos(lon - yaw) AS level, cos(lat) * sin(lon - yaw) AS aside, sin(lat) AS up, cos(tilt) AS c, sin(tilt) AS s FROM places, rig),
plane AS (SELECT out_index, camera, aside / (level * c + up * s) / half AS u, (level * s - up * c) / (level * c + up * s) / half AS v FROM turned WHERE level * c + up * s > 0),
spots AS (SELECT out_index, camera, (u + 1) * 4 - 0.5 AS x, (v + 1) * 4 - 0.5 AS y, power(least(1 - abs(u), 1 - abs(v)), 2) + 1e-6 AS w FROM plane WHERE abs(u) <= 1 AND abs(v) <= 1),
firsts AS (SELECT *, CAST(greatest(least(floor(x), 6), 0) AS INTEGER) AS l, CAST(greatest(least(floor(y), 6), 0) AS INTEGER) AS p FROM spots),
taps AS (SELECT *, greatest(least(x - l, 1), 0) AS fx, greatest(least(y - p, 1), 0) AS fy FROM firsts),
corners AS (SELECT out_index, camera, w, (p + j) * 8 + l + i + 1 AS k, (CASE i WHEN 0 THEN 1 - fx ELSE fx END) * (CASE j WHEN 0 THEN 1 - fy ELSE fy END) AS c FROM taps, range(2) a(i), range(2) b(j)),
vectors AS (SELECT vec_id // 24 AS frame, vec_id // 3 % 8 AS camera, vec_id % 3 AS channel, embedding FROM embeddings QUALIFY count(*) OVER (PARTITION BY vec_id // 3) = 3),
base AS (SELECT frame, camera, channel, out_index, any_value(w) AS weight, sum((128 + 60 * CAST(embedding[k] AS DOUBLE)) * c) AS s FROM corners JOIN vectors USING (camera) GROUP BY frame, camera, channel, out_index),
cells AS (SELECT *, out_index // 48 // 4 AS gy, out_index % 48 // 4 AS gx, printf('%d/%d/%d', frame, camera, channel) AS name, (out_index // 48 + 0.5::DOUBLE) / 4 - 0.5 AS fy, (out_index % 48 + 0.5::DOUBLE) / 4 - 0.5 AS fx FROM base),
now0 AS (SELECT *, CAST(greatest(least(floor(fy), 4), 0) AS INTEGER) AS y0, CAST(greatest(least(floor(fx), 10), 0) AS INTEGER) AS x0 FROM cells)
"""


def _round(i: int) -> str:
    """SQL of one round: from the samples now{i} to the grids sum{i + 1} and the samples now{i + 1}."""
    part = f"r{i}_"
    before = f"LEFT JOIN sum{i} b USING (camera, gy, gx)" if i else ""
    return f""", {part}mix AS (SELECT frame, channel, out_index, sum(s * weight) / greatest(sum(weight), 1e-6) AS blended FROM now{i} GROUP BY ALL),
{part}sums AS (SELECT name, gy, gx, sum((s - blended) * weight) / sum(weight) AS value, sum(weight) AS w FROM now{i} JOIN {part}mix USING (frame, channel, out_index) GROUP BY ALL),
{part}means AS (SELECT * FROM {part}sums QUALIFY w > 0.05 * max(w) OVER (PARTITION BY name)),
{part}grid AS (SELECT c.name AS camera, CAST(y.i AS INTEGER) AS gy, CAST(x.i AS INTEGER) AS gx, coalesce(m.value, 0) AS value, m.value IS NOT NULL AS covered
  FROM (SELECT DISTINCT name FROM {part}means) c CROSS JOIN range(6) y(i) CROSS JOIN range(12) x(i) LEFT JOIN {part}means m ON m.name = c.name AND m.gy = y.i AND m.gx = x.i)
""" + filled_sql(part) + blur_sql(f"{part}fill16", f"{part}out", "value", 1) + f""",
sum{i + 1} AS (SELECT f.camera, f.gy, f.gx, greatest(least({"b.value + " if i else ""}f.value, 32), -32) AS value FROM {part}out5 f {before}),
less{i + 1} AS (SELECT n.name, n.out_index, sum(g.value * (CASE WHEN g.gy = y0 THEN 1 - greatest(least(fy - y0, 1), 0) ELSE greatest(least(fy - y0, 1), 0) END) * (CASE WHEN g.gx = x0 THEN 1 - greatest(least(fx - x0, 1), 0) ELSE greatest(least(fx - x0, 1), 0) END)) AS shift
  FROM now0 n JOIN sum{i + 1} g ON g.camera = n.name AND g.gy - n.y0 IN (0, 1) AND g.gx - n.x0 IN (0, 1) GROUP BY n.name, n.out_index),
now{i + 1} AS (SELECT n.* REPLACE (n.s - l.shift AS s) FROM now0 n JOIN less{i + 1} l USING (name, out_index))
"""


_ROUNDS = _SAMPLES + _round(0) + _round(1)
_WIDE = ", ".join(f"round(max(CASE WHEN channel = {i} THEN value END), 6) AS {c}" for i, c in enumerate(RGB))
_LEVELS = ", ".join(f"max(CASE WHEN channel = {i} THEN level END) AS {c}" for i, c in enumerate(RGB))
_OVERLAP = """, {n}luma AS (SELECT frame, camera, out_index, sum(s * CASE channel WHEN 0 THEN 0.2126::DOUBLE WHEN 1 THEN 0.7152::DOUBLE ELSE 0.0722::DOUBLE END) AS v FROM {rows} GROUP BY ALL),
{n}deviation AS (SELECT frame, out_index, sqrt(greatest(avg(v * v) - avg(v) * avg(v), 0)) AS d FROM {n}luma GROUP BY ALL HAVING count(*) >= 2),
{n} AS (SELECT frame, round(median(d), 6) AS {n}_median, round(avg(d), 6) AS {n}_mean, round(quantile_cont(d, 0.95), 6) AS {n}_p95, round(avg(CAST(d > 8 AS DOUBLE)), 6) AS {n}_large_share,
  CASE WHEN median(d) > 2.5 OR avg(d) > 4 THEN 'FAIL' WHEN median(d) <= 1 AND avg(d) <= 1.5 THEN 'PASS' ELSE 'WARN' END AS {n}_verdict FROM {n}deviation GROUP BY frame)
"""

ORACLE_SQL = {
    "harmonised_grids": _ROUNDS + f"""SELECT frame, cam AS camera, gy, gx, {_WIDE}
FROM (SELECT CAST(split_part(camera, '/', 1) AS BIGINT) AS frame, CAST(split_part(camera, '/', 2) AS BIGINT) AS cam, CAST(split_part(camera, '/', 3) AS INTEGER) AS channel, gy, gx, value FROM sum2) GROUP BY frame, cam, gy, gx""",
    "harmonised_agreement": _ROUNDS + _OVERLAP.format(n="raw", rows="now0") + _OVERLAP.format(n="corrected", rows="now2") + """, most AS (SELECT CAST(split_part(camera, '/', 1) AS BIGINT) AS frame, round(max(abs(value)), 6) AS largest FROM sum2 GROUP BY ALL)
SELECT raw.*, corrected.* EXCLUDE (frame), largest FROM raw JOIN corrected USING (frame) JOIN most USING (frame)""",
    "harmonised_panorama": _ROUNDS + f""", mixed AS (SELECT frame, out_index, channel, CAST(round_even(greatest(least(sum(s * weight) / greatest(sum(weight), 1e-6), 255), 0), 0) AS INTEGER) AS level FROM now2 GROUP BY ALL)
SELECT frame, out_index, {_LEVELS} FROM mixed GROUP BY frame, out_index""",
}
