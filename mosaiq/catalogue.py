"""All queries over the driver's tables, by name, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from mosaiq import catalogue_frames, catalogue_harmony, catalogue_objects, catalogue_probes, catalogue_sources, catalogue_trials
from mosaiq.operators import capture, detail, geometry, sequence

FLAGSHIP = "agreement"


def _digits(df):
    """Doubles rounded to nine digits, so that the order of sums does not show."""
    return df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _over_events(operator):
    return lambda spark, sf_dir: _digits(operator(capture.capture_of_events(spark.read.parquet(f"{sf_dir}/events.parquet"))))


def _order_frames(spark, sf_dir):
    day = F.date_diff(F.to_date("o_orderdate"), F.lit("1990-01-01").cast("date"))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderpriority").alias("job"), day.cast("long").alias("frame"), "o_orderstatus")


def _over_orders(operator):
    return lambda spark, sf_dir: operator(_order_frames(spark, sf_dir).select("job", "frame"))


def _pending(spark, sf_dir):
    rows = _order_frames(spark, sf_dir)
    return sequence.pending_frames(rows.select("job", "frame"), rows.where("o_orderstatus = 'F'").select("job", "frame").distinct())


def _views(spark, sf_dir):
    """A rig from the nations: eight yaws on each of the elevations, one camera a nation; the 25th repeats the first's yaw."""
    key = F.col("n_nationkey")
    yaw, elevation = ((key % 8) * 45 + 360 * F.floor(key / 24)).cast("double"), ((F.floor(key / 8) % 3 - 1) * 50).cast("double")
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(key.cast("long").alias("camera"), yaw.alias("yaw"), elevation.alias("elevation"), F.lit(83.0).alias("fov"))


def _warp_plan(spark, sf_dir):
    return geometry.warp_plan(geometry.directions(spark, 96, 48), _views(spark, sf_dir), 8)


def _flipped(spark, sf_dir):
    return _digits(geometry.warp_plan(geometry.directions(spark, 96, 48), _views(spark, sf_dir), 8, power=4, mirrored=False))


def _sampled(sampler):
    """The panorama from tiles read between their pixels, on a grid of 48 by 24."""
    def query(spark, sf_dir):
        place = F.col("vec_id").cast("long")
        tiles = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.floor(place / 25).alias("frame"), (place % 25).alias("camera"), F.col("embedding").alias("pixels"))
        rows = geometry.gather_sampled(geometry.contributors(geometry.directions(spark, 48, 24), _views(spark, sf_dir)), tiles, 8, sampler)
        return rows.select("frame", "out_index", F.round("blended", 6).alias("blended"), "contributors")
    return query


def _panorama(spark, sf_dir):
    """Frame f's tile of camera c is vector 25 f + c."""
    place = F.col("vec_id").cast("long")
    tiles = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.floor(place / 25).alias("frame"), (place % 25).alias("camera"), F.col("embedding").alias("pixels"))
    return _digits(geometry.gather(_warp_plan(spark, sf_dir), tiles))


def _srgb(spark, sf_dir):
    return _digits(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", geometry.srgb_encode(F.col("value") / 100).alias("level")))


def _moving_mean(spark, sf_dir):
    return _digits(sequence.moving_mean(spark.read.parquet(f"{sf_dir}/events.parquet"), key="user_id", order=["ts", "event_id"], value="value").drop("ts"))


QUERIES = {
    "flipped_plan": _flipped,
    "panorama_bilinear": _sampled("bilinear"),
    "panorama_bicubic": _sampled("catmullrom"),
    "warp_plan": lambda spark, sf_dir: _digits(_warp_plan(spark, sf_dir)),
    "panorama": _panorama,
    "orientation_groups": lambda spark, sf_dir: geometry.orientation_groups(_views(spark, sf_dir)),
    "duplicate_views": lambda spark, sf_dir: geometry.duplicate_views(_views(spark, sf_dir)),
    "srgb_levels": _srgb,
    "moving_mean_20": _moving_mean,
    "segment_names": lambda spark, sf_dir: sequence.segment_names(_over_orders(sequence.segment_plan)(spark, sf_dir)),
    "gradient_8x8": lambda spark, sf_dir: _digits(detail.gradient(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))),
    **{f.__name__: _over_events(f) for f in (
        capture.shared_frames, capture.blend, capture.leader_weight, capture.disagreement, capture.agreement, capture.overlap_fraction, capture.harmonise_residual,
        capture.wrap_seam_error, capture.temporal_step, capture.frame_diff_cut, capture.coverage_by_band, capture.level_bins,
    )},
    **{f.__name__: _over_orders(f) for f in (sequence.contiguous_tail, sequence.segment_plan, sequence.interleave_2x, sequence.sampled_gate)},
    "pending_frames": _pending,
    "laplacian_8x8": lambda spark, sf_dir: _digits(detail.laplacian(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))),
}

_CAPTURE = """WITH capture AS (SELECT CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) * 4 + hour(ts) // 6 AS INTEGER) AS frame, CAST(user_id % 24 AS INTEGER) AS direction, event_type AS camera,
  avg(value) AS sample, CAST(count(*) AS DOUBLE) AS weight FROM events GROUP BY ALL),
blend AS (SELECT frame, direction, sum(sample * weight) / greatest(sum(weight), 1e-6) AS blended FROM capture GROUP BY ALL),
deviation AS (SELECT frame, direction, count(*) AS n, sqrt(greatest(avg(sample * sample) - avg(sample) * avg(sample), 0)) AS deviation
  FROM capture GROUP BY ALL HAVING count(*) >= 2)
"""
_FRAMES = """WITH base AS (SELECT o_orderpriority AS job, CAST(date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS frame, o_orderstatus FROM orders),
frames AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY frame) - 1 AS position FROM (SELECT DISTINCT job, frame FROM base))
"""

_RIG = """WITH views AS (SELECT CAST(n_nationkey AS BIGINT) AS camera, CAST((n_nationkey % 8) * 45 + 360 * (n_nationkey // 24) AS DOUBLE) AS yaw,
  CAST(((n_nationkey // 8) % 3 - 1) * 50 AS DOUBLE) AS elevation, 83.0::DOUBLE AS fov FROM nation),
facing AS (SELECT min(camera) AS first_camera, yaw % 360 AS yaw, elevation, count(*) AS cameras FROM views GROUP BY yaw % 360, elevation)
"""
_PLAN = _RIG + """, grid AS (SELECT i AS out_index, ((i % 96 + 0.5::DOUBLE) / 96 - 0.5) * radians(360) AS lon, (0.5 - (i // 96 + 0.5::DOUBLE) / 48) * radians(180) AS lat FROM range(96 * 48) r(i)),
turned AS (SELECT out_index, camera, tan(radians(fov) / 2) AS half, cos(lat) * cos(lon - radians(yaw)) AS level, cos(lat) * sin(lon - radians(yaw)) AS aside,
  sin(lat) AS up, cos(radians(elevation)) AS ce, sin(radians(elevation)) AS se FROM grid, views),
plane AS (SELECT out_index, camera, aside / (level * ce + up * se) / half AS u, (level * se - up * ce) / (level * ce + up * se) / half AS v FROM turned WHERE level * ce + up * se > 0),
plan AS (SELECT out_index, camera, CAST(least(floor((v + 1) * 4), 7) * 8 + least(floor((u + 1) * 4), 7) AS INTEGER) AS source,
  power(least(1 - abs(u), 1 - abs(v)), 2) + 1e-6 AS weight FROM plane WHERE abs(u) <= 1 AND abs(v) <= 1)
"""

ORACLE_SQL: dict[str, str] = {
    "warp_plan": _PLAN + "SELECT out_index, camera, source, round(weight, 9) AS weight FROM plan",
    "panorama": _PLAN + """, seen AS (SELECT vec_id // 25 AS frame, out_index, weight, CAST(embedding[source + 1] AS DOUBLE) AS sample FROM plan JOIN embeddings ON vec_id % 25 = camera),
mixed AS (SELECT frame, out_index, sum(sample * weight) / greatest(sum(weight), 1e-6) AS blended, count(*) AS contributors FROM seen GROUP BY ALL)
SELECT frame, out_index, round(blended, 9) AS blended, contributors, CAST(round_even(least(greatest(blended, 0), 255), 0) AS INTEGER) AS level FROM mixed""",
    "orientation_groups": _RIG + "SELECT * FROM facing",
    "duplicate_views": _RIG + "SELECT camera FROM views WHERE camera NOT IN (SELECT first_camera FROM facing)",
    "srgb_levels": """SELECT event_id, round(CASE WHEN x IS NULL THEN NULL WHEN isnan(x) OR x <= 0 THEN 0 WHEN x >= 1 THEN 255
  WHEN x <= 0.0031308 THEN x * 12.92 * 255 ELSE (1.055 * power(x, 1 / 2.4::DOUBLE) - 0.055) * 255 END, 9) AS level FROM (SELECT event_id, value / 100 AS x FROM events)""",
    "moving_mean_20": "SELECT user_id, event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 9) AS recent_mean FROM events",
    "segment_names": _FRAMES + """, plan AS (SELECT job, CAST(floor(position / 30) AS INTEGER) AS segment, min(frame) AS a, max(frame) AS z FROM frames GROUP BY ALL)
SELECT job, segment, printf('%s.%04d.%d-%d.mp4', job, segment, a, z) AS name FROM plan""",
    "gradient_8x8": """SELECT vec_id, round(sum(greatest(abs(v[i + 1] - v[i]), abs(v[i + 8] - v[i]))) / 49, 9) AS gradient
FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), (SELECT r * 8 + c + 1 AS i FROM range(0, 7) a(r), range(0, 7) b(c)) GROUP BY vec_id""",
    "shared_frames": _CAPTURE + "SELECT frame FROM capture GROUP BY frame HAVING count(DISTINCT camera) = (SELECT count(DISTINCT camera) FROM capture)",
    "blend": _CAPTURE + "SELECT frame, direction, round(blended, 9) AS blended FROM blend",
    "leader_weight": _CAPTURE + "SELECT frame, direction, camera AS leader, weight AS leader_weight FROM capture QUALIFY row_number() OVER (PARTITION BY frame, direction ORDER BY weight DESC, camera) = 1",
    "disagreement": _CAPTURE + "SELECT frame, direction, n, round(deviation, 9) AS deviation FROM deviation",
    "agreement": _CAPTURE + """SELECT c.frame, round(coalesce(median(deviation), 0), 9) AS median, round(coalesce(avg(deviation), 0), 9) AS mean, round(coalesce(quantile_cont(deviation, 0.95), 0), 9) AS p95,
  round(coalesce(avg(CAST(deviation > 8 AS DOUBLE)), 0), 9) AS large_share, count(deviation) AS directions, max(c.n) AS max_contributors,
  CASE WHEN median(deviation) > 2.5 OR avg(deviation) > 4 THEN 'FAIL' WHEN coalesce(median(deviation), 0) <= 1 AND coalesce(avg(deviation), 0) <= 1.5 THEN 'PASS' ELSE 'WARN' END AS verdict
FROM (SELECT frame, direction, count(*) AS n FROM capture GROUP BY ALL) c LEFT JOIN deviation d ON d.frame = c.frame AND d.direction = c.direction GROUP BY c.frame""",
    "overlap_fraction": _CAPTURE + "SELECT frame, round(avg(CAST(n >= 2 AS DOUBLE)), 9) AS overlap_fraction FROM (SELECT frame, direction, count(*) AS n FROM capture GROUP BY ALL) GROUP BY frame",
    "harmonise_residual": _CAPTURE + """, cells AS (SELECT camera, CAST(floor(direction / 6) AS INTEGER) AS cell, sum((sample - blended) * weight) AS s, sum(weight) AS w
  FROM capture JOIN blend USING (frame, direction) GROUP BY ALL)
SELECT camera, cell, round(greatest(least(s / w, 32.0), -32.0), 9) AS correction FROM cells QUALIFY w > 0.05 * max(w) OVER (PARTITION BY camera)""",
    "wrap_seam_error": _CAPTURE + "SELECT a.frame, round(abs(a.blended - b.blended), 9) AS seam_error FROM blend a JOIN blend b ON a.frame = b.frame AND a.direction = 0 AND b.direction = 23",
    "temporal_step": _CAPTURE + """, steps AS (SELECT *, abs(sample - lag(sample) OVER (PARTITION BY camera, direction ORDER BY frame)) AS step FROM capture)
SELECT camera, direction, round(var_pop(sample), 9) AS variance, round(max(step), 9) AS biggest_step FROM steps GROUP BY ALL""",
    "frame_diff_cut": _CAPTURE + """, pairs AS (SELECT frame, lead(frame) OVER d AS next_frame, abs(lead(blended) OVER d - blended) AS diff FROM blend WINDOW d AS (PARTITION BY direction ORDER BY frame))
SELECT frame, next_frame, round(avg(diff), 9) AS difference, avg(diff) > 45 AS is_cut FROM pairs WHERE diff IS NOT NULL GROUP BY ALL""",
    "coverage_by_band": _CAPTURE + "SELECT camera, band, count(*) AS contributors, round(sum(weight), 9) AS weight FROM (SELECT *, CAST(floor(direction / 6) AS INTEGER) AS band FROM capture) GROUP BY ROLLUP (camera, band)",
    "level_bins": _CAPTURE + "SELECT CAST(floor(blended / 10) AS INTEGER) AS level_bin, round(avg(sample - blended), 9) + 0.0 AS bias, count(*) AS n FROM capture JOIN blend USING (frame, direction) GROUP BY ALL",
    "contiguous_tail": _FRAMES + """, islands AS (SELECT job, min(frame) AS first_frame, max(frame) AS last_frame FROM frames GROUP BY job, frame - position)
SELECT job, first_frame, last_frame FROM islands QUALIFY row_number() OVER (PARTITION BY job ORDER BY last_frame DESC) = 1""",
    "segment_plan": _FRAMES + "SELECT job, CAST(floor(position / 30) AS INTEGER) AS segment, min(frame) AS first_frame, max(frame) AS last_frame, count(*) AS frames FROM frames GROUP BY ALL",
    "interleave_2x": _FRAMES + """SELECT job, CAST(position * 2 AS INTEGER) AS slot, frame AS before, frame AS after FROM frames UNION ALL
SELECT job, CAST(position * 2 + 1 AS INTEGER), frame, coalesce(lead(frame) OVER (PARTITION BY job ORDER BY frame), frame) FROM frames""",
    "sampled_gate": _FRAMES + "SELECT job, frame FROM frames WHERE position % 10 = 0",
    "pending_frames": _FRAMES + "SELECT DISTINCT job, frame FROM base b WHERE NOT EXISTS (SELECT 1 FROM base f WHERE f.o_orderstatus = 'F' AND f.job = b.job AND f.frame = b.frame)",
    "laplacian_8x8": """SELECT vec_id, round(sum(abs(v[i - 1] + v[i + 1] + v[i - 8] + v[i + 8] - 4 * v[i])) / 36, 9) AS laplacian
FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), (SELECT r * 8 + c + 1 AS i FROM range(1, 7) a(r), range(1, 7) b(c)) GROUP BY vec_id""",
}

ORACLE_SQL["flipped_plan"] = _PLAN.replace("aside / (level * ce", "-aside / (level * ce").replace("1 - abs(v)), 2)", "1 - abs(v)), 4)") + "SELECT out_index, camera, source, round(weight, 9) AS weight FROM plan"
_PLACED = _PLAN.replace("/ 96", "/ 48").replace("% 96", "% 48").replace("// 96", "// 48").replace("/ 48) * radians(180)", "/ 24) * radians(180)").replace("range(96 * 48)", "range(48 * 24)") + """, spots AS (SELECT out_index, camera, (u + 1) * 4 - 0.5 AS x, (v + 1) * 4 - 0.5 AS y,
  power(least(1 - abs(u), 1 - abs(v)), 2) + 1e-6 AS w FROM plane WHERE abs(u) <= 1 AND abs(v) <= 1),
firsts AS (SELECT *, CAST(greatest(least(floor(x) - {back}, {last}), 0) AS INTEGER) AS l, CAST(greatest(least(floor(y) - {back}, {last}), 0) AS INTEGER) AS p FROM spots),
taps AS (SELECT *, greatest(least(x - l - {back}, 1), 0) AS fx, greatest(least(y - p - {back}, 1), 0) AS fy FROM firsts),
weights AS (SELECT out_index, camera, w, (p + j) * 8 + l + i + 1 AS k, ({wx}) * ({wy}) AS c FROM taps, range({n}) a(i), range({n}) b(j)),
samples AS (SELECT vec_id // 25 AS frame, out_index, camera, any_value(w) AS w, sum(CAST(embedding[k] AS DOUBLE) * c) AS s FROM weights JOIN embeddings ON vec_id % 25 = camera GROUP BY frame, out_index, camera)
SELECT CAST(frame AS BIGINT) AS frame, out_index, round(sum(s * w) / greatest(sum(w), 1e-6), 6) AS blended, count(*) AS contributors FROM samples GROUP BY frame, out_index"""
_linear, _cubic = "CASE {i} WHEN 0 THEN 1 - {f} ELSE {f} END", catalogue_probes._CUBIC
ORACLE_SQL["panorama_bilinear"] = _PLACED.format(back=0, last=6, n=2, wx=_linear.format(i="i", f="fx"), wy=_linear.format(i="j", f="fy"))
ORACLE_SQL["panorama_bicubic"] = _PLACED.format(back=1, last=4, n=4, wx=_cubic.format(i="i", f="fx"), wy=_cubic.format(i="j", f="fy"))

ORACLE_SQL["sphere_coverage"] = _PLAN + """, seen AS (SELECT out_index, count(DISTINCT camera) AS views FROM plan GROUP BY out_index)
SELECT views, round(sum(cos((0.5 - (out_index // 96 + 0.5::DOUBLE) / 48) * pi())) / (SELECT sum(cos((0.5 - (i + 0.5::DOUBLE) / 48) * pi())) * 96 FROM range(48) r(i)), 9) AS share FROM seen GROUP BY views"""

for _part in (catalogue_sources, catalogue_probes, catalogue_frames, catalogue_objects, catalogue_harmony, catalogue_trials):
    QUERIES |= _part.QUERIES
    ORACLE_SQL |= _part.ORACLE_SQL
