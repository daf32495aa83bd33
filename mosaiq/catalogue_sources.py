"""Queries over captures' files, rigs and manifests, on inputs made from the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from mosaiq.operators import harmonise, layout, scales
from mosaiq.sources import manifests, rigs, tiles


def _listing(spark, sf_dir, every_digit=False):
    """Files of event types as captures, users as cameras; some are no tiles, some of another size, format or padding. In
    two of the captures each event is a frame of all four cameras, so those are whole. Names hold five or six digits of a
    frame's number, or every digit, as longer numbers fall together otherwise (from 1.2 million events on)."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    whole = F.col("event_type").isin("purchase", "signup")
    e = e.withColumn("camera", F.explode(F.when(whole, F.array(*[F.lit(i).cast("long") for i in range(1, 5)])).otherwise(F.array(F.col("user_id") % 4 + 1))))
    camera = F.col("camera")
    inner = F.when(camera == 4, "/Tempory").when((camera == 3) & ~whole & (F.col("event_id") % 5 == 0), "/b").otherwise("")
    odd = F.col("event_type") == "error"
    number, digits = F.floor(F.col("event_id") / 12).cast("int").cast("string"), F.when(odd & (F.col("event_id") % 50 == 0), 6).otherwise(5)
    number = F.lpad(number, F.greatest(digits, F.length(number)) if every_digit else digits, "0")
    kind = F.when(odd & (F.col("event_id") % 90 == 0), "EXR").when(F.col("event_id") % 41 == 0, "txt").otherwise("png")
    size = F.when(odd & (camera == 2), 1080).otherwise(1920)
    # grouped by what a path is made of, as numbers fit a hash and paths need not be sorted; names are made once a file
    parts = {"event_type": F.col("event_type"), "camera": camera, "inner": inner, "number": number, "kind": kind, "size": size}
    e = e.groupBy(*[c.alias(n) for n, c in parts.items()]).agg(F.max(F.floor(F.col("value") * 100).cast("long")).alias("length"))
    inner, number, kind, size = (F.col(n) for n in ("inner", "number", "kind", "size"))
    head = F.unhex(F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), F.lpad(F.hex(F.lit(1920)), 8, "0"), F.lpad(F.hex(size), 8, "0")))
    path = F.concat(F.lit("/data/"), F.col("event_type"), F.when(camera % 2 == 0, "/Camera_").otherwise("/camera"), camera.cast("string"), inner, F.lit("/S."), number, F.lit("."), kind)
    return e.select(path.alias("path"), "length", head.alias("head"))


def _files(spark, sf_dir):
    return tiles.tile_files(_listing(spark, sf_dir))


def _roots(spark, sf_dir):
    folders = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(F.lit("/data/"), F.col("event_type")).alias("path")).distinct()
    return tiles.candidate_roots(folders, "/data")


def _candidates(spark, sf_dir):
    """Folders of customers' runs, some with takes below them, around one run's folder."""
    k = F.col("c_custkey")
    path = F.concat(F.lit("/data/run"), (k % 90).cast("string"), F.when(k % 3 == 0, F.concat(F.lit("/take"), k.cast("string"))).otherwise(""))
    roots = tiles.candidate_roots(spark.read.parquet(f"{sf_dir}/customer.parquet").select(path.alias("path")), "/data/run6")
    return roots.select("root", F.col("place.rank").alias("rank"))


def _tile_paths(spark, sf_dir):
    rows = tiles.shared_tile_frames(_files(spark, sf_dir)).withColumns({"camera_dir": F.lit("Camera01"), "digits": F.lit(4), "format": F.lit("png")})
    return rows.select("root", "frame", tiles.tile_path("root", "stem", "format").alias("path"))


def _to_copy(spark, sf_dir):
    files = harmonise.written(_files(spark, sf_dir))
    there = files.where("camera <= 2").select("path", F.when(F.col("frame") % 2 == 0, F.col("length")).otherwise(F.col("length") + 1).alias("length"))
    return tiles.still_to_copy(tiles.first_frames(files, 20), there)


def _survey(spark, sf_dir):
    known = rigs.twenty_file_rig(spark).where("camera <= 4").groupBy().agg(F.count(F.lit(1)).alias("cameras"), F.count_distinct("yaw", "elevation").alias("distinct_views"))
    out = tiles.survey(tiles.source_sets(tiles.tile_files(_listing(spark, sf_dir, every_digit=True))), known)
    return out.select("root", F.round("mib", 9).alias("mib"), F.round("distinct_mib", 9).alias("distinct_mib"))


def _captures(spark, sf_dir):
    """A capture per supplier: a registered rig, turned a whole turn, in another order, or with one camera moved."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("capture"))
    key = F.col("capture") % 4
    both = s.join(F.broadcast(rigs.registered(spark)), (F.col("rig") == "fifteen") == (key == 1))  # 35 rows at most are broadcast
    return both.select("capture", (101 - F.col("camera")).alias("camera"), (F.col("yaw") + F.when(key == 0, 360.0).otherwise(0.0) + F.when((key == 2) & (F.col("camera") == 1), 1.0).otherwise(0.0)).alias("yaw"), "elevation", "fov")


def _overlaps(spark, sf_dir):
    """The overlapping pairs of each capture's cameras."""
    views = _captures(spark, sf_dir)
    return layout.view_pairs(rigs.horizon_pairs(views, "capture"), views, "capture")


def _boxes(spark, sf_dir):
    return layout.overlap_boxes(_overlaps(spark, sf_dir), 128, 8).select("capture", "a", "b", "top", "bottom", "left", "right")


def _scales(spark, sf_dir):
    return scales.pixel_scales(_captures(spark, sf_dir), 32, 12, "capture")


def _six(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _delivered(spark, sf_dir):
    """Vectors as 8 x 8 pictures, at 5 columns and 12 rows."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    pixels = e.select("vec_id", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).cast("int").alias("x"), F.col("v").cast("double").alias("level"))
    return _six(scales.lanczos(pixels, (8, 8), (5, 12), "vec_id"))


def _of_suppliers(rig):
    """Each supplier's copy of a registered rig."""
    def query(spark, sf_dir):
        return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("capture")).crossJoin(F.broadcast(rig(spark)))  # twenty rows
    return query


def _widths(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    tile, fov = (F.col("p_size") * 32).cast("double"), (F.col("p_partkey") % 200).cast("double")
    return p.select("p_partkey", rigs.native_width(tile, fov).alias("native_width"), rigs.analysis_width(tile, fov).alias("analysis_width"), rigs.fold_yaw(F.col("p_partkey").cast("double") * 7 - 500).alias("yaw"))


def _rig_counts(spark, sf_dir):
    counts = spark.read.parquet(f"{sf_dir}/customer.parquet").groupBy(F.col("c_custkey") % 97).agg(F.count(F.lit(1)).alias("cameras")).select(F.col("(c_custkey % 97)").alias("capture"), "cameras")
    return rigs.rig_of_count(counts, rigs.registered(spark)).select("capture", "cameras", "rig")


def _manifests(spark, sf_dir):
    """A manifest per order; some fields have another type, some texts are cut off."""
    k = F.col("o_orderkey")
    width = F.when(k % 7 == 0, '"1920"').when(k % 11 == 0, "1920.5").otherwise("1920")
    rate = F.when(k % 13 == 0, "null").when(k % 3 == 0, "30000").otherwise("30")
    state = F.when(k % 17 == 0, "").otherwise('"state":"finished",')
    view = lambda i: F.concat(F.lit(f'{{"directory":"Camera0{i}","pitch":'), F.lit(45 * (i - 2)).cast("string"), F.lit(',"yaw":'), ((k + i) % 360).cast("string"), F.lit(',"roll":0,"fov":'), F.when(k % 19 == 0, "true").otherwise("90.5"), F.lit("}"))
    mattes = F.when(k % 5 == 0, F.concat(F.lit(',"id_mattes":{"images":[{"name":"m'), (k % 4).cast("string"), F.lit('","stems":["S1","S2"],"channels":{"R":{"id":'), k.cast("string"), F.lit(',"group":"g"},"G":null,"B":{"id":2,"group":"h"}}}]}'))).otherwise("")
    text = F.concat(F.lit('{"schema":"capture","schema_version":1,'), state, F.lit('"rig":{"type":"pano","views":['), view(1), F.lit(","), view(2), F.lit(","), view(3), F.lit(']},"tiles":{"width":'), width, F.lit(',"height":1920,"format":"png","stems":["S"]},"frames":{"rate":{"numerator":'), rate, F.lit(',"denominator":1001}}'), mattes, F.lit("}"))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("t", text).select(k.alias("capture"), F.when(k % 23 == 0, F.substring("t", 1, 40)).otherwise(F.col("t")).alias("manifest"))


def _disk(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("capture"))
    rows = o.select("capture", F.explode(F.sequence(F.lit(1), F.when(F.col("capture") % 6 == 0, 4).when(F.col("capture") % 10 == 1, 2).otherwise(3))).alias("camera"))
    return rows.select("capture", F.format_string("CAMERA%02d", "camera").alias("directory"), (4 - F.col("camera")).alias("camera"))


def _rates(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    den = F.when(F.col("o_orderkey") % 2 == 0, 1001).when(F.col("o_orderkey") % 9 == 0, 0).otherwise(1)
    return o.select("o_orderkey", manifests.rate_label((F.col("o_orderkey") % 60) * F.when(F.col("o_orderkey") % 2 == 0, 1000).otherwise(1), den).alias("label"))


def _decisions(spark, sf_dir):
    k = F.col("o_orderkey")
    sets = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        k.alias("capture"), F.when(k % 3 == 0, "").when(k % 3 == 1, "no record of frames").alias("manifest_problem"),
        F.when(k % 4 < 2, "twenty").alias("manifest_rig"), F.when(k % 5 < 3, "fifteen").alias("count_rig"))
    return manifests.rig_decision(sets)


QUERIES = {
    "tile_files": lambda s, d: _files(s, d).select("path", "root", "camera", "inner", "stem", "frame", "digits", "format"),
    "tile_directories": lambda s, d: tiles.tile_directories(_files(s, d)),
    "camera_files": lambda s, d: tiles.camera_files(_files(s, d)),
    "source_problems": lambda s, d: tiles.problems(tiles.camera_files(_files(s, d))),
    "shared_tile_frames": lambda s, d: tiles.shared_tile_frames(_files(s, d)),
    "source_sets": lambda s, d: tiles.source_sets(_files(s, d)),
    "candidate_roots": _candidates,
    "first_usable_root": lambda s, d: tiles.first_usable(tiles.source_sets(_files(s, d)), _roots(s, d)),
    "tile_paths": _tile_paths,
    "sample_files": lambda s, d: tiles.first_frames(harmonise.written(_files(s, d)), 20),
    "files_to_copy": _to_copy,
    "source_survey": _survey,
    "frame_gaps": lambda s, d: tiles.frame_gaps(_files(s, d), ["root", "camera"]),
    "pixel_scales": lambda s, d: _six(_scales(s, d)),
    "scales_by_band": lambda s, d: _six(scales.scales_by_band(_scales(s, d), 16, "capture")),
    "lanczos_pictures": _delivered,
    "overlap_boxes": _boxes,
    "overlap_patches": lambda s, d: layout.overlap_patches(_overlaps(s, d), 64, 8, 4).select("capture", "a", "b", "y", "x"),
    "rig_twenty": _of_suppliers(rigs.twenty_file_rig),
    "rig_fifteen": _of_suppliers(rigs.fifteen_file_rig),
    "panorama_widths": _widths,
    "rig_of_count": _rig_counts,
    "matching_rigs": lambda s, d: rigs.matching_rigs(_captures(s, d), rigs.registered(s)),
    "horizon_pairs": lambda s, d: rigs.horizon_pairs(_captures(s, d), "capture"),
    "ring_pairs": lambda s, d: rigs.ring_pairs(_captures(s, d), "capture"),
    "manifest_problems": lambda s, d: manifests.field_problems(_manifests(s, d)),
    "manifest_views": lambda s, d: manifests.views(_manifests(s, d)),
    "manifest_disk_differences": lambda s, d: manifests.disk_differences(manifests.views(_manifests(s, d)), _disk(s, d)),
    "views_in_camera_order": lambda s, d: manifests.in_camera_order(manifests.views(_manifests(s, d)), _disk(s, d)),
    "rate_labels": _rates,
    "rig_decision": _decisions,
    "matte_channels": lambda s, d: manifests.matte_channels(_manifests(s, d)),
    "matte_of_stem": lambda s, d: manifests.matte_of_stem(_manifests(s, d)),
}

_LISTING = r"""WITH named AS (SELECT *, event_type = 'error' AS odd, unnest(CASE WHEN event_type IN ('purchase', 'signup') THEN [1, 2, 3, 4] ELSE [user_id % 4 + 1] END) AS cam FROM events),
listing AS (SELECT path, max(length) AS length, min(size) AS size FROM (SELECT '/data/' || event_type || CASE WHEN cam % 2 = 0 THEN '/Camera_' ELSE '/camera' END || cam
  || CASE WHEN cam = 4 THEN '/Tempory' WHEN cam = 3 AND event_id % 5 = 0 AND event_type NOT IN ('purchase', 'signup') THEN '/b' ELSE '' END || '/S.' || lpad(CAST(event_id // 12 AS VARCHAR), CASE WHEN odd AND event_id % 50 = 0 THEN 6 ELSE 5 END, '0')
  || '.' || CASE WHEN odd AND event_id % 90 = 0 THEN 'EXR' WHEN event_id % 41 = 0 THEN 'txt' ELSE 'png' END AS path,
  CAST(floor(value * 100) AS BIGINT) AS length, CASE WHEN odd AND cam = 2 THEN 1080 ELSE 1920 END AS size FROM named) GROUP BY path),
parts AS (SELECT *, regexp_extract(path, '^(.*)/(camera[\s_-]*([0-9]+))(?:/([^/]+))?/([^/]+)\.([0-9]{2,8})\.(png|exr)$', ['root', 'directory', 'cam', 'inner', 'stem', 'frame', 'format'], 'i') AS p FROM listing),
files AS (SELECT path, length, size, p['root'] AS root, p['directory'] AS directory, CAST(p['cam'] AS INTEGER) AS camera, p['inner'] AS "inner", p['stem'] AS stem, CAST(p['frame'] AS INTEGER) AS frame,
  length(p['frame']) AS digits, lower(p['format']) AS format FROM parts WHERE p['format'] <> ''),
folders AS (SELECT root, camera, directory, min("inner") AS "inner" FROM files GROUP BY ALL),
used AS (SELECT f.* FROM files f JOIN folders d USING (root, camera, directory, "inner")),
cameras AS (SELECT root, stem, camera, min(format) AS format, count(DISTINCT format) AS formats, count(DISTINCT frame) AS frames, min(frame) AS first_frame, max(frame) AS last_frame,
  CAST(sum(length) AS BIGINT) AS total_bytes, CAST(min(digits) AS INTEGER) AS least_digits, CAST(max(digits) AS INTEGER) AS digits, 1920 AS width, arg_min(size, format || path) AS height FROM used GROUP BY ALL),
problems AS (SELECT root, stem, unnest(list_filter([
  CASE WHEN min(camera) <> 1 OR max(camera) <> count(DISTINCT camera) THEN 'numbering' END, CASE WHEN count(DISTINCT height) > 1 THEN 'resolution' END,
  CASE WHEN count(DISTINCT height) = 1 AND max(height) <> max(width) THEN 'square' END, CASE WHEN count(DISTINCT format) > 1 THEN 'format' END, CASE WHEN max(formats) > 1 THEN 'mixed' END,
  CASE WHEN count(DISTINCT frames) > 1 THEN 'count' END, CASE WHEN min(least_digits) <> max(digits) THEN 'padding' END], lambda x: x IS NOT NULL)) AS problem FROM cameras GROUP BY root, stem),
shared AS (SELECT root, stem, frame FROM used u GROUP BY root, stem, frame HAVING count(DISTINCT camera) = (SELECT count(DISTINCT camera) FROM used v WHERE v.root = u.root AND v.stem = u.stem)),
sets AS (SELECT c.root, c.stem, count(*) AS cameras, CAST(sum(total_bytes) AS BIGINT) AS total_bytes, (SELECT count(*) FROM shared s WHERE s.root = c.root AND s.stem = c.stem) AS frames,
  (SELECT count(*) FROM problems p WHERE p.root = c.root AND p.stem = c.stem) AS faults FROM cameras c GROUP BY c.root, c.stem),
sample AS (SELECT u.path, u.length, u.camera, u.frame FROM used u JOIN (SELECT *, row_number() OVER (PARTITION BY root, stem ORDER BY frame) AS n FROM shared) s USING (root, stem, frame) WHERE n <= 20)
"""
_DIGITS = "CASE WHEN odd AND event_id % 50 = 0 THEN 6 ELSE 5 END"
_EVERY_DIGIT = _LISTING.replace(_DIGITS, f"CAST(greatest({_DIGITS}, length(CAST(event_id // 12 AS VARCHAR))) AS INTEGER)")
_REGISTRY = """WITH twenty AS (SELECT 'twenty' AS rig, CAST(i + 1 AS INTEGER) AS camera, CAST(CASE WHEN i % 4 = 3 THEN (i // 4 + 1) % 5 ELSE i // 4 END * 72 AS DOUBLE) AS yaw,
  CAST(CASE i % 4 WHEN 1 THEN -45 WHEN 2 THEN 0 ELSE 45 END AS DOUBLE) AS elevation, 90.0::DOUBLE AS fov FROM range(20) r(i)),
fifteen AS (SELECT 'fifteen' AS rig, CAST(row_number() OVER (ORDER BY f) AS INTEGER) AS camera, yaw, elevation, fov FROM (SELECT min(camera) AS f, yaw, elevation, fov FROM twenty GROUP BY ALL)),
registered AS (SELECT * FROM twenty UNION ALL SELECT * FROM fifteen),
captures AS (SELECT s_suppkey AS capture, 101 - camera AS camera, yaw + CASE WHEN s_suppkey % 4 = 0 THEN 360 ELSE 0 END + CASE WHEN s_suppkey % 4 = 2 AND camera = 1 THEN 1 ELSE 0 END AS yaw, elevation, fov
  FROM supplier JOIN registered ON (rig = 'fifteen') = (s_suppkey % 4 = 1))
"""
_MANIFESTS = """WITH manifests AS (SELECT o_orderkey AS capture, o_orderkey % 23 <> 0 AS whole, '{"schema":"capture","schema_version":1,' || CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE '"state":"finished",' END
  || '"rig":{"type":"pano","views":[' || array_to_string(list_transform([1, 2, 3], lambda i: '{"directory":"Camera0' || i || '","pitch":' || 45 * (i - 2) || ',"yaw":' || (o_orderkey + i) % 360 || ',"roll":0,"fov":' || CASE WHEN o_orderkey % 19 = 0 THEN 'true' ELSE '90.5' END || '}'), ',')
  || ']},"tiles":{"width":' || CASE WHEN o_orderkey % 7 = 0 THEN '"1920"' WHEN o_orderkey % 11 = 0 THEN '1920.5' ELSE '1920' END || ',"height":1920,"format":"png","stems":["S"]},"frames":{"rate":{"numerator":'
  || CASE WHEN o_orderkey % 13 = 0 THEN 'null' WHEN o_orderkey % 3 = 0 THEN '30000' ELSE '30' END || ',"denominator":1001}}' || CASE WHEN o_orderkey % 5 = 0 THEN ',"id_mattes":{"images":[{"name":"m' || o_orderkey % 4
  || '","stems":["S1","S2"],"channels":{"R":{"id":' || o_orderkey || ',"group":"g"},"G":null,"B":{"id":2,"group":"h"}}}]}' ELSE '' END || '}' AS manifest FROM orders),
kinds AS (SELECT capture, field, wanted, coalesce(json_type(manifest, '$.' || field), 'MISSING') AS t FROM manifests, (VALUES ('schema', 'string'), ('schema_version', 'integer'), ('state', 'string'), ('rig.type', 'string'), ('rig.views', 'list'),
  ('tiles.width', 'integer'), ('tiles.height', 'integer'), ('tiles.format', 'string'), ('tiles.stems', 'list'), ('frames.rate.numerator', 'integer'), ('frames.rate.denominator', 'integer')) f(field, wanted) WHERE whole),
named AS (SELECT *, CASE t WHEN 'MISSING' THEN 'missing' WHEN 'NULL' THEN 'null' WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' WHEN 'DOUBLE' THEN 'number' WHEN 'VARCHAR' THEN 'string' WHEN 'ARRAY' THEN 'list' WHEN 'OBJECT' THEN 'object' ELSE 'boolean' END AS kind FROM kinds),
views AS (SELECT capture, CAST(i AS INTEGER) AS place, json_extract_string(manifest, '$.rig.views[' || i || '].directory') AS directory, CAST(json_extract_string(manifest, '$.rig.views[' || i || '].pitch') AS DOUBLE) AS pitch,
  CAST(json_extract_string(manifest, '$.rig.views[' || i || '].yaw') AS DOUBLE) AS yaw, CAST(0 AS DOUBLE) AS roll, CASE WHEN capture % 19 = 0 THEN 1.0::DOUBLE ELSE 90.5::DOUBLE END AS fov FROM manifests, range(3) r(i) WHERE whole),
disk AS (SELECT o_orderkey AS capture, printf('CAMERA%02d', c) AS directory, CAST(4 - c AS INTEGER) AS camera FROM orders, range(1, 5) r(c) WHERE c <= CASE WHEN o_orderkey % 6 = 0 THEN 4 WHEN o_orderkey % 10 = 1 THEN 2 ELSE 3 END)
"""

def _overlap_sql(width: int, step: int, patch: int | None = None) -> str:
    """SQL of the overlap boxes, or of the whole lattice without any box."""

    def seen(side: str, w: int) -> str:
        lon, lat = f"radians((col + 0.5::DOUBLE) / {w} * 360 - 180 - {side}.yaw)", f"radians(90 - (row + 0.5::DOUBLE) / {w // 2} * 180)"
        tilt = f"radians({side}.elevation)"
        ahead = f"(cos({lat}) * cos({lon}) * cos({tilt}) + sin({lat}) * sin({tilt}))"
        return f"{ahead} > 0 AND abs(cos({lat}) * sin({lon})) <= {ahead} * tan(radians({side}.fov) / 2) AND abs(sin({lat}) * cos({tilt}) - cos({lat}) * cos({lon}) * sin({tilt})) <= {ahead} * tan(radians({side}.fov) / 2)"

    shared = lambda w: f"""shared AS (SELECT a.capture, a.camera AS a, b.camera AS b, row, col FROM own a JOIN own b ON a.capture = b.capture AND a.fold = b.fold AND b.elevation = 0 AND abs(a.elevation) = 45,
  range({w // 2}) r(row), range({w}) c(col) WHERE {seen('a', w)} AND {seen('b', w)})"""
    own = _REGISTRY + ", own AS (SELECT * FROM (SELECT *, yaw % 360 AS fold FROM captures) QUALIFY row_number() OVER (PARTITION BY capture, fold, elevation ORDER BY camera) = 1),\n"
    if patch:
        return own + shared(width) + f""", cells AS (SELECT capture, a, b, row // {step} AS cy, col // {step} AS cx, count(*) AS n FROM shared GROUP BY ALL)
SELECT capture, a, b, CAST(py * {step} AS INTEGER) AS y, CAST(px * {step} AS INTEGER) AS x FROM (SELECT *, cy - dy AS py, cx - dx AS px FROM cells, range({patch // step}) u(dy), range({patch // step}) v(dx))
GROUP BY capture, a, b, py, px HAVING sum(n) = {patch * patch} AND py * {step} < {width // 2 - patch} AND px * {step} < {width - patch}"""
    return own + shared(width // 8) + f""", f AS (SELECT capture, a, b, min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1, count(DISTINCT col) AS n FROM shared GROUP BY ALL),
g AS (SELECT *, c0 = 0 OR c1 = {width // 8 - 1} OR n <= c1 - c0 AS seam FROM f)
SELECT capture, a, b, CAST(greatest((r0 - 1) * 8 // {step} * {step}, 0) AS INTEGER) AS top, CAST(least((r1 + 2) * 8, {width // 2}) AS INTEGER) AS bottom,
  CAST(CASE WHEN seam THEN 0 ELSE greatest((c0 - 1) * 8 // {step} * {step}, 0) END AS INTEGER) AS "left", CAST(CASE WHEN seam THEN {width} ELSE least((c1 + 2) * 8, {width}) END AS INTEGER) AS "right" FROM g"""


def _scales_sql() -> str:
    """SQL of the singular values on a grid of 32 columns over tiles of 12 pixels."""
    lon, lat = "radians((col + {c} + 0.5::DOUBLE) / 32 * 360 - 180 - yaw)", "radians(90 - (row + {r} + 0.5::DOUBLE) / 16 * 180)"
    ahead = f"(cos({lat}) * cos({lon}) * cos(radians(elevation)) + sin({lat}) * sin(radians(elevation)))"
    x = f"((cos({lat}) * sin({lon}) / {ahead} / tan(radians(fov) / 2)) + 1) * 6"
    y = f"(((cos({lat}) * cos({lon}) * sin(radians(elevation)) - sin({lat}) * cos(radians(elevation))) / {ahead} / tan(radians(fov) / 2)) + 1) * 6"
    at = ", ".join(f"{e.format(c=c, r=r)} AS {n}{i}, {ahead.format(c=c, r=r)} AS f{n}{i}" for n, e in (("x", x), ("y", y)) for i, (c, r) in enumerate(((0, 0), (1, 0), (0, 1))))
    return _REGISTRY + f""", grid AS (SELECT DISTINCT capture, yaw, elevation, fov, row, col FROM captures, range(16) r(row), range(32) c(col)),
placed AS (SELECT capture, row, col, {at} FROM grid), steps AS (SELECT capture, row, col, x1 - x0 AS a, x2 - x0 AS b, y1 - y0 AS c, y2 - y0 AS d FROM placed WHERE fx0 > 0 AND x0 BETWEEN 0 AND 12 AND y0 BETWEEN 0 AND 12),
parts AS (SELECT capture, row, col, (a * a + b * b + c * c + d * d) / 2 AS m, sqrt(power((a * a + b * b - c * c - d * d) / 2, 2) + power(a * c + b * d, 2)) AS s FROM steps),
scales AS (SELECT capture, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, min(sqrt(m + s)) AS major, arg_min(sqrt(greatest(m - s, 0)), (sqrt(m + s), sqrt(greatest(m - s, 0)))) AS minor, count(*) AS views FROM parts GROUP BY ALL)
"""


_SINC = "CASE WHEN abs({v}) < 1e-12 THEN 1 ELSE sin({v}) / ({v}) END"


def _weights_sql(size: int, new: int) -> str:
    """SQL of the rows (\"to\", \"at\", w) of Lanczos weights."""
    step = f"({size}::DOUBLE / {new})"
    t = f"(((j + 0.5 - (i + 0.5) * {step}) / greatest({step}, 1)) * pi())"
    return f"""SELECT i AS "to", j AS "at", k / sum(k) OVER (PARTITION BY i) AS w FROM (SELECT i, j, CASE WHEN abs({t}) < 3 * pi() THEN ({_SINC.format(v=t)}) * ({_SINC.format(v=t + ' / 3')}) ELSE 0 END AS k FROM range({new}) a(i), range({size}) b(j)
  WHERE j >= floor((i + 0.5) * {step} - 3 * greatest({step}, 1) + 0.5) AND j < floor((i + 0.5) * {step} + 3 * greatest({step}, 1) + 0.5))"""


ORACLE_SQL: dict[str, str] = {
    "tile_files": _LISTING + 'SELECT path, root, camera, "inner", stem, frame, CAST(digits AS INTEGER) AS digits, format FROM files',
    "tile_directories": _LISTING + "SELECT * FROM folders",
    "camera_files": _LISTING + "SELECT * FROM cameras",
    "source_problems": _LISTING + "SELECT * FROM problems",
    "shared_tile_frames": _LISTING + "SELECT * FROM shared",
    "source_sets": _LISTING + "SELECT *, cameras >= 2 AND frames > 0 AND faults = 0 AS usable FROM sets",
    "first_usable_root": _LISTING + "SELECT root, stem, cameras, frames FROM sets WHERE cameras >= 2 AND frames > 0 AND faults = 0 QUALIFY root = min(root) OVER ()",
    "candidate_roots": """WITH f AS (SELECT DISTINCT '/data/run' || c_custkey % 90 || CASE WHEN c_custkey % 3 = 0 THEN '/take' || c_custkey ELSE '' END AS root FROM customer)
SELECT root, CASE WHEN root = '/data/run6' THEN 0 WHEN root LIKE '/data/run6/%' THEN 1 ELSE 2 END AS rank FROM f WHERE root LIKE '/data/run6/%' OR root NOT LIKE '/data/run%/%'""",
    "tile_paths": _LISTING + "SELECT root, frame, root || '/Camera01/' || stem || '.' || printf('%04d', frame) || '.png' AS path FROM shared",
    "sample_files": _LISTING + "SELECT path, length FROM sample",
    "files_to_copy": _LISTING + "SELECT path, length FROM sample WHERE camera > 2 OR frame % 2 = 1",
    "source_survey": _EVERY_DIGIT + "SELECT root, round(total_bytes / greatest(frames, 1) / 1048576.0::DOUBLE, 9) AS mib, CASE WHEN cameras = 4 THEN round(total_bytes / greatest(frames, 1) / 1048576.0::DOUBLE * 4 / cameras, 9) END AS distinct_mib FROM sets",
    "frame_gaps": _LISTING + "SELECT root, camera, frame + 1 AS first_missing, ahead - 1 AS last_missing FROM (SELECT *, lead(frame) OVER (PARTITION BY root, camera ORDER BY frame) AS ahead FROM (SELECT DISTINCT root, camera, frame FROM files)) WHERE ahead > frame + 1",
    "pixel_scales": _scales_sql() + "SELECT capture, row, col, round(major, 6) AS major, round(minor, 6) AS minor, views FROM scales",
    "scales_by_band": _scales_sql() + """SELECT capture, CASE WHEN abs(90 - (row + 0.5) / 16 * 180) < 30 THEN 'equator' WHEN abs(90 - (row + 0.5) / 16 * 180) < 70 THEN 'middle' WHEN abs(90 - (row + 0.5) / 16 * 180) < 85 THEN 'polar' ELSE 'cap' END AS band,
  round(min(major), 6) AS major_least, round(median(major), 6) AS major_median, round(max(major), 6) AS major_most, round(min(minor), 6) AS minor_least, round(median(minor), 6) AS minor_median, round(max(minor), 6) AS minor_most,
  round(median(major / greatest(minor, 1e-9)), 6) AS anisotropy, round(avg(CAST(major > 1 AS DOUBLE)), 6) AS minified FROM scales GROUP BY ALL""",
    "lanczos_pictures": f"""WITH wx AS ({_weights_sql(8, 5)}), wy AS ({_weights_sql(8, 12)})
SELECT vec_id, CAST(wy."to" AS INTEGER) AS y, CAST(wx."to" AS INTEGER) AS x, round(sum(CAST(embedding[wy."at" * 8 + wx."at" + 1] AS DOUBLE) * wx.w * wy.w), 6) AS level FROM embeddings, wx, wy GROUP BY vec_id, wy."to", wx."to\"""",
    "overlap_boxes": _overlap_sql(128, 8),
    "overlap_patches": _overlap_sql(64, 4, 8),
    "rig_twenty": _REGISTRY + "SELECT s_suppkey AS capture, twenty.* FROM twenty, supplier",
    "rig_fifteen": _REGISTRY + "SELECT s_suppkey AS capture, fifteen.* FROM fifteen, supplier",
    "panorama_widths": """WITH w AS (SELECT p_partkey, CASE WHEN p_partkey % 200 > 0 AND p_partkey % 200 < 180 THEN CAST(round_even(p_size * 32 * 360.0::DOUBLE / (p_partkey % 200), 0) AS BIGINT) END AS w FROM part)
SELECT p_partkey, w + w % 2 AS native_width, CASE WHEN w IS NOT NULL THEN least(w + w % 2, 3840) END AS analysis_width, CAST(((p_partkey * 7 - 500) % 360 + 360) % 360 AS DOUBLE) AS yaw FROM w""",
    "rig_of_count": "SELECT capture, cameras, CASE cameras WHEN 20 THEN 'twenty' WHEN 15 THEN 'fifteen' END AS rig FROM (SELECT c_custkey % 97 AS capture, count(*) AS cameras FROM customer GROUP BY ALL)",
    "matching_rigs": _REGISTRY + """, have AS (SELECT capture, list(round(yaw, 3) % 360 || ' ' || round(elevation, 3) || ' ' || fov ORDER BY 1) AS v FROM captures GROUP BY capture),
want AS (SELECT rig, list(round(yaw, 3) % 360 || ' ' || round(elevation, 3) || ' ' || fov ORDER BY 1) AS v FROM registered GROUP BY rig)
SELECT capture, rig FROM have JOIN want ON list_sort(have.v) = list_sort(want.v)""",
    "horizon_pairs": _REGISTRY + """, own AS (SELECT capture, yaw % 360 AS yaw, elevation, min(camera) AS camera FROM captures GROUP BY ALL)
SELECT a.capture, a.camera AS a, b.camera AS b FROM own a JOIN own b ON a.capture = b.capture AND a.yaw = b.yaw AND b.elevation = 0 WHERE abs(a.elevation) = 45""",
    "ring_pairs": _REGISTRY + """, own AS (SELECT capture, yaw % 360 AS yaw, min(camera) AS camera FROM captures WHERE elevation = 0 GROUP BY ALL)
SELECT capture, camera AS a, coalesce(lead(camera) OVER (PARTITION BY capture ORDER BY yaw), first_value(camera) OVER (PARTITION BY capture ORDER BY yaw)) AS b FROM own""",
    "manifest_problems": _MANIFESTS + "SELECT capture, field, kind FROM named WHERE kind <> wanted UNION ALL SELECT capture, NULL, 'not json' FROM manifests WHERE NOT whole",
    "manifest_views": _MANIFESTS + "SELECT * FROM views",
    "manifest_disk_differences": _MANIFESTS + """, n AS (SELECT capture, lower(directory) AS directory FROM views), t AS (SELECT capture, lower(directory) AS directory FROM disk)
SELECT capture, directory, 'missing' AS problem FROM n ANTI JOIN t USING (capture, directory) UNION ALL SELECT capture, directory, 'extra' FROM t ANTI JOIN n USING (capture, directory)""",
    "views_in_camera_order": _MANIFESTS + "SELECT v.*, d.camera FROM views v JOIN disk d ON v.capture = d.capture AND lower(v.directory) = lower(d.directory)",
    "rate_labels": """SELECT o_orderkey, CASE WHEN n > 0 AND d > 0 THEN regexp_replace(printf('%.4f', n / d), '\\.?0+$', '') END AS label FROM (SELECT o_orderkey,
  CAST((o_orderkey % 60) * CASE WHEN o_orderkey % 2 = 0 THEN 1000 ELSE 1 END AS DOUBLE) AS n, CASE WHEN o_orderkey % 2 = 0 THEN 1001 WHEN o_orderkey % 9 = 0 THEN 0 ELSE 1 END AS d FROM orders)""",
    "rig_decision": """SELECT o_orderkey AS capture, CASE WHEN o_orderkey % 3 = 2 THEN CASE WHEN o_orderkey % 4 < 2 THEN 'manifest' ELSE 'refused' END WHEN o_orderkey % 5 < 3 THEN 'registry' ELSE 'refused' END AS decided_by,
  CASE WHEN o_orderkey % 3 = 2 THEN CASE WHEN o_orderkey % 4 < 2 THEN 'twenty' END WHEN o_orderkey % 5 < 3 THEN 'fifteen' END AS rig, CASE WHEN o_orderkey % 3 = 1 THEN 'no record of frames' END AS set_aside FROM orders""",
    "matte_channels": _MANIFESTS + """SELECT capture, 'm' || capture % 4 AS image, c.channel, CASE c.channel WHEN 'R' THEN capture ELSE 2 END AS id, CASE c.channel WHEN 'R' THEN 'g' ELSE 'h' END AS "group"
FROM manifests, (VALUES ('R'), ('B')) c(channel) WHERE whole AND capture % 5 = 0""",
    "matte_of_stem": _MANIFESTS + "SELECT capture, s.stem, 'm' || capture % 4 AS image FROM manifests, (VALUES ('S1'), ('S2')) s(stem) WHERE whole AND capture % 5 = 0",
}
