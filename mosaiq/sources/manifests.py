"""Capture manifests: JSON texts read as variants, every field checked for presence and type, views held against the disk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fields of the contract and the type each must have.
FIELDS = (
    ("schema", "string"), ("schema_version", "integer"), ("state", "string"), ("rig.type", "string"), ("rig.views", "list"),
    ("tiles.width", "integer"), ("tiles.height", "integer"), ("tiles.format", "string"), ("tiles.stems", "list"),
    ("frames.rate.numerator", "integer"), ("frames.rate.denominator", "integer"),
)
VIEW_FIELDS = (("directory", "string"), ("pitch", "number"), ("yaw", "number"), ("roll", "number"), ("fov", "number"))


#: Kinds by the name that a variant's schema begins with; any other is a string.
KINDS = {"VOID": "null", "BIGINT": "integer", "DOUBLE": "number", "DECIMAL": "number", "FLOAT": "number", "BOOLEAN": "boolean", "ARRAY": "list", "OBJECT": "object"}


def json_kind(value: Column) -> Column:
    """Kind of a variant: missing (no such path), null, integer, number, string, boolean, list or object."""
    name = F.substring_index(F.substring_index(F.schema_of_variant(value), "(", 1), "<", 1)
    known = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    return F.when(value.isNull(), "missing").otherwise(F.coalesce(known[name], F.lit("string")))


def _misfits(kind: Column, wanted: Column) -> Column:
    return (kind != wanted) & ~((wanted == "number") & (kind == "integer"))


def field_problems(manifests: DataFrame, fields=FIELDS, *, key: str = "capture", text: str = "manifest") -> DataFrame:
    """(key, field, kind): fields that are missing or of another type; a text that is not JSON has one row, field null.

    Each field is looked up and named once a manifest, as an element of an array: in a chain of conditions it would be again
    for every one of them."""
    parsed = manifests.select(key, F.try_parse_json(F.col(text)).alias("_v"))
    values = F.array(*[F.struct(F.lit(name).alias("field"), F.lit(wanted).alias("wanted"), F.variant_get("_v", "$." + name, "variant").alias("value")) for name, wanted in fields])
    named = F.transform(values, lambda x: F.struct(x["field"].alias("field"), x["wanted"].alias("wanted"), json_kind(x["value"]).alias("kind")))
    broken = F.array(F.struct(F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("wanted"), F.lit("not json").alias("kind")))
    found = F.when(F.col("_v").isNull(), broken).otherwise(F.filter(named, lambda x: _misfits(x["kind"], x["wanted"])))
    return parsed.select(key, F.explode(found).alias("p")).select(key, "p.field", "p.kind")


def views(manifests: DataFrame, *, key: str = "capture", text: str = "manifest") -> DataFrame:
    """A row per view: its place in the manifest, directory, pitch, yaw, roll, fov (null where absent or of another type)."""
    parsed = manifests.select(key, F.variant_get(F.try_parse_json(F.col(text)), "$.rig.views", "array<variant>").alias("_views"))
    get = lambda name, kind: F.try_variant_get("v", "$." + name, kind).alias(name)
    rows = parsed.select(key, F.posexplode("_views").alias("place", "v"))
    return rows.select(key, "place", get("directory", "string"), *[get(n, "double") for n in ("pitch", "yaw", "roll", "fov")])


def disk_differences(views: DataFrame, disk: DataFrame, *, key: str = "capture") -> DataFrame:
    """(key, directory, problem): directories that only the manifest or only the disk has, or that it names twice; names are
    compared without case."""
    named = views.groupBy(key, F.lower("directory").alias("directory")).agg(F.count(F.lit(1)).alias("n"))
    there = disk.select(key, F.lower("directory").alias("directory"), F.lit(True).alias("there")).distinct()
    what = F.when(F.col("n") > 1, "repeated").when(F.col("there").isNull(), "missing").when(F.col("n").isNull(), "extra")
    return named.join(there, [key, "directory"], "full").select(key, "directory", what.alias("problem")).where("problem is not null")


def in_camera_order(views: DataFrame, disk: DataFrame, *, key: str = "capture") -> DataFrame:
    """Views with their camera, found by directory."""
    cameras = disk.select(key, F.lower("directory").alias("_d"), "camera")
    return views.withColumn("_d", F.lower("directory")).join(cameras, [key, "_d"]).drop("_d")


def rate_label(numerator: Column, denominator: Column) -> Column:
    """Frames a second to four decimals, without trailing zeros; null for a rate that is not positive."""
    text = F.regexp_replace(F.format_string("%.4f", numerator.cast("double") / denominator), r"\.?0+$", "")
    return F.when((numerator > 0) & (denominator > 0), text)


def rig_decision(sets: DataFrame) -> DataFrame:
    """Which rig stitches a set: its manifest's where that is usable, else the registry's by count, else none.

    sets: (capture, manifest_problem, manifest_rig, count_rig); manifest_problem null means usable, '' no manifest.
    """
    usable = F.col("manifest_problem").isNull()
    by = F.when(usable & F.col("manifest_rig").isNotNull(), "manifest").when(usable, "refused").when(F.col("count_rig").isNotNull(), "registry").otherwise("refused")
    rig = F.when(by == "manifest", F.col("manifest_rig")).when(by == "registry", F.col("count_rig"))
    aside = F.when(~usable & (F.col("manifest_problem") != ""), F.col("manifest_problem"))
    return sets.select("capture", by.alias("decided_by"), rig.alias("rig"), aside.alias("set_aside"))


def matte_channels(manifests: DataFrame, *, key: str = "capture", text: str = "manifest") -> DataFrame:
    """(key, image, channel, id, group) of the channels R, G, B in use of every ID matte image; captures without have none."""
    parsed = manifests.select(key, F.variant_get(F.try_parse_json(F.col(text)), "$.id_mattes.images", "array<variant>").alias("_m"))
    rows = parsed.select(key, F.explode("_m").alias("v"))
    each = F.array(*[F.struct(F.lit(c).alias("channel"), F.try_variant_get("v", f"$.channels.{c}.id", "long").alias("id"), F.try_variant_get("v", f"$.channels.{c}.group", "string").alias("group")) for c in "RGB"])
    rows = rows.select(key, F.try_variant_get("v", "$.name", "string").alias("image"), F.explode(each).alias("c"))
    return rows.select(key, "image", "c.*").where("id is not null")


def matte_of_stem(manifests: DataFrame, *, key: str = "capture", text: str = "manifest") -> DataFrame:
    """(key, stem, image): the ID matte image whose stems hold each stem."""
    parsed = manifests.select(key, F.variant_get(F.try_parse_json(F.col(text)), "$.id_mattes.images", "array<variant>").alias("_m"))
    rows = parsed.select(key, F.explode("_m").alias("v")).select(key, F.try_variant_get("v", "$.name", "string").alias("image"), F.try_variant_get("v", "$.stems", "array<string>").alias("stems"))
    return rows.select(key, F.explode("stems").alias("stem"), "image")
