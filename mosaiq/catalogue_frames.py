"""Queries that write masters from the driver's tables, read them back, and their SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from mosaiq.sources import frames

SIDE = 4
#: Levels of a vector's picture: its first 48 components' sizes, scaled and folded into the kind's range.
FOLDED = {"png8": (100, 256), "png16": (20000, 65536), "exr": (100, 256)}


def shared_folder(spark, name: str) -> str:
    """A new folder in the shared one; a temporary one only where that is unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    return f"{(shared or 'file://' + tempfile.mkdtemp(prefix='mosaiq-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _written(spark, sf_dir, kind: str) -> str:
    """A frame of each vector, as masters of a kind; the folder that they are in."""
    scale, most = FOLDED[kind]
    level = F.transform(F.slice("embedding", 1, 3 * SIDE * SIDE), lambda v: (F.floor(F.abs(v.cast("double")) * scale) % most * (257 if kind == "exr" else 1)).cast("int"))
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.format_string("S.%06d", F.col("vec_id")).alias("name"), F.lit(SIDE).alias("width"), F.lit(SIDE).alias("height"), level.alias("levels"))
    frames.register(spark)
    folder = shared_folder(spark, "masters")
    # few bytes and much work: as many tasks as the session has
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "name")
    rows.write.format("masters").mode("append").option("path", folder).option("kind", kind).save()
    return folder


def _read(spark, folder: str, only: str = "pixels"):
    rows = spark.read.format("tiles").option("path", folder).option("only", only).load()
    return rows.withColumn("vec_id", F.regexp_extract("path", r"S\.(\d+)\.", 1).cast("long"))


def _masters(kind: str):
    def query(spark, sf_dir):
        rows = _read(spark, _written(spark, sf_dir, kind))
        if kind == "exr":
            levels = frames.levels_of_halves(rows, spark).withColumn("codes", F.transform("levels", lambda v: F.rint(v).cast("int")))
            rows = levels.withColumn("vec_id", F.regexp_extract("path", r"S\.(\d+)\.", 1).cast("long"))
        return rows.select("vec_id", "y", F.posexplode("codes").alias("place", "level"))

    return query


def _headers(spark, sf_dir):
    rows = _read(spark, _written(spark, sf_dir, "exr"), "headers")
    return rows.select("vec_id", "format", "width", "height", F.array_join("channels", "").alias("channels"), "packing", "problem")


def _stored(kind: str) -> str:
    scale, most = FOLDED[kind]
    return f"""SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(i // {3 * SIDE} AS INTEGER) AS y, CAST(i % {3 * SIDE} AS INTEGER) AS place, CAST(CAST(floor(abs(CAST(embedding[i + 1] AS DOUBLE)) * {scale}) AS BIGINT) % {most} AS INTEGER) AS level
FROM embeddings, range({3 * SIDE * SIDE}) r(i)"""


QUERIES = {f"{kind}_masters": _masters(kind) for kind in FOLDED} | {"master_headers": _headers}
ORACLE_SQL = {f"{kind}_masters": _stored(kind) for kind in FOLDED} | {
    "master_headers": f"SELECT CAST(vec_id AS BIGINT) AS vec_id, 'exr' AS format, {SIDE} AS width, {SIDE} AS height, 'BGR' AS channels, 'ZIP' AS packing, CAST(NULL AS VARCHAR) AS problem FROM embeddings",
}
