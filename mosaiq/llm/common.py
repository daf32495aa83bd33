"""Helpers shared by the training-data operators: materialised tables, ranks, Arrow slicing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
#: Tables written inside the innermost `scratch`: folders and names in the catalogue.
_inside: ContextVar[list[tuple[str, str]] | None] = ContextVar("inside", default=None)


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="mosaiq-")
    return _OWN[app]


def new_path(spark: SparkSession, name: str, table: str = "") -> str:
    folder = f"{work_dir(spark)}/mosaiq-{uuid.uuid4().hex}"
    if (held := _inside.get()) is not None:
        held.append((folder, table))
    return f"{folder}/{name}"


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession):
    """Tables written inside go at the end, and the session's batch size is what it was: the owner has written what it
    returns before that (with `kept`). Owners do not see each other's tables, so several can live in one application."""
    held: list[tuple[str, str]] = []
    token = _inside.set(held)
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    size = spark.conf.get(batch)
    try:
        yield
    finally:
        _inside.reset(token)
        spark.conf.set(batch, size)
        for folder, table in held:
            if table:
                spark.sql(f"DROP TABLE IF EXISTS {table}")
            remove(spark, folder)


def kept(df: DataFrame, name: str) -> DataFrame:
    """As `materialise`, for what outlives the scratch around it; `folder_of` names its folder to whoever removes it."""
    token = _inside.set(None)
    try:
        return materialise(df, name)
    finally:
        _inside.reset(token)


def folder_of(df: DataFrame) -> str | None:
    """The folder of a table that `kept` wrote; null for an empty one and for others."""
    found = {f.rsplit("/", 2)[0] for f in df.inputFiles()}
    return found.pop() if len(found) == 1 else None


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, and lost executors lose nothing."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise_by(df: DataFrame, key: str, name: str) -> DataFrame:
    """As `materialise`, in buckets of `key`, as many as shuffle partitions: a join by that key leaves this side in place.
    The catalogue's entry goes at once, as the plan holds the files and their buckets; the files stay."""
    spark = df.sparkSession
    table = f"mosaiq_{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("path", new_path(spark, name, table)).bucketBy(shuffle_partitions(spark), key).saveAsTable(table)
    rows = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return rows


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let at most so many rows go to Python at once, where the session leaves Spark's 10,000: texts are long, and each
    task holds a batch in the JVM, on its way and in the worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def text_column(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def by_bytes(batches: Iterator[pa.RecordBatch], column: int = 1, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut each batch into slices of about `limit` text bytes (never fewer than one row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        start = 0
        size = 0
        for i, n in enumerate(lengths):
            if size and size + n > limit:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += int(n)
        yield batch.slice(start)


def range_splitters(df: DataFrame, column: str, parts: int) -> list[int]:
    """At most parts - 1 boundaries that cut an integer column into runs of about equal row counts."""
    if parts < 2:
        return []
    shares = [i / parts for i in range(1, parts)]
    found = df.select(F.percentile_approx(F.col(column), shares, 10_000).alias("q")).head()
    return sorted(set(found.q or [])) if found else []


def bucket_of(column: str, splitters: list[int]):
    """Number of splitters that are <= the column: a range bucket, found in the JVM in two short steps."""
    if not splitters:
        return F.lit(0)
    step = max(1, int(len(splitters) ** 0.5))
    blocks = [splitters[i : i + step] for i in range(0, len(splitters), step)]
    value = F.col(column)
    top = F.array(*[F.lit(b[0]) for b in blocks])
    rest = F.array(*[F.array(*[F.lit(x) for x in b]) for b in blocks])
    block = F.size(F.filter(top, lambda s: s <= value))
    inside = F.size(F.filter(F.get(rest, block - 1), lambda s: s <= value))
    return F.when(value.isNull() | (block == 0), 0).otherwise((block - 1) * step + inside)


def slot_of(bucket: str, spark: SparkSession):
    """A number by which `repartition` into the shuffle partitions sends each bucket (from 0) to a partition of its own,
    while there are as many partitions as buckets: hashing the bucket itself would put several into one."""
    parts = shuffle_partitions(spark)
    place = F.pmod(F.hash(F.col("id").cast("int")), F.lit(parts))
    found = spark.range(32 * parts).groupBy(place.alias("p")).agg(F.min("id").cast("int").alias("id")).collect()  # a row per partition
    ids = [r["id"] for r in sorted(found, key=lambda r: r["p"])]
    return F.get(F.array(*[F.lit(i) for i in ids]), F.pmod(F.col(bucket), F.lit(len(ids))).cast("int"))


def global_rank(df: DataFrame, keys: list, name: str) -> tuple[DataFrame, int]:
    """Rank rows from 0 by keys without one task seeing all rows.

    The rows are range-partitioned by the whole key (so one hot leading key still spreads), sorted, and written once;
    a partition's rank offset is the sum of the sizes of the partitions before it.
    """
    spark = df.sparkSession
    parts = shuffle_partitions(spark)
    placed = materialise(
        df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_mid", F.monotonically_increasing_id()), name
    ).withColumns({"_part": F.shiftright("_mid", 33), "_at": F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = sorted((r["_part"], r["count"]) for r in placed.groupBy("_part").count().collect())  # a row per partition
    base, total = [], 0
    for part, n in sizes:
        base.append((part, total))
        total += n
    bases = spark.createDataFrame(base or [(0, 0)], "_part long, _base long")
    ranked = placed.join(F.broadcast(bases), "_part").withColumn("rank", F.col("_base") + F.col("_at"))
    return ranked.drop("_mid", "_part", "_at", "_base"), total
