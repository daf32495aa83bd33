"""Centroid clustering of quantised vectors in whole numbers, on distinct vectors with multiplicities.

Rows whose vector has exactly `parts` components, none null or non-finite, are kept; component x becomes floor(SCALE * x).
Equal quantised vectors are one row with a multiplicity, and Lloyd's rounds run on those rows: sums of a cluster are sums
of component times multiplicity, and a new centroid is floor(sum / count). In the end the distinct vectors' clusters are
joined back to the ids. A vector that makes up more than 1 in HOT of all rows is in a table of fewer than HOT rows, which
is broadcast; for all other vectors a shuffle on the vector has no hot key.

Defined results: components beyond +-LARGEST after scaling count as +-LARGEST, so a distance always fits 64 bits; rows of
equal vec_id are vectors of their own; the first centroids are those of the rows with the smallest hash, then the smallest
vector, so fewer than `clusters` kept rows give as many centroids as rows; a null vec_id hashes last; empty clusters keep
their centroid and have inertia 0 (no row shows them); sums over 64 bits become null; an empty table, or one with no vector
to keep, gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.llm import common

SCALE, LARGEST = 1024, 1 << 27
CLUSTERS, ROUNDS, PARTS, SEED = 8, 10, 64, 3
#: A vector held by more than one in so many rows is joined by broadcast.
HOT = 2000


def quantised(vectors: DataFrame, parts: int = PARTS) -> DataFrame:
    """(vec_id, q array<int>) of the rows to keep."""
    x = F.col("embedding").cast("array<double>")
    sound = (F.size(x) == parts) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    bound = LARGEST / SCALE
    clamped = F.transform(x, lambda v: F.floor(F.least(F.greatest(v, F.lit(-bound)), F.lit(bound)) * F.lit(float(SCALE))).cast("int"))
    return vectors.where(F.coalesce(sound, F.lit(False))).select(F.col("vec_id").cast("long"), clamped.alias("q"))


def _rows(column: pa.ListArray, parts: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, parts).astype(np.int64)


def nearest(q: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (the smaller at a tie) and the squared distance, exact in 64 bits."""
    best, where = None, np.zeros(len(q), np.int32)
    for i, c in enumerate(centroids):
        d = q - c
        d = np.einsum("ij,ij->i", d, d)
        if best is None:
            best = d
        else:
            closer = d < best
            where[closer], best = i, np.where(closer, d, best)
    return where, best


def _sums(distinct: DataFrame, centroids: np.ndarray) -> list:
    """(cluster, i, n, s): a cluster's rows and its sum of component i, under the given centroids; a task sends the shuffle,
    and the shuffle the driver, a row a cluster and component."""
    parts = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            if batch.num_rows:
                q, m = _rows(batch.column(0), parts), batch.column(1).to_numpy(zero_copy_only=False)
                where, _ = nearest(q, centroids)
                for c in np.unique(where):
                    own = where == c
                    count[c] += m[own].sum()
                    total[c] += m[own] @ q[own]
        used = np.flatnonzero(count).astype(np.int32)
        columns = [np.repeat(used, parts), np.tile(np.arange(parts, dtype=np.int32), len(used)), np.repeat(count[used], parts), total[used].ravel()]
        yield pa.record_batch([pa.array(c) for c in columns], ["cluster", "i", "n", "s"])

    shares = distinct.select("q", "m").mapInArrow(run, "cluster int, i int, n long, s long")
    return shares.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()


def lloyd(distinct: DataFrame, centroids: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids after the rounds over (q, m); a round that moves none ends them, as all later ones would repeat it."""
    for _ in range(rounds):
        moved = centroids.copy()
        for row in _sums(distinct, centroids):
            moved[row["cluster"], row["i"]] = int(row["s"]) // row["n"]
        if np.array_equal(moved, centroids):
            break
        centroids = moved
    return centroids


def assigned(distinct: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(q, m, cluster, distance)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                where, far = nearest(_rows(batch.column(0), centroids.shape[1]), centroids)
                yield pa.record_batch([*batch.columns, pa.array(where), pa.array(far)], ["q", "m", "cluster", "distance"])

    return distinct.mapInArrow(run, "q array<int>, m long, cluster int, distance long")


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, parts: int = PARTS) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), a row for each kept vector."""
    spark = vectors.sparkSession
    shape = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    kept = quantised(vectors, parts)
    distinct = common.materialise(kept.groupBy("q").agg(F.count("*").alias("m")), "distinct_vectors")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    firsts = kept.select(order.alias("h"), "q").orderBy(F.col("h").asc_nulls_last(), "q").limit(clusters).collect()
    if not firsts:
        return spark.createDataFrame([], shape)
    centroids = lloyd(distinct, np.array([r["q"] for r in firsts], np.int64), rounds)
    ends = common.materialise(assigned(distinct, centroids), "assigned_vectors")
    wide = F.col("distance").cast("decimal(38,0)") * F.col("m").cast("decimal(19,0)")
    inertia = ends.groupBy("cluster").agg(F.sum(wide.cast("decimal(38,0)")).alias("s")).collect()  # a row a cluster
    fits = lambda n: int(n) if n is not None and n < 1 << 63 else None
    total = fits(sum(r["s"] for r in inertia)) if all(r["s"] is not None for r in inertia) else None
    told = spark.createDataFrame(
        [(r["cluster"], fits(r["s"]), total, hashlib.sha256(",".join(map(str, centroids[r["cluster"]].tolist())).encode()).hexdigest()) for r in inertia],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    limit = distinct.agg(F.sum("m")).head()[0] // HOT
    hot, cold = ends.where(F.col("m") > limit), ends.where(F.col("m") <= limit)
    is_hot = F.broadcast(hot.select("q", F.lit(True).alias("hot"), F.col("cluster").alias("hot_cluster"), F.col("distance").alias("hot_distance")))
    marked = kept.join(is_hot, "q", "left")
    warm = marked.where("hot").select("vec_id", F.col("hot_cluster").alias("cluster"), F.col("hot_distance").alias("distance"))
    rest = marked.where("hot is null").select("vec_id", "q").join(cold.select("q", "cluster", "distance"), "q").drop("q")
    return warm.unionByName(rest).join(F.broadcast(told), "cluster").select(*[c.split()[0] for c in shape.split(", ")])


def op11_weighted_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql() -> str:
    """The same in long form: a row a component; each round is a pair of tables."""
    steps = [
        """kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)""",
        "long AS MATERIALIZED (SELECT r, unnest(q) AS x, unnest(range(64)) AS i FROM kept)",
        """c0 AS MATERIALIZED (SELECT c, unnest(q) AS y, unnest(range(64)) AS i FROM (
  SELECT q, row_number() OVER (ORDER BY sha256('3:' || vec_id), q) - 1 AS c FROM kept ORDER BY c LIMIT 8))""",
    ]
    for k in range(ROUNDS + 1):
        steps.append(f"""a{k} AS MATERIALIZED (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
  SELECT r, c, sum((x - y) * (x - y)) AS d FROM long JOIN c{k} USING (i) GROUP BY r, c) GROUP BY r)""")
        if k < ROUNDS:
            steps.append(f"""c{k + 1} AS MATERIALIZED (SELECT c, i, coalesce((s - (((s % n) + n) % n)) // n, y) AS y FROM c{k} LEFT JOIN (
  SELECT c, i, sum(x) AS s, count(*) AS n FROM long JOIN a{k} USING (r) GROUP BY c, i) USING (c, i))""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM a{ROUNDS} JOIN kept USING (r) JOIN (SELECT c, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY i)) AS h FROM c{ROUNDS} GROUP BY c) USING (c)"""


ORACLE = _sql()
