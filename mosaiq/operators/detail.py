"""Detail of small square tiles held as arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def laplacian(tiles: DataFrame, *, key: str = "vec_id", values: str = "embedding", side: int = 8) -> DataFrame:
    """Mean absolute discrete Laplacian over a tile's inner pixels, inside one row and without a shuffle."""
    inner = [r * side + c for r in range(1, side - 1) for c in range(1, side - 1)]
    v = F.transform(values, lambda x: x.cast("double"))
    places = F.array(*[F.lit(i) for i in inner])

    def at(i):
        return F.abs(F.get("_v", i - 1) + F.get("_v", i + 1) + F.get("_v", i - side) + F.get("_v", i + side) - 4 * F.get("_v", i))

    total = F.aggregate(F.transform(places, at), F.lit(0.0), lambda a, x: a + x)
    return tiles.withColumn("_v", v).select(key, (total / len(inner)).alias("laplacian"))


def gradient(tiles: DataFrame, *, key: str = "vec_id", values: str = "embedding", side: int = 8) -> DataFrame:
    """Mean over pixels with a right and a lower neighbour of the larger step to either."""
    inner = [r * side + c for r in range(side - 1) for c in range(side - 1)]
    places = F.array(*[F.lit(i) for i in inner])

    def step(i):
        return F.greatest(F.abs(F.get("_v", i + 1) - F.get("_v", i)), F.abs(F.get("_v", i + side) - F.get("_v", i)))

    total = F.aggregate(F.transform(places, step), F.lit(0.0), lambda a, x: a + x)
    return tiles.withColumn("_v", F.transform(values, lambda x: x.cast("double"))).select(key, (total / len(inner)).alias("gradient"))
