"""Hold-out of interpolated frames: every second frame is predicted from its neighbours and scored against the true one.

Frames are rows (keys, frame, pixels) of an equirectangular grid of levels, row by row; scores are means and percentiles
over pixels, so a frame's pixels are spread over tasks and only counts and sums are shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class View:
    """Size of the scored frames, side of a block of pixels, and degrees at each side that count as the wrap."""

    width: int
    height: int
    block: int = 64
    wrap: float = 3.0

    def latitude(self, y: Column) -> Column:
        return (0.5 - (y + 0.5) / self.height) * 180.0

    @property
    def middle(self) -> tuple[int, int]:
        """First row within 60 degrees of the equator, and how many from there fill whole blocks."""
        inside = [y for y in range(self.height) if abs((0.5 - (y + 0.5) / self.height) * 180.0) < 60]
        return inside[0], len(inside) // self.block * self.block


def predicted(frames: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, frame, method, pixels): odd frames from the even ones beside them, as their mean rounded up ("blend") and as the
    earlier one ("repeat"). A frame without both neighbours is not predicted."""
    even = frames.where("frame % 2 = 0")
    before = even.select(*keys, (F.col("frame") + 1).alias("frame"), F.col("pixels").alias("_a"))
    after = even.select(*keys, (F.col("frame") - 1).alias("frame"), F.col("pixels").alias("_b"))
    mean = F.zip_with("_a", "_b", lambda a, b: F.floor((a + b + 1) / 2).cast("int"))
    made = F.array(F.struct(F.lit("blend").alias("method"), mean.alias("pixels")), F.struct(F.lit("repeat").alias("method"), F.col("_a").cast("array<int>").alias("pixels")))
    return before.join(after, [*keys, "frame"]).select(*keys, "frame", F.inline(made))


def differences(made: DataFrame, truth: DataFrame, keys: list[str], view: View) -> DataFrame:
    """(keys, method, frame, y, x, difference) of every predicted pixel; pixels that either side lacks are none."""
    rows = made.join(truth.select(*keys, "frame", F.col("pixels").alias("_t")), [*keys, "frame"])
    gaps = rows.select(*keys, "method", "frame", F.posexplode(F.zip_with("pixels", "_t", lambda a, b: F.abs(a - b).cast("double"))).alias("_i", "difference"))
    return gaps.where("difference is not null").select(*keys, "method", "frame", F.floor(F.col("_i") / view.width).cast("int").alias("y"), (F.col("_i") % view.width).alias("x"), "difference")


def frame_scores(gaps: DataFrame, keys: list[str], view: View) -> DataFrame:
    """Per predicted frame: mean by solid angle, means of four bands of latitude, of the wrap and of the rest, 99.9th
    percentile, and the worst block with its first row and column. A part without pixels is null."""
    first, rows = view.middle
    strip = round(view.wrap / 360 * view.width)
    latitude = view.latitude(F.col("y"))
    inner = (F.col("y") >= first) & (F.col("y") < first + rows)
    edge = (F.col("x") < strip) | (F.col("x") >= view.width - strip)
    gap, area = F.col("difference"), F.cos(F.radians(latitude))
    only = lambda test: F.when(test, gap)
    parts = {
        "equator": F.abs(latitude) < 30, "middle": (F.abs(latitude) >= 30) & (F.abs(latitude) < 60), "zenith": latitude >= 60, "nadir": latitude <= -60,
        "wrap": inner & edge, "rest": inner & ~edge,
    }
    whole = gaps.groupBy(*keys, "method", "frame").agg(
        (F.sum(gap * area) / F.sum(area)).alias("weighted"), *[F.avg(only(test)).alias(name) for name, test in parts.items()], F.percentile(only(inner), F.lit(0.999)).alias("p999"),
    )
    top = blocks(gaps, keys, view).groupBy(*keys, "method", "frame").agg(F.max(F.struct("value", -F.col("row"), -F.col("column"))).alias("_m"))
    worst = top.select(*keys, "method", "frame", F.col("_m.value").alias("worst"), (-F.col("_m.col2")).alias("worst_row"), (-F.col("_m.col3")).alias("worst_column"))
    return whole.join(worst, [*keys, "method", "frame"], "left")


def blocks(gaps: DataFrame, keys: list[str], view: View) -> DataFrame:
    """Mean difference of each block of the middle rows, by its first row and column."""
    first, rows = view.middle
    snap = lambda c: (F.floor(c / view.block) * view.block).cast("int")
    inner = gaps.where((F.col("y") >= first) & (F.col("y") < first + rows) & (F.col("x") < view.width // view.block * view.block))
    return inner.groupBy(*keys, "method", "frame", (snap(F.col("y") - first) + first).alias("row"), snap(F.col("x")).alias("column")).agg(F.avg("difference").alias("value"))


def method_scores(gaps: DataFrame, keys: list[str], view: View) -> DataFrame:
    """Per method: means of the frames' scores, and the 99th percentile and maximum over all blocks of all its frames."""
    names = ["weighted", "equator", "middle", "zenith", "nadir", "wrap", "rest", "p999"]
    means = frame_scores(gaps, keys, view).groupBy(*keys, "method").agg(F.count(F.lit(1)).alias("frames"), *[F.avg(n).alias(n) for n in names])
    tail = blocks(gaps, keys, view).groupBy(*keys, "method").agg(F.percentile("value", F.lit(0.99)).alias("block_p99"), F.max("value").alias("block_most"))
    return means.join(tail, [*keys, "method"], "left")
