"""Small objects in pictures, their motion from frame to frame, and whether the neighbouring camera shows them too.

Pictures are rows (keys, camera, frame, width, luma: rows of levels). Frames t-1, t and t+1 meet in runs of `RUN` frames: a
picture is shuffled once to its run, and at a run's edge to the next one too; a run is read in order of frames, of which a
task holds three. No table of pictures is ever broadcast. All objects of a picture are handled as one stack in NumPy. Matching
is a normalised correlation over a search window: products by FFT, the windows' norms from summed-area tables. What is
found becomes rows, and shares, offsets and residuals are groupings of those.

Defined results: null pictures, and those whose neighbour in time or partner is missing, give no rows; objects near an
edge are no candidates; with no objects all tables are empty; ties of the correlation go to the first position by row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Frames that are dealt out together.
RUN = 16


@dataclass(frozen=True)
class Scale:
    """Sizes in pixels and thresholds; the defaults are the fixed values for panoramas of 3840 columns."""

    object: int = 7  # half width of an object
    surround: int = 12  # half width of the neighbourhood it stands out from
    half: int = 10  # half width of the patch that is correlated
    radius: int = 30  # of the search
    contrast: float = 12.0  # levels that it stands out by
    flat: float = 16.0  # deviation of the ring around it at most
    tracked: float = 0.6  # correlation that counts as the same object a frame before
    shaped: float = 0.5  # and in the other camera
    moved: float = 1.0  # pixels a frame that count as motion
    kept: float = 0.5  # share of the contrast that the other camera must show
    fewest: int = 5  # matches from which their median is the pair's static offset
    most: int = 200  # movers of a picture, thinned evenly
    curve: tuple[float, ...] = (0.09, 0.18, 0.36)  # shares of the radius within which matches are counted: 0.25, 0.5 and 1 of 2.8 degrees


def box_means(luma: np.ndarray, radius: int) -> np.ndarray:
    """Mean of the square around each pixel, edges repeated."""
    n = 2 * radius + 1
    table = np.pad(np.pad(luma, radius, mode="edge"), ((1, 0), (1, 0))).cumsum(0).cumsum(1)
    return (table[n:, n:] - table[:-n, n:] - table[n:, :-n] + table[:-n, :-n]) / (n * n)


def _around(luma: np.ndarray, y: np.ndarray, x: np.ndarray, half: int) -> np.ndarray:
    span = np.arange(-half, half + 1)
    return luma[y[:, None, None] + span[:, None], x[:, None, None] + span]


def _ring(luma: np.ndarray, y: np.ndarray, x: np.ndarray, s: Scale) -> np.ndarray:
    """The columns two object widths to either side: what an object stands on."""
    down = y[:, None] + np.arange(-2 * s.object, 2 * s.object)
    return np.concatenate([luma[down, x[:, None] + side * 2 * s.object] for side in (-1, 1)], axis=1)


def strengths(luma: np.ndarray, y: np.ndarray, x: np.ndarray, s: Scale, sign: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Levels by which objects leave their ring's median, and in which direction (given, or the larger one)."""
    level, patch = np.median(_ring(luma, y, x, s), axis=1), _around(luma, y, x, s.object)
    up, down = patch.max(axis=(1, 2)) - level, level - patch.min(axis=(1, 2))
    sign = np.where(up >= down, 1.0, -1.0) if sign is None else sign
    return np.where(sign > 0, up, down), sign


def find_objects(luma: np.ndarray, s: Scale, edge: int) -> tuple[np.ndarray, np.ndarray]:
    """(y, x) of the first pixel that stands out in each cell of two object widths, if the ring around it is flat."""
    y, x = np.nonzero(np.abs(luma - box_means(luma, s.surround)) > s.contrast)
    inside = (np.minimum(y, x) > edge) & (y < luma.shape[0] - edge) & (x < luma.shape[1] - edge)
    y, x = y[inside], x[inside]
    _, first = np.unique(y // (2 * s.object) * luma.shape[1] + x // (2 * s.object), return_index=True)
    y, x = y[first], x[first]
    calm = _ring(luma, y, x, s).std(axis=1) < s.flat if len(y) else np.zeros(0, bool)
    return y[calm], x[calm]


def correlation_maps(patches: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Normalised correlation of each patch at every place of its window."""
    n, side = patches.shape[0], patches.shape[1]
    size = windows.shape[1]
    own = patches - patches.mean(axis=(1, 2), keepdims=True)
    moved = windows - windows.mean(axis=(1, 2), keepdims=True)  # keeps the sums of squares small
    spectrum = np.fft.rfft2(moved) * np.fft.rfft2(own, s=(size, size)).conj()
    places = size - side + 1
    products = np.fft.irfft2(spectrum, s=(size, size))[:, :places, :places]
    tables = np.zeros((2, n, size + 1, size + 1))
    tables[:, :, 1:, 1:] = np.stack([moved, moved**2]).cumsum(2).cumsum(3)
    total, squares = tables[..., side:, side:] - tables[..., :-side, side:] - tables[..., side:, :-side] + tables[..., :-side, :-side]
    norms = np.sqrt(np.maximum(squares - total**2 / side**2, 0)) * np.sqrt((own**2).sum(axis=(1, 2)))[:, None, None]
    return products / np.maximum(norms, 1e-9)


def best_places(maps: np.ndarray, limit: float) -> np.ndarray:
    """(n, 3) of dy, dx and correlation of the best place within `limit` pixels of the centre, refined by parabolas."""
    n, size = maps.shape[0], maps.shape[1]
    offset = np.arange(size) - size // 2
    near = np.hypot(offset[:, None], offset) <= limit
    y, x = np.divmod(np.where(near, maps, -np.inf).reshape(n, -1).argmax(axis=1), size)
    rows = np.arange(n)
    padded = np.pad(maps, ((0, 0), (1, 1), (1, 1)), constant_values=np.nan)
    peak = maps[rows, y, x]

    def vertex(before: np.ndarray, after: np.ndarray) -> np.ndarray:
        bend = before - 2 * peak + after
        good = bend < 0  # false beside the map's edge
        return np.where(good, np.clip((before - after) / np.where(good, 2 * bend, 1), -0.5, 0.5), 0.0)

    fy = vertex(padded[rows, y, x + 1], padded[rows, y + 2, x + 1])
    fx = vertex(padded[rows, y + 1, x], padded[rows, y + 1, x + 2])
    return np.stack([offset[y] + fy, offset[x] + fx, peak], axis=1)


def _matched(here: np.ndarray, there: np.ndarray, y: np.ndarray, x: np.ndarray, s: Scale) -> np.ndarray:
    return correlation_maps(_around(here, y, x, s.half), _around(there, y, x, s.half + s.radius))


def _picture(batch: pa.RecordBatch, name: str, i: int) -> np.ndarray:
    return batch.column(name)[i].values.to_numpy(zero_copy_only=False).astype(float).reshape(-1, batch.column("width")[i].as_py())


def _edge(s: Scale) -> int:
    return s.radius + s.half + 2 * s.object


def objects(pictures: DataFrame, *keys: str, scale: Scale = Scale()) -> DataFrame:
    """(keys, camera, frame, y, x, contrast, sign) of the small objects of each picture."""
    shape = [(k, t) for k, t in pictures.select(*keys, "camera", "frame").dtypes] + [("y", "int"), ("x", "int"), ("contrast", "double"), ("sign", "double")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                luma = _picture(batch, "luma", i)
                y, x = find_objects(luma, scale, 2 * scale.object)
                if len(y):
                    yield _rows(batch, i, len(keys) + 2, shape, y, x, *strengths(luma, y, x, scale))

    rows = pictures.where("luma is not null").select(*keys, "camera", "frame", "width", "luma")
    return rows.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in shape))


def _rows(batch: pa.RecordBatch, i: int, keys: int, shape: list, *columns: np.ndarray) -> pa.RecordBatch:
    """Rows of a picture's objects under its keys."""
    n = len(columns[0])
    kinds = {"int": np.int32, "double": np.float64}
    held = [batch.column(c).take(pa.array(np.full(n, i))) for c in range(keys)]
    return pa.record_batch(held + [pa.array(np.asarray(c).astype(kinds[t])) for c, (_, t) in zip(columns, shape[keys:])], [name for name, _ in shape])


def survival(found: DataFrame, blended: DataFrame, *keys: str, scale: Scale = Scale()) -> DataFrame:
    """(keys, frame, objects, median_kept, p10_kept, worst_kept, under_70): the share of each object's contrast that blended
    pictures (keys, frame, width, luma) keep, the sign as its own camera drew it."""
    listed = found.groupBy(*keys, "frame").agg(F.collect_list(F.struct("y", "x", "contrast", "sign")).alias("at"))  # cells of a picture at most
    shape = [(k, t) for k, t in blended.select(*keys, "frame").dtypes] + [("kept", "double")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                y, x, contrast, sign = np.array([[p[c] for c in ("y", "x", "contrast", "sign")] for p in batch.column("at")[i].as_py()]).T
                here, _ = strengths(_picture(batch, "luma", i), y.astype(int), x.astype(int), scale, sign)
                yield _rows(batch, i, len(keys) + 1, shape, here / contrast)

    # a table of pictures looks small before it is drawn, so it is said that none is to be broadcast
    rows = blended.where("luma is not null").join(listed.hint("merge"), [*keys, "frame"]).select(*keys, "frame", "width", "luma", "at")
    shares = rows.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in shape))
    return shares.groupBy(*keys, "frame").agg(
        F.count("kept").alias("objects"), F.median("kept").alias("median_kept"), F.percentile("kept", 0.1).alias("p10_kept"),
        F.min("kept").alias("worst_kept"), F.avg((F.col("kept") < 0.7).cast("double")).alias("under_70"))


def moving_objects(pictures: DataFrame, *keys: str, scale: Scale = Scale()) -> DataFrame:
    """(keys, camera, frame, y, x, contrast, sign, vy, vx) of objects that are found a frame before at another place."""
    by = [*keys, "camera", "frame"]
    shape = [(k, t) for k, t in pictures.select(*by).dtypes] + [("y", "int"), ("x", "int"), *[(c, "double") for c in ("contrast", "sign", "vy", "vx")]]
    known = pictures.where("luma is not null").dropna(subset=by)
    rows = _by_runs(_in_runs(known.select(*by, "width", "luma"), 0, 1), *keys, "camera")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, now, earlier, here = None, None, [], []
        for batch in batches:
            for i in range(batch.num_rows):
                *key, frame, own = (batch.column(c)[i].as_py() for c in (*keys, "camera", "_run", "frame", "_own"))
                if (key, frame) != (group, now):
                    earlier = here if key == group and frame == now + 1 else []
                    group, now, here = key, frame, []
                luma = _picture(batch, "luma", i)
                here.append(luma)
                if not earlier or not own:
                    continue
                y, x = find_objects(luma, scale, _edge(scale))
                if not len(y):
                    continue
                contrast, sign = strengths(luma, y, x, scale)
                for before in earlier:
                    found = best_places(_matched(luma, before, y, x, scale), scale.radius)
                    good = (contrast >= scale.contrast) & (found[:, 2] >= scale.tracked) & (np.hypot(found[:, 0], found[:, 1]) >= scale.moved)
                    if good.any():
                        yield _rows(batch, i, len(by), shape, y[good], x[good], contrast[good], sign[good], -found[good, 0], -found[good, 1])

    return rows.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in shape))


def _in_runs(rows: DataFrame, before: int, after: int) -> DataFrame:
    """Rows with their runs of RUN frames (`_run`); `_own` is false for the copies that a run has of so many frames before
    and after it."""
    of = lambda k: F.floor((F.col("frame") + k) / RUN)
    runs = F.array_distinct(F.array(*[of(k) for k in range(-before, after + 1)]))
    return rows.withColumn("_run", F.explode(runs)).withColumn("_own", F.col("_run") == of(0))


def _by_runs(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.repartition(*keys, "_run").sortWithinPartitions(*keys, "_run", "frame")


def correspondences(movers: DataFrame, pictures: DataFrame, pairs: DataFrame, *keys: str, scale: Scale = Scale()) -> DataFrame:
    """(keys, a, b, frame, y, x, vy, vx, ahead, within, dy, dx, correlation, kept): for each mover of camera a its best place
    in camera b's picture `ahead` frames later (-1, 0, 1), within each radius of the curve and the whole one (the last only
    where ahead is not 0), and the share of its contrast there. Pairs are few and broadcast behind their own columns a, b."""
    n = F.count(F.lit(1)).over(_by(keys))
    order = F.row_number().over(_by(keys).orderBy("y", "x")) - 1
    thin = movers.withColumns({"n": n, "i": order}).where(F.col("i") % F.ceil(F.col("n") / scale.most) == 0)
    listed = thin.groupBy(*keys, "camera", "frame").agg(F.sort_array(F.collect_list(F.struct("y", "x", "contrast", "sign", "vy", "vx"))).alias("at"))
    by = [*keys, "a", "b", "frame"]
    pairs = F.broadcast(pairs.select("a", "b").distinct())
    known = pictures.where("luma is not null").dropna(subset=[*keys, "camera", "frame"])
    empty = F.lit(None).cast(listed.schema["at"].dataType)
    columns = lambda df, role, luma, at: df.select(*by, F.lit(role).alias("role"), luma.alias("luma"), (F.col("width") if role < 2 else F.lit(None).cast("int")).alias("width"), at.alias("at"))
    own = known.join(pairs, F.col("camera") == F.col("a"))
    other = known.join(pairs, F.col("camera") == F.col("b"))
    marks = listed.join(pairs, F.col("camera") == F.col("a"))
    # movers and both pictures meet in runs, so pictures are shuffled as often as they take part in a pair, and joined to nothing
    held = columns(own, 0, F.col("luma"), empty).unionAll(columns(marks, 2, F.lit(None).cast(known.schema["luma"].dataType), F.col("at")))
    rows = _by_runs(_in_runs(held, 0, 0).unionAll(_in_runs(columns(other, 1, F.col("luma"), empty), 1, 1)), *keys, "a", "b")
    kinds = dict(rows.dtypes)
    shape = [(k, kinds[k]) for k in by] + [("ahead", "int"), ("y", "int"), ("x", "int")] + [(c, "double") for c in ("vy", "vx", "within", "dy", "dx", "correlation", "kept")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, {}  # of each frame: its keys, and rows of the three roles

        def told(until: float) -> Iterator[pa.RecordBatch]:
            for frame in sorted(f for f in held if f <= until):
                key, (lumas, _, marks) = held[frame]
                for ahead in (-1, 0, 1):
                    for luma, other, at in product(lumas, held[frame + ahead][1][1] if frame + ahead in held else [], marks):
                        y, x, contrast, sign, vy, vx = at
                        y, x = y.astype(int), x.astype(int)
                        maps = _matched(luma, other, y, x, scale)
                        for share in (1.0,) if ahead else (*scale.curve, 1.0):
                            found = best_places(maps, scale.radius * share)
                            kept, _ = strengths(other, y + np.rint(found[:, 0]).astype(int), x + np.rint(found[:, 1]).astype(int), scale, sign)
                            yield _rows(key, 0, len(by), shape, np.full(len(y), ahead), y, x, vy, vx, np.full(len(y), share), *found.T, kept / contrast)
                held[frame][1][0], held[frame][1][2] = [], []  # told once; the next frame looks back at its other picture
            for frame in [f for f in held if f < until]:
                del held[frame]

        for batch in batches:
            for i in range(batch.num_rows):
                *key, frame = (batch.column(c)[i].as_py() for c in (*keys, "a", "b", "_run", "frame"))
                if key != group:
                    yield from told(float("inf"))
                    group, held = key, {}
                elif frame not in held:
                    yield from told(frame - 2)
                if frame not in held:
                    held[frame] = (batch.select(by).take(pa.array([i])), [[], [], []])
                role = batch.column("role")[i].as_py()
                value = np.array([[p[c] for c in ("y", "x", "contrast", "sign", "vy", "vx")] for p in batch.column("at")[i].as_py()]).T if role == 2 else _picture(batch, "luma", i)
                held[frame][1][role].append(value)
        yield from told(float("inf"))

    by_ahead = [*by, "ahead"]
    return rows.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in shape)).dropDuplicates([*by_ahead, "y", "x", "within"])


def _by(keys):
    return Window.partitionBy(*keys, "camera", "frame")


def pair_report(matches: DataFrame, *keys: str, scale: Scale = Scale()) -> DataFrame:
    """(keys, a, b, movers, found_<percent of the radius>..., shape_failures, static_dy, static_dx, residual, along, across, offset_before,
    offset_now, offset_after): shares found within each radius, the median offset of the matches (0 below `fewest`), medians
    of what is left of it, in pixels, and of that in frames along and across the motion, and by frames ahead."""
    by = [*keys, "a", "b"]
    whole = (F.col("within") == 1.0) & (F.col("correlation") >= scale.shaped) & (F.col("kept") >= scale.kept)
    now = F.col("ahead") == 0
    matched = matches.where(whole & now)
    enough = F.count(F.lit(1)) >= scale.fewest
    static = matched.groupBy(*by).agg(F.when(enough, F.median("dy")).otherwise(0.0).alias("static_dy"), F.when(enough, F.median("dx")).otherwise(0.0).alias("static_dx"))
    left = matches.where(whole).join(F.broadcast(static), by).withColumns({"ry": F.col("dy") - F.col("static_dy"), "rx": F.col("dx") - F.col("static_dx")})  # a row a pair
    speed = F.hypot("vy", "vx")
    along, across = (F.col("ry") * F.col("vy") + F.col("rx") * F.col("vx")) / speed**2, (F.col("rx") * F.col("vy") - F.col("ry") * F.col("vx")) / speed**2
    at = lambda k, c: F.median(F.when(F.col("ahead") == k, c))
    far = F.hypot("ry", "rx")
    rest = left.groupBy(*by).agg(
        at(0, far).alias("residual"), at(0, along).alias("along"), at(0, across).alias("across"),
        at(-1, far).alias("offset_before"), at(0, far).alias("offset_now"), at(1, far).alias("offset_after"))
    found = [F.avg(F.when(now & (F.col("within") == r), (F.col("kept") >= scale.kept).cast("double"))).alias(f"found_{round(100 * r)}") for r in (*scale.curve, 1.0)]
    counts = matches.groupBy(*by).agg(
        F.count_if(now & (F.col("within") == 1.0)).alias("movers"), *found, F.count_if(now & (F.col("within") == 1.0) & (F.col("correlation") < scale.shaped)).alias("shape_failures"))
    return counts.join(static, by, "left").fillna(0.0, ["static_dy", "static_dx"]).join(rest, by, "left")
