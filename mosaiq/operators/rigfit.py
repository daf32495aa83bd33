"""Finding how a view was turned: a sweep over field of view, yaw, elevation and roll, scored against a finished panorama.

`fitted` searches tile by tile, each where its row lies: the best places of the first sweep start the finer ones, and only
what was found leaves the task. `scored` deals one sweep of a tile out over tasks in parts, and only scores are shuffled.
Nothing of either passes through the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import prod

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_PLACES = 1 << 18
#: A correlation that is 1 but for rounding.
PERFECT = 1 - 1e-12
TURN = ("fov", "yaw", "elevation", "roll")


@dataclass(frozen=True)
class Sweep:
    """Values of each parameter, in degrees, added to those that a row has already."""

    fov: tuple[float, ...] = (0.0,)
    yaw: tuple[float, ...] = (0.0,)
    elevation: tuple[float, ...] = (0.0,)
    roll: tuple[float, ...] = (0.0,)

    @classmethod
    def around(cls, step: float, count: int = 2) -> Sweep:
        """All four in steps about what was found."""
        return cls(*[tuple(step * i for i in range(-count, count + 1))] * 4)

    @property
    def candidates(self) -> int:
        return prod(len(getattr(self, name)) for name in TURN)


def _tilted(fov: np.ndarray, elevation: np.ndarray, roll: np.ndarray, tile: int, height: int) -> tuple[np.ndarray, np.ndarray]:
    """Longitude before the yaw and the panorama's row of each of a tile's pixels, a row a candidate, for views turned by roll
    about their axis, then up; angles are columns of radians."""
    plane = (np.arange(tile) + 0.5) / tile * 2 - 1
    aside, up = np.tan(fov / 2) * np.tile(plane, tile), np.tan(fov / 2) * -np.repeat(plane, tile)
    aside, up = aside * np.cos(roll) - up * np.sin(roll), aside * np.sin(roll) + up * np.cos(roll)
    ahead, up = np.cos(elevation) - up * np.sin(elevation), np.sin(elevation) + up * np.cos(elevation)
    latitude = np.arctan2(up, np.hypot(ahead, aside))
    return np.arctan2(aside, ahead), np.clip(np.floor((0.5 - latitude / np.pi) * height), 0, height - 1).astype(int)


def _column(longitude: np.ndarray, width: int) -> np.ndarray:
    return np.floor((longitude / (2 * np.pi) + 0.5) % 1.0 * width).astype(int) % width


def _shown(turns: np.ndarray, tile: int, width: int, height: int) -> np.ndarray:
    """The panorama's pixel that each of a tile's pixels shows, a row a candidate, for views turned by roll about their axis,
    then up, then by yaw."""
    fov, yaw, elevation, roll = np.radians(turns.T[..., None])
    longitude, row = _tilted(fov, elevation, roll, tile, height)
    return row * width + _column(longitude + yaw, width)


def _correlation(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Correlation of a with each row of b where both are numbers; 0 where either has no spread."""
    known = np.isfinite(a) & np.isfinite(b)
    if known.all():
        a, b = a[0] - a[0].mean(), b - b.mean(1, keepdims=True)
        spread = np.sqrt((a * a).sum() * np.einsum("ij,ij->i", b, b))
        return np.where(spread > 1e-9, np.einsum("ij,j->i", b, a) / np.where(spread > 1e-9, spread, 1.0), 0.0)
    n = np.maximum(known.sum(1, keepdims=True), 1)
    centred = lambda v: np.where(known, v - np.where(known, v, 0.0).sum(1, keepdims=True) / n, 0.0)
    a, b = centred(np.broadcast_to(a, b.shape)), centred(b)
    spread = np.sqrt((a * a).sum(1) * (b * b).sum(1))
    return np.where(spread > 1e-9, (a * b).sum(1) / np.where(spread > 1e-9, spread, 1.0), 0.0)


def scored(tiles: DataFrame, key: str, sweep: Sweep, tile: int, width: int, height: int, *, parts: int = 4) -> DataFrame:
    """(key, candidate, its four parameters, score): the correlation of the tile with what the panorama shows there; without
    spread on either side 0. tiles: (key, fov, yaw, elevation, roll, pixels, panorama), one row a key; a null array scores 0,
    null pixels are left out, a field of view outside (0, 180) ends the query. A tile's sweep is dealt out in so many parts,
    each with a copy of its panorama; a task holds `MOST_PLACES` pixels of candidates at a time."""
    values = [getattr(sweep, name) for name in TURN]
    share, block = -(-sweep.candidates // parts), max(1, MOST_PLACES // (tile * tile))
    names = [key, "candidate", *TURN, "score"]

    def run(frames):
        for frame in frames:
            for k, part, *turn, pixels, panorama in frame.itertuples(index=False):
                a = np.full(tile * tile, np.nan) if pixels is None else np.asarray(pixels, float)
                sphere = np.full(width * height, np.nan) if panorama is None else np.asarray(panorama, float)
                for first in range(part * share, min((part + 1) * share, sweep.candidates), block):
                    numbers = np.arange(first, min(first + block, (part + 1) * share, sweep.candidates))
                    places = np.unravel_index(numbers, [len(v) for v in values])
                    turns = np.stack([np.asarray(v, float)[i] + base for v, i, base in zip(values, places, turn)], axis=1)
                    _check(turns[:, 0])
                    scores = _correlation(a[None], sphere[_shown(turns, tile, width, height)])
                    yield pd.DataFrame(dict(zip(names, [[k] * len(numbers), numbers, *turns.T, scores])))

    # few bytes and much work: as many tasks as the session has, which a joining of small partitions would undo
    tasks = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = tiles.withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartition(tasks, key, "_p")
    shape = T.StructType([tiles.schema[key], T.StructField("candidate", T.LongType()), *[T.StructField(n, T.DoubleType()) for n in names[2:]]])
    return dealt.select(key, "_p", *TURN, "pixels", "panorama").mapInPandas(run, shape)


def _check(fov: np.ndarray) -> None:
    if not ((fov > 0) & (fov < 180)).all():
        raise ValueError(f"a field of view of {fov.min()} to {fov.max()} degrees")


def _swept(a: np.ndarray, sphere: np.ndarray, sweep: Sweep, base: np.ndarray, tile: int, width: int, height: int) -> np.ndarray:
    """Scores of all candidates about base, in their order, a field of view at a time; those after a perfect one stay -inf.
    The yaw turns all longitudes alike, so it is added to those of the other three."""
    fovs, yaws, elevations, rolls = (np.asarray(getattr(sweep, name), float) + b for name, b in zip(TURN, base))
    _check(fovs)
    out = np.full((len(fovs), len(yaws), len(elevations) * len(rolls)), -np.inf)
    elevation, roll = (np.radians(x).reshape(-1, 1) for x in np.meshgrid(elevations, rolls, indexing="ij"))
    many = max(1, MOST_PLACES // (tile * tile))
    share = max(1, many // elevation.size)
    for i, fov in enumerate(np.radians(fovs)):
        for part in (slice(at, at + many) for at in range(0, elevation.size, many)):
            longitude, row = _tilted(fov, elevation[part], roll[part], tile, height)
            for j in range(0, len(yaws), share):
                turned = np.radians(yaws[j : j + share])[:, None, None] + longitude
                shown = sphere[row * width + _column(turned, width)]
                out[i, j : j + share, part] = _correlation(a[None], shown.reshape(-1, tile * tile)).reshape(turned.shape[:2])
        if out[i].max() >= PERFECT:
            break
    return out.ravel()


def _turn(sweep: Sweep, number: int, base: np.ndarray) -> np.ndarray:
    values = [getattr(sweep, name) for name in TURN]
    return base + np.array([v[i] for v, i in zip(values, np.unravel_index(number, [len(v) for v in values]))], float)


def found(a: np.ndarray, sphere: np.ndarray, sweeps: list[Sweep], tile: int, width: int, height: int, starts: int) -> tuple[np.ndarray, float]:
    """The turn of greatest score and that score. The first sweep's candidates are starts, best first; from each the finer
    sweeps go on from their own best, and the finest is repeated for as long as it betters the score. The search ends after so
    many starts, or at a correlation of 1, which none can better. Of equal scores the first wins."""
    first = _swept(a, sphere, sweeps[0], np.zeros(4), tile, width, height)
    best, most, ended = None, -np.inf, set()
    for number in np.argsort(-first, kind="stable")[:starts]:
        turn, score = _turn(sweeps[0], number, np.zeros(4)), first[number]
        for sweep in sweeps[1:]:
            if score >= PERFECT:
                break
            scores = _swept(a, sphere, sweep, turn, tile, width, height)
            turn, score = _turn(sweep, scores.argmax(), turn), scores.max()
        while len(sweeps) > 1 and score < PERFECT and tuple(turn) not in ended:
            ended.add(tuple(turn))
            scores = _swept(a, sphere, sweeps[-1], turn, tile, width, height)
            if not scores.max() > score:
                break
            turn, score = _turn(sweeps[-1], scores.argmax(), turn), scores.max()
        if score > most:
            best, most = turn, score
        if most >= PERFECT or not np.ptp(first):  # without any spread all starts are alike
            break
    return best, float(most)


def fitted(tiles: DataFrame, key: str, sweeps: list[Sweep], tile: int, width: int, height: int, *, starts: int = 64) -> DataFrame:
    """(key, fov, yaw, elevation, roll, score): what `found` finds, for each tile in the task that holds its row, so that no
    panorama is shuffled. tiles: (key, pixels, panorama), one row a key; nulls as in `scored`."""
    names = [key, *TURN, "score"]

    def run(frames):
        for frame in frames:
            rows = []
            for k, pixels, panorama in frame.itertuples(index=False):
                a = np.full(tile * tile, np.nan) if pixels is None else np.asarray(pixels, float)
                sphere = np.full(width * height, np.nan) if panorama is None else np.asarray(panorama, float)
                turn, score = found(a, sphere, sweeps, tile, width, height, starts)
                rows.append((k, *turn, score))
            yield pd.DataFrame(rows, columns=names)

    shape = T.StructType([tiles.schema[key], *[T.StructField(n, T.DoubleType()) for n in names[1:]]])
    return tiles.select(key, "pixels", "panorama").mapInPandas(run, shape)


def scan(tiles: DataFrame, keys: list[str], key: str, sweep: Sweep, tile: int, width: int, height: int) -> DataFrame:
    """Mean score of each candidate over the tiles of a rig that share keys, for what all its views have in common."""
    scores = scored(tiles.drop(*keys), key, sweep, tile, width, height)
    return scores.join(tiles.select(key, *keys), key).groupBy(*keys, "candidate", *TURN).agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("views"))
