"""Reading tiles and panoramas between pixels, as column arithmetic on arrays in row-major order; nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rec. 709 luma, limited-range YCbCr, and the factor between 8 and 16 bits.
LUMA = (0.2126, 0.7152, 0.0722)
SIXTEEN = 257.0


def _clip(x: Column, low, high) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def pixel_position(u: Column, size: int) -> Column:
    """Place on a tile's axis of an image-plane coordinate from -1 to 1; integers are pixel centres."""
    return (u + 1) * 0.5 * size - 0.5


def tap(place: Column, size: int, *, cubic: bool = False) -> tuple[Column, Column]:
    """First of the two (cubic: four) pixels that a place is read from, kept inside the tile, and the fraction beyond it."""
    back, last = (1, max(size - 4, 0)) if cubic else (0, max(size - 2, 0))
    first = _clip(F.floor(place) - back, 0, last)
    return first.cast("int"), _clip(place - (first + back), 0.0, 1.0)


def catmull_rom(f: Column) -> list[Column]:
    """Weights of the four pixels around a fraction."""
    two, three = f * f, f * f * f
    return [-0.5 * three + two - 0.5 * f, 1.5 * three - 2.5 * two + 1, -1.5 * three + 2 * two + 0.5 * f, 0.5 * three - 0.5 * two]


def _read(values: Column, at: Column) -> Column:
    return F.get(values, at.cast("int")).cast("double")


def bilinear(values: Column, side: int, x: Column, y: Column) -> Column:
    """Level between four pixels of a square tile."""
    (left, fx), (top, fy) = tap(x, side), tap(y, side)
    row = lambda dy: _read(values, (top + dy) * side + left) * (1 - fx) + _read(values, (top + dy) * side + left + 1) * fx
    return row(0) * (1 - fy) + row(1) * fy


def bicubic(values: Column, side: int, x: Column, y: Column) -> Column:
    """Catmull-Rom level among sixteen pixels of a square tile."""
    (left, fx), (top, fy) = tap(x, side, cubic=True), tap(y, side, cubic=True)
    wx, wy = catmull_rom(fx), catmull_rom(fy)
    row = lambda dy: sum((_read(values, (top + dy) * side + left + dx) * wx[dx] for dx in range(1, 4)), _read(values, (top + dy) * side + left) * wx[0])
    return sum((row(dy) * wy[dy] for dy in range(1, 4)), row(0) * wy[0])


def equirect(values: Column, width: int, height: int, lon: Column, lat: Column) -> Column:
    """Bilinear level of a panorama at a direction; longitude wraps, latitude stops at the poles."""
    u, v = (lon / (2 * F.pi()) + 0.5) * width - 0.5, (0.5 - lat / F.pi()) * height - 0.5
    x, y = F.floor(u), _clip(F.floor(v), 0, height - 2)
    at = lambda dy, dx: _read(values, (y + dy) * width + F.pmod(x + dx, F.lit(width)))
    fx, fy = u - x, v - y
    return (at(0, 0) * (1 - fx) + at(0, 1) * fx) * (1 - fy) + (at(1, 0) * (1 - fx) + at(1, 1) * fx) * fy


def upsample(grid: Column, columns: int, rows: int, index: Column, width: int, height: int) -> Column:
    """A coarse grid's bilinear value at an output pixel; edges are held."""
    place = lambda i, n, size: (i + 0.5) * (n / size) - 0.5
    fx, fy = place(index % width, columns, width), place(F.floor(index / width), rows, height)
    x, y = _clip(F.floor(fx), 0, columns - 2), _clip(F.floor(fy), 0, rows - 2)
    tx, ty = _clip(fx - x, 0.0, 1.0), _clip(fy - y, 0.0, 1.0)
    at = lambda dy, dx: _read(grid, (y + dy) * columns + x + dx)
    return (at(0, 0) * (1 - tx) + at(0, 1) * tx) * (1 - ty) + (at(1, 0) * (1 - tx) + at(1, 1) * tx) * ty


def padding(width: Column) -> tuple[Column, Column]:
    """Columns and rows by which a panorama is continued: twelve and six degrees, in steps of eight."""
    wrap = F.greatest(F.lit(8), F.rint(width / 240.0).cast("int") * 8)
    return wrap, F.floor(wrap / 2).cast("int")


def pad_sphere(values: Column, width: int, height: int, wrap: int, pole: int) -> Column:
    """A panorama continued past its edges: columns wrap, and rows past a pole come back half a turn away."""
    wide = width + 2 * wrap
    def at(i: Column) -> Column:
        row, column = F.floor(i / wide) - pole, i % wide - wrap
        beyond = (row < 0) | (row >= height)
        inside = F.when(row < 0, -1 - row).when(row >= height, 2 * height - 1 - row).otherwise(row)
        return F.get(values, (inside * width + F.pmod(column + F.when(beyond, width // 2).otherwise(0), F.lit(width))).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(wide * (height + 2 * pole) - 1)), at)


def crop(values: Column, width: int, height: int, wrap: int, pole: int) -> Column:
    """The panorama of that size out of its padded form."""
    at = lambda i: F.get(values, ((F.floor(i / width) + pole) * (width + 2 * wrap) + i % width + wrap).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), at)


def luma(r: Column, g: Column, b: Column) -> Column:
    return r * LUMA[0] + g * LUMA[1] + b * LUMA[2]


def quantise(level: Column, bits: int) -> Column:
    """Level from 0 to 255 in 8 or 16 bits, rounded half to even."""
    scale, top = (1.0, 255.0) if bits == 8 else (SIXTEEN, 65535.0)
    return F.rint(_clip(level * scale, 0.0, top)).cast("int")


def srgb_decode(level: Column) -> Column:
    """Display linear value of a level from 0 to 255, mirrored below zero."""
    a = F.abs(level / 255.0)
    return F.signum(level) * F.when(a <= 0.04045, a / 12.92).otherwise(F.pow((a + 0.055) / 1.055, F.lit(2.4)))


def srgb_encode_odd(linear: Column) -> Column:
    """Level of a display linear value, mirrored below zero and not cut above one."""
    a = F.abs(linear)
    return F.signum(linear) * F.when(a <= 0.0031308, a * 12.92).otherwise(1.055 * F.pow(a, F.lit(1 / 2.4)) - 0.055) * 255.0


def dithered(level: Column, noise: Column) -> Column:
    """Floor after noise from 0 to 1, in eight bits; without bias."""
    return _clip(F.floor(level + noise), 0, 255).cast("int")


def rgb_of_ycbcr(y: Column, u: Column, v: Column) -> tuple[Column, Column, Column]:
    """Levels of limited-range BT.709 codes."""
    light, pb, pr = (y - 16) / 219.0, (u - 128) / 224.0, (v - 128) / 224.0
    red, blue = (light + 2 * (1 - LUMA[0]) * pr) * 255.0, (light + 2 * (1 - LUMA[2]) * pb) * 255.0
    return red, (light * 255.0 - LUMA[0] * red - LUMA[2] * blue) / LUMA[1], blue


def halve_chroma(values: Column, width: int, height: int, *, sited: bool = True) -> Column:
    """A chroma plane at half size: co-sited ([1 2 1] / 4 across, wrapping, two rows) or boxes of four."""
    at = lambda r, c: _read(values, r * width + F.pmod(c, F.lit(width)))
    def one(i: Column) -> Column:
        r, c = F.floor(i / (width // 2)) * 2, i % (width // 2) * 2
        if not sited:
            return (at(r, c) + at(r, c + 1) + at(r + 1, c) + at(r + 1, c + 1)) / 4
        line = lambda y: (at(y, c - 1) + 2 * at(y, c) + at(y, c + 1)) * 0.25
        return (line(r) + line(r + 1)) / 2
    return F.transform(F.sequence(F.lit(0), F.lit(width * height // 4 - 1)), one)
