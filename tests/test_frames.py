"""Tiles and masters: round trips, every PNG filter, damaged and refused files, and what a failed job leaves."""

import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from mosaiq.sources import codecs, frames


def filtered_png(image, kinds, colour=2, depth=8):
    """A PNG made byte by byte from the format's definition of its row filters."""
    height, width, channels = image.shape
    step = channels * depth // 8
    lines = image.astype(">u2" if depth == 16 else np.uint8).tobytes()
    size = width * step
    rows, out = [lines[y * size : (y + 1) * size] for y in range(height)], b""
    for y, row in enumerate(rows):
        kind, up = kinds[y % len(kinds)], rows[y - 1] if y else bytes(size)
        line = bytearray()
        for i, v in enumerate(row):
            a, b, c = row[i - step] if i >= step else 0, up[i], up[i - step] if i >= step else 0
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line.append((v - (0, a, b, (a + b) // 2, near)[kind]) % 256)
        out += bytes([kind]) + line
    part = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return codecs.PNG_MARK + part(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, 0)) + part(b"IDAT", zlib.compress(out)) + part(b"IEND", b"")


@pytest.mark.parametrize("depth", [8, 16])
@pytest.mark.parametrize("colour,channels", [(0, 1), (2, 3), (4, 2), (6, 4)])
def test_every_png_filter(depth, colour, channels):
    image = np.random.default_rng(colour).integers(0, 1 << depth, (11, 7, channels))
    got = codecs.decode_png(filtered_png(image, [0, 1, 2, 3, 4, 4, 3], colour, depth))
    assert (got == image[..., [0, 0, 0] if channels < 3 else [0, 1, 2]]).all() and got.dtype == (np.uint8 if depth == 8 else np.uint16)


def test_code_tables():
    levels, halves = codecs.half_levels(), codecs.level_halves()
    half = lambda x: int(np.float16(x).view(np.uint16))
    assert [levels[half(x)] for x in (0, -1, np.nan, 1, 7, np.inf, -np.inf)] == [0, 0, 0, 255, 255, 255, 0]
    assert abs(levels[half(0.5)] - (1.055 * 0.5 ** (1 / 2.4) - 0.055) * 255) < 1e-4 and abs(levels[half(0.002)] - float(np.float16(0.002)) * 12.92 * 255) < 1e-4
    assert np.abs(levels[halves] - np.arange(65536) / 257).max() < 0.1


def exr(height=40, width=6, seed=1):
    return np.random.default_rng(seed).integers(0, 3, (height, width, 3)).astype(np.uint16) * 5000


@pytest.fixture
def read(spark):
    frames.register(spark)
    return lambda folder, **options: spark.read.format("tiles").option("path", str(folder)).options(**options).load()


def test_exr_rows_by_ranges_of_chunks(read, tmp_path):
    want = {}
    for k in range(3):
        image = exr(seed=k)
        folder = tmp_path / f"Camera{k}"
        folder.mkdir()
        (folder / "S.0001.exr").write_bytes(codecs.encode_exr(image))
        want |= {(f"Camera{k}", y): image[y].ravel().tolist() for y in range(40)}
    for size in (10, 300, 1 << 20):
        rows = read(tmp_path, task_bytes=size)
        assert {(r.path.split("/")[-2], r.y): r.codes for r in rows.collect()} == want
    heads = read(tmp_path, only="headers")
    assert {(r.format, r.width, r.height, tuple(r.channels), r.packing, r.problem) for r in heads.collect()} == {("exr", 6, 40, ("B", "G", "R"), "ZIP", None)}
    assert frames.missing_rows(read(tmp_path), heads).count() == 0


def test_exr_of_other_packings_and_channels(read, tmp_path):
    """Stored rows, single deflated rows, an alpha channel between, and a window that does not begin at zero."""
    image = exr(5, 4)
    base = codecs.encode_exr(image)
    field = lambda n, k, v: f"{n}\0{k}\0".encode() + struct.pack("<i", len(v)) + v
    for packing in (0, 2):
        window = struct.pack("<4i", 10, 20, 13, 24)
        channels = b"".join(c + b"\0" + struct.pack("<iB3xii", 1, 0, 1, 1) for c in (b"A", b"B", b"G", b"R")) + b"\0"
        head = base[:8] + field("channels", "chlist", channels) + field("compression", "compression", bytes([packing])) + field("dataWindow", "box2i", window) + field("displayWindow", "box2i", window)
        head += field("note", "string", b"x" * 9000) + b"\0"  # longer than what is looked at first
        lines = [np.ascontiguousarray(np.concatenate([np.full((1, 4), 7), row.T[::-1]])).astype("<u2", order="C").view(np.uint8).reshape(-1) for row in image]
        blocks = [struct.pack("<ii", 20 + y, len(b)) + b for y, b in enumerate(codecs.exr_pack(x, 6) if packing else x.tobytes() for x in lines)]
        places = [len(head) + 8 * 5 + sum(map(len, blocks[:i])) for i in range(5)]
        (tmp_path / f"p{packing}.exr").write_bytes(head + struct.pack("<5Q", *places) + b"".join(blocks))
    got = read(tmp_path, task_bytes=9200).collect()
    assert len(got) == 10 and all(r.problem is None and r.codes == image[r.y].ravel().tolist() for r in got)
    assert {r.packing for r in read(tmp_path, only="headers").collect()} == {"NONE", "ZIPS"}


def test_damage_is_told_by_file(read, tmp_path):
    good = codecs.encode_exr(exr())
    head = codecs.exr_header(good)
    flags = lambda bits: good[:4] + struct.pack("<I", 2 | bits) + good[8:]
    cut = lambda at, new: good[:at] + new + good[at + len(new) :]
    second = struct.unpack_from("<Q", good, head["offsets"] + 8)[0]
    bad = {
        "short": (good[: len(good) - 10], "truncated"), "head": (good[:60], "header is truncated"), "none": (b"", "not an EXR"), "text": (b"hello there", "not an EXR"),
        "tiled": (flags(0x200), "tiled"), "deep": (flags(0x800), "deep"), "parts": (flags(0x1000), "multi-part"), "version": (good[:4] + struct.pack("<I", 3) + good[8:], "version 3"),
        "offset": (cut(head["offsets"] + 8, struct.pack("<Q", 1 << 40)), "outside the file"), "row": (cut(second, struct.pack("<i", 999)), "row 999"),
        "piz": (good.replace(b"compression\0\1\0\0\0\3", b"compression\0\1\0\0\0\4"), "PIZ"), "float": (good.replace(b"G\0" + struct.pack("<i", 1), b"G\0" + struct.pack("<i", 2), 1), "channel G"),
        "twice": (cut(head["offsets"] + 8, good[head["offsets"] : head["offsets"] + 8]), None),
    }
    for name, (data, _) in bad.items():
        (tmp_path / f"{name}.exr").write_bytes(data)
    (tmp_path / "bad.png").write_bytes(codecs.encode_png(np.zeros((4, 4, 3), np.uint8))[:-20])
    rows = read(tmp_path).collect()
    for name, (_, said) in bad.items():
        told = [r.problem for r in rows if r.path.endswith(f"/{name}.exr") and r.problem]
        assert (len(told) == 1 and said in told[0]) if said else not told, (name, told)
    assert any(r.path.endswith("bad.png") and "truncated" in r.problem for r in rows)
    assert sum(r.path.endswith("/row.exr") and r.y is not None for r in rows) == 16  # rows before the damage stay
    missing = {r.path.rsplit("/", 1)[1]: r.missing for r in frames.missing_rows(read(tmp_path), read(tmp_path, only="headers")).collect()}
    assert missing["twice.exr"] == 16 and missing["row.exr"] == 24 and missing["offset.exr"] == 24


@pytest.mark.parametrize("kind", ["png8", "png16", "exr"])
def test_masters_come_back(spark, read, tmp_path, kind):
    rng = np.random.default_rng(5)
    most = 256 if kind == "png8" else 65536
    images = {f"S.{i:04d}": rng.integers(0, most, (5 + i, 3, 3)) for i in range(6)}
    rows = [(name, 3, len(a), a.ravel().tolist(), "x") for name, a in images.items()]
    table = spark.createDataFrame(rows, "name string, width int, height int, levels array<int>, path string").repartition(3)
    table.write.format("masters").mode("append").option("path", str(tmp_path)).option("kind", kind).save()
    assert sorted(os.listdir(tmp_path)) == sorted(f"{n}.{'exr' if kind == 'exr' else 'png'}" for n in images)
    got = {}
    for r in read(tmp_path).collect():
        got.setdefault(r.path.rsplit("/", 1)[1].rsplit(".", 1)[0], {})[r.y] = r.codes
    for name, a in images.items():
        want = codecs.level_halves()[a] if kind == "exr" else a
        assert [got[name][y] for y in range(len(a))] == want.reshape(len(a), -1).tolist()


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    frames.register(spark)
    rows = [(f"S.{i:04d}", 1, 1, [0, 0, 300 if i == 37 else 1]) for i in range(40)]
    table = spark.createDataFrame(rows, "name string, width int, height int, levels array<int>").repartition(4)
    for kind in ("png8", "tiff"):
        with pytest.raises(PySparkException):
            table.write.format("masters").mode("append").option("path", str(tmp_path)).option("kind", kind).save()
    assert os.listdir(tmp_path) == []


def test_levels_of_rows(spark, read, tmp_path):
    image = codecs.level_halves()[np.arange(0, 65536, 257)[:255].reshape(5, 17, 3)]
    (tmp_path / "S.1.exr").write_bytes(codecs.encode_exr(image))
    got = {r.y: r.levels for r in frames.levels_of_halves(read(tmp_path), spark).collect()}
    assert np.abs(np.array([got[y] for y in range(5)]) - np.arange(255).reshape(5, 51)).max() < 0.1
    assert frames.levels_of_halves(read(tmp_path).where("y > 99"), spark).count() == 0


def test_small_files_share_tasks_and_each_keeps_its_own_damage(read, tmp_path):
    """500 files went to 500 tasks before; a file that cannot be read does not end the task that it shares."""
    image = np.arange(27).reshape(3, 3, 3).astype(np.uint8)
    for i in range(500):
        (tmp_path / f"S.{i:04d}.png").write_bytes(codecs.encode_png(image)[: 30 if i % 50 == 7 else None])
    for only in ("pixels", "headers"):
        rows = read(tmp_path, only=only)
        assert 1 < rows.rdd.getNumPartitions() < 2 * frames.TASKS
        assert {r.path.rsplit("/", 1)[1] for r in rows.collect()} == {f"S.{i:04d}.png" for i in range(500)}
    found = read(tmp_path).collect()
    assert sum(r.problem is not None for r in found) == 10 and sum(r.y is not None for r in found) == 490 * 3


def test_the_last_of_equal_names_wins(spark, read, tmp_path):
    frames.register(spark)
    rows = [(f"S.{i % 3}", 1, 1, [i, i, i]) for i in range(30)]
    table = spark.createDataFrame(rows, "name string, width int, height int, levels array<int>").coalesce(1)
    table.write.format("masters").mode("append").option("path", str(tmp_path)).save()
    assert sorted(os.listdir(tmp_path)) == ["S.0.png", "S.1.png", "S.2.png"]
    assert {r.path.rsplit("/", 1)[1][2]: r.codes[0] for r in read(tmp_path).collect()} == {"0": 27, "1": 28, "2": 29}
