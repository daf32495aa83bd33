"""Frames as Spark tables: a source of EXR and PNG tiles, and a sink of masters.

`register(spark)` names both. Reading, `spark.read.format("tiles").option("path", folder)`:

* `only` = `headers`: a row a file (path, format, width, height, channels, packing, problem), from its first bytes.
* else a row an image row (path, y, width, codes: RGB triples in 16 bits, problem): half codes of EXR, levels of PNG. An
  EXR file is dealt to as many tasks as its bytes need (`task_bytes`), each with a range of its chunks; small files share a
  task, a file counting as `FILE_BYTES` more than it holds. The plan comes from the listing alone, so the driver opens no file.

Writing rows (name, width, height, levels) with `.format("masters").option("path", folder)`: `kind` is png8, png16 or exr (the
half codes of the linear values of 16-bit levels). A task writes into its own staging folder, with a list of the names;
files get them when all tasks have ended, a task's list at a time, and go if the job fails, so no half-written file ever
carries a frame's name.

Defined results: a file that cannot be read is a row with its `problem` and null fields, the rows before the damage stay;
an empty folder gives no rows; a frame of the wrong number of levels, or of a level outside its kind, ends the job; rows of
equal name: the last to be written wins, as with files. A null name or null levels ends the job.
"""

from __future__ import annotations

import json
import posixpath
import struct
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from mosaiq.sources import codecs

HEADERS = "path string, format string, width int, height int, channels array<string>, packing string, problem string"
PIXELS = "path string, y int, width int, codes array<int>, problem string"
#: Bytes that a header is looked for in at first, and of a file that a task reads by default.
PROBE, TASK_BYTES = 8192, 64 << 20
#: What opening a file counts as; tasks that small files are dealt to at least; renames at a time.
FILE_BYTES, TASKS, MOVES = 64 << 10, 32, 16
KINDS = {"png8": np.uint8, "png16": np.uint16, "exr": np.uint16}


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + posixpath.abspath(path))


@dataclass
class Share(InputPartition):
    """Part `part` of `parts` of a file."""

    path: str
    part: int
    parts: int


@dataclass
class Shares(InputPartition):
    """What one task reads."""

    held: list[Share]


class TileReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.headers = options["path"], options.get("only") == "headers"
        self.task_bytes = int(options.get("task_bytes", TASK_BYTES))

    def partitions(self) -> list[Shares]:
        store, folder = _place(self.folder)
        shares: list[tuple[int, Share]] = []
        for f in sorted(store.get_file_info(fs.FileSelector(folder, recursive=True)), key=lambda f: f.path):
            kind = f.path.rpartition(".")[2].lower()
            if f.type == fs.FileType.File and kind in ("png", "exr"):
                parts = 1 if self.headers or kind == "png" else max(1, -(-f.size // self.task_bytes))
                held = min(f.size, PROBE) if self.headers else f.size // parts
                shares += [(held + FILE_BYTES, Share(f.path, i, parts)) for i in range(parts)]
        most = min(self.task_bytes + FILE_BYTES, -(-sum(size for size, _ in shares) // TASKS))
        tasks, room = [Shares([])], most
        for size, share in shares:
            if tasks[-1].held and size > room:
                tasks.append(Shares([]))
                room = most
            tasks[-1].held.append(share)
            room -= size
        return tasks

    def read(self, shares: Shares):
        store, _ = _place(self.folder)
        for share in shares.held:
            with store.open_input_file(share.path) as file:
                try:
                    yield from (self._header if self.headers else self._rows)(share, file)
                except codecs.Refused as bad:
                    yield (share.path, None, None, None, None, None, str(bad)) if self.headers else (share.path, None, None, None, str(bad))

    def _head(self, file) -> dict:
        try:
            return codecs.exr_header(file.read_at(min(PROBE, file.size()), 0))
        except codecs.Short:
            return codecs.exr_header(file.read_at(file.size(), 0))

    def _header(self, share: Share, file):
        first = file.read_at(min(26, file.size()), 0)
        if first[:8] == codecs.PNG_MARK and len(first) == 26:
            width, height, depth, colour = struct.unpack_from(">IIBB", first, 16)
            names = {0: "Y", 2: "RGB", 3: "P", 4: "YA", 6: "RGBA"}.get(colour, "")
            yield share.path, "png", width, height, list(names), f"{depth} bits", None
        else:
            head = self._head(file)
            yield share.path, "exr", head["width"], head["height"], head["channels"], head["packing"], None

    def _rows(self, share: Share, file):
        if share.path.lower().endswith("png"):
            levels = codecs.decode_png(file.read())
            yield from ((share.path, y, levels.shape[1], row.ravel().tolist(), None) for y, row in enumerate(levels))
            return
        head, size = self._head(file), file.size()
        n, end = head["chunks"], head["offsets"] + 8 * head["chunks"]
        if end > size:
            raise codecs.Refused("EXR file is truncated")
        low, high = n * share.part // share.parts, n * (share.part + 1) // share.parts
        for at in np.frombuffer(file.read_at(8 * (high - low), head["offsets"] + 8 * low), "<u8").tolist():
            if not end <= at <= size - 8:
                raise codecs.Refused(f"EXR chunk offset {at} is outside the file")
            y, length = struct.unpack("<ii", file.read_at(8, at))
            if length < 0 or at + 8 + length > size:
                raise codecs.Refused("EXR file is truncated")
            for i, row in enumerate(codecs.exr_rows(head, file.read_at(length, at + 8), y)):
                yield share.path, y - head["top"] + i, head["width"], row.ravel().tolist(), None


class TileSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tiles"

    def schema(self) -> str:
        return HEADERS if self.options.get("only") == "headers" else PIXELS

    def reader(self, schema) -> TileReader:
        return TileReader(dict(self.options))


@dataclass
class Written(WriterCommitMessage):
    """A task's staging folder, which holds its frames by number and the list of their names."""

    folder: str


class MasterWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.folder, self.kind = options["path"], options.get("kind", "png8")
        if self.kind not in KINDS:
            raise ValueError(f"masters are one of {', '.join(KINDS)}, not {self.kind}")
        self.effort = int(options.get("effort", 1 if self.kind == "exr" else 6))
        self.staging = f".staging-{uuid.uuid4().hex}"

    def write(self, rows) -> Written:
        store, folder = _place(self.folder)
        own = f"{folder}/{self.staging}/{uuid.uuid4().hex}"
        store.create_dir(own, recursive=True)
        most, suffix = np.iinfo(KINDS[self.kind]).max, "exr" if self.kind == "exr" else "png"
        halves = codecs.level_halves() if self.kind == "exr" else None
        names = []
        for row in rows:
            levels = np.array(row["levels"], np.int64)
            if row["name"] is None or levels.size != 3 * row["width"] * row["height"] or levels.min(initial=0) < 0 or levels.max(initial=0) > most:
                raise ValueError(f"frame {row['name']} is not {row['width']} x {row['height']} levels of {self.kind}")
            image = levels.astype(KINDS[self.kind]).reshape(row["height"], row["width"], 3)
            data = codecs.encode_png(image, self.effort) if halves is None else codecs.encode_exr(halves[image], self.effort)
            with store.open_output_stream(f"{own}/{len(names)}.part") as out:
                out.write(data)
            names.append(f"{row['name']}.{suffix}")
        with store.open_output_stream(f"{own}/names.json") as out:
            out.write(json.dumps(names).encode())
        return Written(own)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = _place(self.folder)
        with ThreadPoolExecutor(MOVES) as pool:
            for message in filter(None, messages):
                with store.open_input_stream(f"{message.folder}/names.json") as file:
                    last = {name: i for i, name in enumerate(json.loads(file.read()))}
                for _ in pool.map(lambda moved: store.move(f"{message.folder}/{moved[1]}.part", f"{folder}/{moved[0]}"), last.items()):
                    pass
        self._clear(store, folder)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_place(self.folder))

    def _clear(self, store: fs.FileSystem, folder: str) -> None:
        if store.get_file_info(f"{folder}/{self.staging}").type == fs.FileType.Directory:
            store.delete_dir(f"{folder}/{self.staging}")


class MasterSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "masters"

    def writer(self, schema, overwrite: bool) -> MasterWriter:
        return MasterWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TileSource)
    spark.dataSource.register(MasterSink)


def missing_rows(pixels: DataFrame, headers: DataFrame) -> DataFrame:
    """(path, missing): files of which some rows were not read, by damage or because a chunk is not there."""
    read = pixels.where("y is not null").groupBy("path").agg(F.count_distinct("y").alias("rows"))
    gone = F.col("height") - F.coalesce("rows", F.lit(0))
    return headers.where("problem is null").join(read, "path", "left").select("path", gone.alias("missing")).where("missing > 0")


def levels_of_halves(pixels: DataFrame, spark: SparkSession) -> DataFrame:
    """The rows of EXR files as display levels: the codes' table is made once a task and looked up whole batches at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = codecs.half_levels()
        for batch in batches:
            codes = batch.column("codes")
            levels = pa.array(table[codes.flatten().to_numpy(zero_copy_only=False)])
            ends = np.append(0, np.cumsum(pc.list_value_length(codes).fill_null(0).to_numpy(zero_copy_only=False))).astype(np.int32)
            held = pa.ListArray.from_arrays(pa.array(ends), levels, mask=codes.is_null())
            yield pa.record_batch([batch.column("path"), batch.column("y"), batch.column("width"), held, batch.column("problem")], ["path", "y", "width", "levels", "problem"])

    return pixels.select("path", "y", "width", "codes", "problem").mapInArrow(run, "path string, y int, width int, levels array<float>, problem string")
