"""Token-id files: each document's ids compressed apart with one shared zstandard dictionary.

Layout of a file: 8 magic bytes, the dictionary's SHA-256, one byte of id width (2 or 4), the compressed documents, the
index (doc_id, offset and number of ids per document, little-endian int64), the number of documents and the index's
offset (int64 each). A short document is read by its index entry alone. The dictionary is a file of its own, beside them,
trained on the ids of at most `SAMPLE` distinct texts of smallest hash among those of at most 2 * `SAMPLE_BYTES` / `SAMPLE` bytes; every document is encoded.

Files lie in the shared folder and hold runs of ascending doc_id, about `FILE_BYTES` each. A task writes under names no
other attempt uses and the committed manifest alone says which count, so lost or repeated tasks leave no trace in it.

Defined results: null text is empty and has the end id alone; a null doc_id comes first and is kept as the least int64;
repeated doc_ids follow each other by text hash; an empty table writes no files and gives an empty result; other columns
are dropped.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.llm import common, tokens

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
MAGIC = b"mqtok\x00\x00\x01"
SAMPLE, SAMPLE_BYTES, DICTIONARY_BYTES = 2000, 8 << 20, 64 << 10
FILE_BYTES = 32 << 20
LEVEL = 3
NULL_ID = -(1 << 63)
MANIFEST = "part int, seq int, path string, documents long, n_tokens long"


def _open(path: str):
    system, inner = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return system, inner


def _encoded(texts: pa.Array, vocabulary: str) -> list[np.ndarray]:
    end = np.array([END_ID], "<u4")
    return [np.append(ids, end) for ids in tokens.encoder(tokens.vocabulary(vocabulary)).encode(texts)]


def train_dictionary(docs: DataFrame, vocabulary: str = VOCABULARY, width: int = 2) -> bytes:
    """Dictionary of a bounded sample; empty where the sample is too small to train one."""
    import zstandard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.by_bytes(batches, 0):
            rows = [x.astype(f"<u{width}").tobytes() for x in _encoded(batch.column(0), vocabulary)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["ids"])

    short = docs.select(common.text_column().alias("text")).where(F.octet_length("text") <= SAMPLE_BYTES // SAMPLE * 2).withColumn("k", F.xxhash64("text"))
    last = short.select("k").orderBy("k").limit(SAMPLE).agg(F.max("k").alias("k")).head()["k"]  # hashes alone go to one task
    chosen = short.where(F.col("k") <= (F.lit(None).cast("long") if last is None else F.lit(last))).dropDuplicates(["k"])
    rows = chosen.select("text").mapInArrow(run, "ids binary").collect()  # at most 2 * SAMPLE_BYTES of text
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [bytes(r["ids"]) for r in rows]).as_bytes()
    except (zstandard.ZstdError, ValueError, ZeroDivisionError):
        return b""


def write(docs: DataFrame, folder: str, *, vocabulary: str = VOCABULARY) -> DataFrame:
    """Write the files and give their manifest (part, seq, path, documents, n_tokens), in order of part and seq."""
    import zstandard

    spark = docs.sparkSession
    common.text_batches(spark)
    width = 2 if tokens.encoder(tokens.vocabulary(vocabulary)).tokenizer.get_vocab_size() <= 1 << 16 else 4
    trained = train_dictionary(docs, vocabulary, width)
    digest = hashlib.sha256(trained).digest()
    system, inner = _open(folder)
    system.create_dir(inner, recursive=True)
    with system.open_output_stream(f"{inner}/dictionary") as f:
        f.write(trained)
    shared = spark.sparkContext.broadcast(trained)  # at most DICTIONARY_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(shared.value) if shared.value else None)
        system, inner = _open(folder)
        part, seq = TaskContext.get().partitionId(), 0
        held: list[bytes] = []
        index: list[tuple[int, int, int]] = []
        at = len(MAGIC) + 33

        def close() -> pa.RecordBatch:
            name = f"{inner}/{uuid.uuid4().hex}.tok"
            with system.open_output_stream(name) as f:
                f.write(MAGIC + digest + bytes([width]))
                for x in held:
                    f.write(x)
                f.write(np.array(index, "<i8").tobytes() + struct.pack("<qq", len(index), at))
            path = folder.rstrip("/") + name[len(inner) :]
            row = [part, seq, path, len(index), sum(n for _, _, n in index)]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))], names=["part", "seq", "path", "documents", "n_tokens"])

        for batch in common.by_bytes(batches):
            for doc, ids in zip(batch.column(0).to_pylist(), _encoded(batch.column(1), vocabulary)):
                raw = packer.compress(ids.astype(f"<u{width}").tobytes())
                index.append((doc, at, len(ids)))
                held.append(raw)
                at += len(raw)
                if at >= FILE_BYTES:
                    yield close()
                    held, index, seq, at = [], [], seq + 1, len(MAGIC) + 33
        if index:
            yield close()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), common.text_column().alias("text"))
    rows = rows.withColumn("_tie", F.xxhash64("text"))
    placed = rows.repartitionByRange(common.shuffle_partitions(spark), "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").select("doc_id", "text")
    return common.materialise(placed.mapInArrow(run, MANIFEST), "manifest")


class TokenFile:
    """Reads one file; the dictionary must be the one it was written with."""

    def __init__(self, path: str):
        import zstandard

        system, inner = _open(path)
        self.file = system.open_input_file(inner)
        head = self.file.read_at(len(MAGIC) + 33, 0)
        with system.open_input_stream(inner.rsplit("/", 1)[0] + "/dictionary") as f:
            trained = f.read()
        if head[: len(MAGIC)] != MAGIC or head[len(MAGIC) : -1] != hashlib.sha256(trained).digest():
            raise ValueError(f"{path}: another format or dictionary")
        self.width = head[-1]
        size = self.file.size()
        count, self.end = struct.unpack("<qq", self.file.read_at(16, size - 16))
        self.index = np.frombuffer(self.file.read_at(count * 24, self.end), "<i8").reshape(-1, 3)
        self.unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)

    def ids(self, k: int) -> np.ndarray:
        """Ids of the k-th document, reading no other."""
        at = int(self.index[k, 1])
        until = int(self.index[k + 1, 1]) if k + 1 < len(self.index) else self.end
        raw = self.unpacker.decompress(self.file.read_at(until - at, at), max_output_size=int(self.index[k, 2]) * self.width)
        return np.frombuffer(raw, f"<u{self.width}").astype("<u4")


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files; a row per file comes to the driver."""
    spark = manifest.sparkSession
    files = sorted((r["part"], r["seq"], r["path"], r["n_tokens"]) for r in manifest.select("part", "seq", "path", "n_tokens").collect())
    base, rows = 0, []
    for _, _, path, n in files:
        rows.append((path, base))
        base += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                file = TokenFile(path)
                sizes, sums = [], []
                for k in range(len(file.index)):
                    ids = file.ids(k)
                    sizes.append(len(ids))
                    sums.append(zlib.crc32(ids.tobytes()))
                docs = pa.array(file.index[:, 0].copy(), mask=file.index[:, 0] == NULL_ID)
                starts = start + np.cumsum(sizes) - np.array(sizes)
                yield pa.RecordBatch.from_arrays([docs, pa.array(starts.astype(np.int64)), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    listed = spark.createDataFrame(rows, "path string, start long").repartition(max(1, min(len(rows), common.shuffle_partitions(spark))))
    return listed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_zstd_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(write(spark.read.parquet(f"{sf_dir}/documents.parquet"), common.new_path(spark, "token-files")))
