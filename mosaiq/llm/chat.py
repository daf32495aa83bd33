"""Chat formatting by token-level assembly.

A turn's text and its role are encoded apart from the template, whose marks are reserved ids beyond the vocabulary, so no
text can form one. Control strings in a text get a backslash before them (one more than they have), which reading takes
off again. A turn's loss mask is kept as the prefix sums of its segments' lengths. Turns are encoded where they
are read; only ids travel to the conversations, which are read back as a sorted stream, never held whole.

Defined results: null text or role is empty; a null conv_id is one conversation; turns with equal numbers follow each
other by role and a hash of the text, a null turn comes first; repeated rows are repeated turns; an empty table gives an empty result;
other columns are dropped.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.llm import common, tokens

VOCABULARY = "byte_bpe_50k.json"
# Reserved ids and how the marks are written as text.
START, BODY, END = 50257, 50258, 50259
MARKS = {START: "### ", BODY: ": ", END: "\n</turn>\n"}
_CONTROL = re.compile(r"(\\*)(### \w+:|</turn>)")
_ESCAPED = re.compile(r"\\(\\*)(### \w+:|</turn>)")


def escape(text: str) -> str:
    return _CONTROL.sub(r"\\\1\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def assemble(role: np.ndarray, body: np.ndarray, scored: bool) -> tuple[np.ndarray, list[int]]:
    """Ids of a turn and the prefix sums of its five segments; the fourth is under the loss mask where scored."""
    ids = np.concatenate([[START], role, [BODY], body, [END]]).astype("<u2")
    sums = np.cumsum([1, len(role), 1, len(body), 1]).tolist()
    return ids, [sums[2], sums[3]] if scored else [sums[2], sums[2]]


class Reader:
    """Turns ids back into text."""

    def __init__(self, path: str):
        tokenizer = tokens.encoder(path, plain=True).tokenizer
        own = {c: b for b, c in _byte_letters().items()}
        size = tokenizer.get_vocab_size()
        self.bytes = [bytes(own.get(c, 0) for c in tokenizer.id_to_token(i)) if i != 50256 else b"" for i in range(size)]

    def text(self, ids: np.ndarray) -> str:
        table = self.bytes
        return b"".join([table[i] for i in ids.tolist()]).decode("utf-8")


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write bytes with: printable ones stand for themselves, others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def formatted_turns(turns: DataFrame, *, vocabulary: str = VOCABULARY) -> DataFrame:
    """conv_id, turn, role, key (of the text), ids (uint16), loss_from, loss_to: a row per turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(tokens.vocabulary(vocabulary), plain=True).encode
        for batch in common.by_bytes(batches, 3, 2 << 20):
            roles = batch.column(2).to_pylist()
            role_ids = encode(pa.array(roles, pa.string()))
            bodies = encode(pa.array([escape(t) for t in batch.column(3).to_pylist()], pa.string()))
            made = [assemble(r, b, name == "assistant") for r, b, name in zip(role_ids, bodies, roles)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], batch.column(4), pa.array([m[0].tobytes() for m in made], pa.binary()), pa.array([m[1][0] for m in made], pa.int32()), pa.array([m[1][1] for m in made], pa.int32())],
                names=["conv_id", "turn", "role", "key", "ids", "loss_from", "loss_to"],
            )

    common.text_batches(turns.sparkSession)
    text = common.text_column()
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), common.text_column("role").alias("role"), text.alias("text"), F.xxhash64(text).alias("key"))
    return rows.mapInArrow(run, "conv_id long, turn long, role string, key long, ids binary, loss_from int, loss_to int")


COLUMNS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame, *, vocabulary: str = VOCABULARY) -> DataFrame:
    """Digests of every conversation, from the formatted ids and masks alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(tokens.vocabulary(vocabulary))
        now, out = None, []

        def closed():
            return (now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5])

        def table(rows: list) -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = [c.split()[0] for c in COLUMNS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            for conv, raw, a, b in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                if now is None or conv != now[0]:
                    if now is not None:
                        out.append(closed())
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                ids = np.frombuffer(raw, "<u2")
                body = int(np.flatnonzero(ids == BODY)[0])
                role, written = reader.text(ids[1:body]), reader.text(ids[body + 1 : -1])
                text = unescape(written)
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode())
                scored = unescape(reader.text(ids[a:b]))
                now[3] += len(scored)
                now[4].update(scored.encode())
                now[5] += len(role) + len(written) + sum(len(m) for m in MARKS.values())
            if len(out) > 1000:
                yield table(out)
                out = []
        if now is not None:
            out.append(closed())
        if out:
            yield table(out)

    parts = common.shuffle_partitions(formatted.sparkSession)
    rows = formatted.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "key")
    return rows.select("conv_id", "ids", "loss_from", "loss_to").mapInArrow(run, COLUMNS)


def op6_token_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return read_back(formatted_turns(turns.unionByName(extra)))
