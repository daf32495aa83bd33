"""Substring dedup by seed and extend: repeated runs of at least `window` words are removed after their first place.

Seeds are winnowed anchors: each window of `window` words names its least hashed k-gram, so equal windows name equal
anchors at equal places. An anchor occurrence is extended both ways over all windows that name it; occurrences with equal
anchor and equal extension (span) are repeats as a whole and only the first of each span stays in the comparison. Where
one anchor has several different spans (the ends of maximal repeats), the windows of those first occurrences are compared
one by one. No step forms pairs: each is a minimum of (document, place) per key, taken first inside each slice of a task,
so a passage that a third of all documents share sends one row per slice to the shuffle.

Defined results: null text has no words; documents of fewer than `window` words are kept; rows that repeat a doc_id with
equal text are judged alike (a place is never earlier than itself); a null doc_id sorts first and is never a copy of
another null id; an empty table gives an empty result. Hash keys are 128 bits wide.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mosaiq.llm import common

WINDOW = 20
GRAM = 6
_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

KEYS = "_mq_h long, _mq_g long, _mq_id long, _mq_pos long, _mq_done boolean"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every ASCII-whitespace-separated word of all texts, and the number of words of each text."""
    import xxhash

    lists = pc.ascii_split_whitespace(texts)
    n = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    d = pc.dictionary_encode(lists.flatten())
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in d.dictionary.to_pylist()], dtype=np.uint64)
    codes = d.indices.to_numpy(zero_copy_only=False)
    blank = pc.index(d.dictionary, "").as_py()
    if blank >= 0:
        real = codes != blank
        upto = np.append(0, np.cumsum(real))
        ends = np.cumsum(n)
        n = upto[ends] - upto[ends - n]
        codes = codes[real]
    return (hashes[codes] if len(hashes) else np.array([], np.uint64)), n


class Rolling:
    """Polynomial hashes of any run of words of one slice."""

    def __init__(self, codes: np.ndarray):
        if len(_powers[0]) <= len(codes):
            size = 2 * len(codes) + 2
            for i, base in enumerate((_MULTIPLIER, _INVERSE)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                _powers[i] = np.cumprod(steps)
        self.sums = np.append(np.uint64(0), np.cumsum(codes * _powers[0][: len(codes)]))

    def runs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * _powers[1][start]


def window_anchors(roll: Rolling, counts: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """For every window: its start (in the slice), its document (in the slice), its anchor's start."""
    fits = np.maximum(counts - window + 1, 0)
    heads = np.cumsum(counts) - counts
    upto = np.cumsum(fits)
    total = int(upto[-1]) if len(upto) else 0
    doc = np.repeat(np.arange(len(counts)), fits)
    start = np.arange(total) + np.repeat(heads - (upto - fits), fits)
    words = len(roll.sums) - 1
    if not total:
        return start, doc, start, np.array([], np.uint64)
    at = np.arange(words - GRAM + 1)
    grams = _mix(roll.runs(at, at + GRAM))
    views = np.lib.stride_tricks.sliding_window_view(grams, window - GRAM + 1)
    anchor = np.empty(total, np.int64)
    for a in range(0, total, 1 << 16):
        part = start[a : a + (1 << 16)]
        lo, hi = int(part[0]), int(part[-1]) + 1
        anchor[a : a + len(part)] = part + views[lo:hi].argmin(axis=1)[part - lo]
    return start, doc, anchor, grams


def _first_places(h: np.ndarray, g: np.ndarray, ids: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """True for rows later than another row of equal (h, g), by (id, pos)."""
    order = np.lexsort((pos, ids, _mix(h) ^ g))
    h, g, ids, pos = h[order], g[order], ids[order], pos[order]
    new = np.append(True, (h[1:] != h[:-1]) | (g[1:] != g[:-1]))
    lead = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    later = (ids != ids[lead]) | (pos != pos[lead])
    out = np.empty(len(h), bool)
    out[order] = later
    return out


def _key_rows(h: np.ndarray, g: np.ndarray, ids: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    """Rows for the shuffle. What is known to be a repeat inside this slice is done: its key only spreads it."""
    done = _first_places(h, g, ids, pos) if len(h) else np.array([], bool)
    h = np.where(done, _mix(h ^ pos.astype(np.uint64) ^ ids.astype(np.uint64)), h)
    return pa.RecordBatch.from_arrays(
        [pa.array(h.view(np.int64)), pa.array(g.view(np.int64)), pa.array(ids), pa.array(pos), pa.array(done)],
        names=["_mq_h", "_mq_g", "_mq_id", "_mq_pos", "_mq_done"],
    )


def _tags(texts: pa.Array) -> np.ndarray:
    """31 bits of each text's CRC, above the place in a packed position; tells apart rows that repeat an id."""
    return np.array([zlib.crc32(x) & 0x7FFFFFFF for x in texts.cast(pa.binary()).to_pylist()], dtype=np.int64) << 32


NULL_ID = -(1 << 63)


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def _spans(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.by_bytes(batches):
            codes, counts = word_codes(batch.column(1))
            roll = Rolling(codes)
            start, doc, anchor, grams = window_anchors(roll, counts, window)
            if not len(start):
                continue
            new = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])))
            n = np.diff(np.append(new, len(start)))
            first, where = start[new], doc[new]
            span = _mix(roll.runs(first, first + n + window - 1) ^ _mix(((anchor[new] - first) * 64 + n).astype(np.uint64)))
            heads = np.cumsum(counts) - counts
            pos = _tags(batch.column(1))[where] | (first - heads[where]) << 5 | n
            yield _key_rows(grams[anchor[new]], span, _ids(batch.column(0))[where], pos)

    return run


def _windows(window: int):
    """Windows of the spans listed in the third column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.by_bytes(batches):
            codes, counts = word_codes(batch.column(1))
            roll = Rolling(codes)
            heads = np.cumsum(counts) - counts
            lists = batch.column(2)
            owner = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            pos = lists.flatten().to_numpy(zero_copy_only=False)
            tags = _tags(batch.column(1))
            mine = (pos >> 32 << 32) == tags[owner]
            owner, pos = owner[mine], pos[mine]
            n = pos & 31
            first = (pos & 0xFFFFFFFF) >> 5
            place = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            owner = np.repeat(owner, n)
            start = heads[owner] + place
            if not len(start):
                continue
            # one hash for the grouping, an independently mixed one for the check
            whole = roll.runs(start, start + window)
            half = roll.runs(start, start + window // 2)
            yield _key_rows(_mix(whole), _mix(half + np.uint64(1)) ^ whole, _ids(batch.column(0))[owner], tags[owner] | place << 5 | 1)

    return run


def _later(rows: DataFrame, keep_first_of_mixed: bool) -> DataFrame:
    """Mark rows later than the first of their (h, g): one exchange by h serves both windows."""
    spark = rows.sparkSession
    rows = rows.repartition(common.shuffle_partitions(spark), "_mq_h")
    place = F.struct("_mq_id", "_mq_pos")
    both = Window.partitionBy("_mq_h", "_mq_g")
    one = Window.partitionBy("_mq_h")
    rows = rows.withColumn("_mq_repeat", F.col("_mq_done") | (place > F.min(place).over(both)))
    wanted = F.col("_mq_repeat")
    if keep_first_of_mixed:
        rows = rows.withColumn("_mq_mixed", F.min("_mq_g").over(one) != F.max("_mq_g").over(one))
        wanted = wanted | F.col("_mq_mixed")
    return rows.where(wanted).select("_mq_id", "_mq_pos", "_mq_repeat")


def repeats(docs: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """Per document with repeats: _mq_id and the packed places _mq_ranges (text tag, first window, number of windows).

    docs has _mq_id and _mq_text; its exchange by id is the one that the caller's join with this result reuses.
    """
    common.text_batches(docs.sparkSession)
    texts = docs.select("_mq_id", "_mq_text")
    spans = common.materialise(_later(texts.mapInArrow(_spans(window), KEYS), True), "spans")
    ends = spans.where("not _mq_repeat").groupBy("_mq_id").agg(F.collect_list("_mq_pos").alias("_mq_ranges"))
    windows = texts.join(ends, "_mq_id").select("_mq_id", "_mq_text", "_mq_ranges").mapInArrow(_windows(window), KEYS)
    found = spans.where("_mq_repeat").unionByName(_later(windows, False))
    return found.groupBy("_mq_id").agg(F.collect_list("_mq_pos").alias("_mq_ranges"))


def _masks(texts: pa.Array, ranges: pa.Array, window: int) -> Iterator[tuple[list[bytes], np.ndarray | None]]:
    """Words of each text and, where some go, the mask of those that stay."""
    flat = ranges.flatten().to_numpy(zero_copy_only=False)
    n = pc.list_value_length(ranges).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(n)
    tags = _tags(texts)
    for i, text in enumerate(texts.cast(pa.binary()).to_pylist()):
        words = text.split()
        pos = flat[ends[i] - n[i] : ends[i]]
        pos = pos[(pos >> 32 << 32) == tags[i]]
        if not len(pos):
            yield words, None
            continue
        first = (pos & 0xFFFFFFFF) >> 5
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, first, 1)
        np.add.at(change, np.minimum(first + (pos & 31) + window - 1, len(words)), -1)
        yield words, np.cumsum(change[:-1]) == 0


def _prepared(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"_mq_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), "_mq_text": common.text_column()})


def digests(docs: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    texts = _prepared(docs.select("doc_id", "text")).select("_mq_id", "_mq_text")
    joined = texts.join(repeats(texts, window=window), "_mq_id", "left").select("_mq_id", "_mq_text", "_mq_ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.by_bytes(batches):
            total, gone, sums = [], [], []
            for words, keep in _masks(batch.column(1), batch.column(2), window):
                kept = words if keep is None else list(compress(words, keep.tolist()))
                total.append(len(words))
                gone.append(len(words) - len(kept))
                sums.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            ids = pc.if_else(pc.equal(batch.column(0), NULL_ID), pa.scalar(None, pa.int64()), batch.column(0))
            yield pa.RecordBatch.from_arrays([ids, pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(sums, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """The documents with repeated runs cut from text (kept words joined by a space); untouched texts stay as they are."""
    whole = _prepared(docs)
    joined = whole.join(repeats(whole.select("_mq_id", "_mq_text"), window=window), "_mq_id", "left")
    names = [c for c in docs.columns]
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.by_bytes(batches, len(names)):
            texts = batch.column(len(names))
            out = batch.column(at).to_pylist()
            for i, (words, keep) in enumerate(_masks(texts, batch.column(len(names) + 1), window)):
                if keep is not None:
                    out[i] = b" ".join(compress(words, keep.tolist())).decode()
            columns = [batch.column(i) for i in range(len(names))]
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.select(*names, "_mq_text", "_mq_ranges").mapInArrow(run, docs.schema)


def op8_substring_seed_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
