"""Quality by two interpolated modified Kneser-Ney models over character n-grams of words: trusted text against rejected text.

Trusted are the documents labelled good and not toxic, rejected those labelled bad or toxic; all of them are counted. A word
is a sequence of symbols: a start mark, another if it repeats the word before it, its characters, an end mark; contexts stay
inside the word, so equal words score alike and each distinct word of a slice of documents is scored once. Counts,
continuation counts and discounts come from groupings and joins of n-gram strings, sharded by Spark; n-grams at a word's
start keep their raw counts, as no other context precedes them. A model is stored as additive parts: each n-gram's gain over
its shorter form and each context's backoff weight, so a word's log probability is the sum of what its n-grams find.

Scoring is a sharded join. A slice (about `SLICE` bytes, see `slices`) packs the sorted 48-bit keys of its distinct n-grams into one row
per shard of the model; in the shard's partition the model's rows come first and the questions stream past them, and the
answers go back to the slice in the order asked. A worker holds one shard of the model (about `SHARD` n-grams) or one slice.

A document has two measures: log perplexity per symbol under the trusted model, and its worst window, the largest sum over
`WINDOW` words in a row of the log ratio of the rejected model to the trusted one, so a few words count however long the
text is. The limit of each is the `QUANTILE` of its language's trusted documents kept out of training (one text in
`HELD_OUT`, by hash), raised halfway to the lowest of the rejected documents that lie above it; languages with fewer than `LEAST_HELD` such trusted documents take the limit of all languages together.

Defined results: null or blank text has null measures and is kept; without trusted documents all are kept, without rejected
ones to train on only perplexity decides; an id labelled both ways is trusted; repeated rows are scored each; null lang is
the language ''; a null doc_id is scored but never trusted; an empty table gives an empty result; other columns stay in
`classify`, whose own columns begin with _mq_ (a caller's column of such a name is refused).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from mosaiq.llm import common

ORDER = 5
SLICE = 12 << 20
SHARD = 1 << 20
#: Distinct words hashed at a time within a slice.
PIECE = 1 << 14
#: Words summed by document at a time.
PIECES = 1 << 17
WINDOW = 4
QUANTILE = 0.995
LEAST_HELD = 50
HELD_OUT = 5
# Symbols that no text is expected to hold (Unicode noncharacters).
EDGE, FRESH, AGAIN, STOP = 0xFDD0, 0xFDD1, 0xFDD2, 0xFDD3
_K = np.uint64(0x9E3779B97F4A7C15)
#: Labelled documents whose ids (8 bytes each) may be broadcast.
MOST_BROADCAST = 2_000_000
#: Languages whose limits may be broadcast.
MOST_LANGUAGES = 10_000
TRAIN, HELD, BAD, BAD_HELD = 1, 2, 3, 4


# --- words of a slice ---


class Words:
    """The words of some texts: `codes` (a type per word), `n` (words per text) and, per type, its symbols.

    A type is a word and whether it repeats the word before it. Symbols of all types lie in one array, each type as
    order - 1 edges, the start mark, its characters and the end mark.
    """

    def __init__(self, codes: np.ndarray, n: np.ndarray, types: np.ndarray, chars: np.ndarray, lens: np.ndarray):
        self.codes, self.n, self.types, self.chars, self.lens = codes, n, types, chars, lens
        self.heads = np.cumsum(lens) - lens

    @classmethod
    def of(cls, parts: list[pa.Array]) -> Words:
        """The words of some runs of texts; each run is split on its own, so that no large copy is made."""
        counts, coded = [], []
        for texts in parts:
            lists = pc.ascii_split_whitespace(texts)
            counts.append(pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            coded.append(pc.dictionary_encode(lists.flatten()))
            del lists
        n = np.concatenate(counts)
        coded = pa.chunked_array(coded).unify_dictionaries()
        words = coded.chunk(0).dictionary
        codes = np.concatenate([c.indices.to_numpy(zero_copy_only=False) for c in coded.chunks])
        del coded
        pa.default_memory_pool().release_unused()  # the pool would keep what the parts took
        lens = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(codes):
            real = lens[codes] > 0
            upto = np.append(0, np.cumsum(real))
            ends = np.cumsum(n)
            n = upto[ends] - upto[ends - n]
            codes = codes[real]
            del real, upto
        again = np.append(False, codes[1:] == codes[:-1])[: len(codes)]
        again[(np.cumsum(n) - n)[n > 0]] = False
        often = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")  # frequent words first: small codes
        rank = np.empty(len(often), np.int32)
        rank[often] = np.arange(len(often), dtype=np.int32)
        words, lens = words.take(pa.array(often)), lens[often]
        kinds = rank[codes] * 2 + again
        used = np.flatnonzero(np.bincount(kinds, minlength=2 * len(words)))
        place = np.zeros(2 * len(words), np.int32)
        place[used] = np.arange(len(used), dtype=np.int32)
        own, types = place[kinds], used
        del kinds, codes, again
        whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "")  # in Arrow: no string a word
        chars = np.frombuffer(whole[0].as_py().encode("utf-32-le"), "<u4").astype(np.uint32)
        chars[chars == 0] = 0xFFFD
        return cls(own.astype(np.int32, copy=False), n, np.asarray(types, np.int64), chars, lens)

    def packed(self) -> bytes:
        text = np.frombuffer(self.chars.tobytes().decode("utf-32-le").encode(), np.uint8)
        steps = np.diff(self.types, prepend=0).astype(np.int32)
        lists = [np.frombuffer(_planes(self.codes), np.uint8), self.n, steps, text, self.lens.astype(np.int32)]
        arrays = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)) for x in lists]
        return _packed(pa.RecordBatch.from_arrays(arrays, names=["codes", "n", "types", "text", "lens"]))

    @classmethod
    def unpacked(cls, raw: bytes) -> Words:
        codes, n, steps, text, lens = (c.chunk(0).values.to_numpy() for c in pa.ipc.open_stream(raw).read_all().columns)
        chars = np.frombuffer(text.tobytes().decode().encode("utf-32-le"), "<u4")
        return cls(_unplanes(codes.tobytes(), "<i4"), n, np.cumsum(steps, dtype=np.int64), chars, lens.astype(np.int64))

    def symbols(self, types: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of those types (places in `self.types`), the places of predicted ones, and the first such of each type."""
        words, again = self.types[types] >> 1, (self.types[types] & 1).astype(bool)
        n = self.lens[words]
        size = n + order + 1
        head = np.cumsum(size) - size
        out = np.full(int(size.sum()), EDGE, np.uint32)
        out[head + order - 1] = np.where(again, AGAIN, FRESH)
        out[head + size - 1] = STOP
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(head + order, n) + inside] = self.chars[np.repeat(self.heads[words], n) + inside]
        spots = np.arange(int((n + 2).sum())) + np.repeat((order - 1) * np.arange(1, len(n) + 1), n + 2)
        return out, spots, np.cumsum(n + 2) - (n + 2)

    def pieces(self) -> Iterator[np.ndarray]:
        for a in range(0, len(self.types), PIECE):
            yield np.arange(a, min(a + PIECE, len(self.types)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def gram_hashes(symbols: np.ndarray, order: int) -> Iterator[np.ndarray]:
    """Hashes of the 1..order-grams that end at each place."""
    codes, h = symbols.astype(np.uint64), np.zeros(len(symbols), np.uint64)
    for k in range(order):
        back = np.full(len(codes), EDGE, np.uint64)
        back[k:] = codes[: len(codes) - k]
        h = _mix((h ^ back) * _K + np.uint64(k + 1))
        yield h


def key_of(h: np.ndarray) -> np.ndarray:
    """The 48 bits of a hash by which models are asked."""
    return h >> np.uint64(16)


def questions(words: Words, order: int) -> np.ndarray:
    """Sorted keys of all n-grams that scoring these words looks up."""
    found = []
    for types in words.pieces():
        symbols, spots, _ = words.symbols(types, order)
        for k, h in enumerate(gram_hashes(symbols, order), 1):
            found.append(pd.unique(key_of(h[spots])))
            if k < order:
                found.append(key_of(h[order - 2 : order - 1]))  # the context of a word's first symbol: edges only
    return np.unique(np.concatenate(found)) if found else np.array([], np.uint64)


def type_scores(words: Words, keys: np.ndarray, parts: np.ndarray, start: tuple[float, float], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log probability, log ratio and number of symbols of each type; parts: a row (gain, back, more_gain, more_back) per key."""
    logp, ratio, count = [], [], []
    for types in words.pieces():
        symbols, spots, heads = words.symbols(types, order)
        sums = np.tile(np.array(start), (len(spots), 1))
        for k, h in enumerate(gram_hashes(symbols, order), 1):
            code, own = pd.factorize(key_of(h))
            at = np.minimum(np.searchsorted(keys, own), max(len(keys) - 1, 0))
            got = np.where((keys[at] == own)[:, None], parts[at], 0.0) if len(keys) else np.zeros((len(own), 4))
            sums += got[:, [0, 2]][code[spots]]
            if k < order:
                sums += got[:, [1, 3]][code[spots - 1]]
        total = np.add.reduceat(sums, heads, axis=0)
        logp.append(total[:, 0])
        ratio.append(total[:, 1])
        count.append(np.diff(np.append(heads, len(spots))))
    if not logp:
        return np.zeros(0), np.zeros(0), np.zeros(0, np.int64)
    return np.concatenate(logp), np.concatenate(ratio), np.concatenate(count)


# --- slices of documents ---


def _packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=5))) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def slices(docs: DataFrame, names: list[str]) -> DataFrame:
    """Rows (slice, rows, words): documents in order of reading, about SLICE bytes a row: their columns `names` and their
    words, each packed and compressed; written, so that slice names stay. docs also has _mq_text. Carried columns count
    twice, as they are held packed and unpacked beside the words: with their texts in them, a slice has a third of the texts."""
    place = docs.columns.index("_mq_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def close() -> pa.RecordBatch:
            words = Words.of([b.column(place) for b in held]).packed()
            row = [uuid.uuid4().int >> 65, _packed(pa.concat_batches([b.select(names) for b in held])), words]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.binary(), pa.binary()))], names=["slice", "rows", "words"])

        for batch in common.by_bytes(batches, place):
            held.append(batch)
            size += (pc.sum(pc.binary_length(batch.column(place))).as_py() or 0) + 2 * batch.select(names).nbytes
            if size >= SLICE:
                row = close()
                held, size = [], 0
                yield row
                del row
                pa.default_memory_pool().release_unused()
        if held:
            yield close()

    return common.materialise_by(docs.mapInArrow(run, "slice long, rows binary, words binary"), "slice", "slices")


# --- training ---


def count_grams(sliced: DataFrame, order: int = ORDER) -> DataFrame:
    """(use, gram, c): the order-grams of the texts marked TRAIN and BAD; sliced rows hold the column _mq_use."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, packed in zip(batch.column(0), batch.column(1)):
                use = pa.ipc.open_stream(raw.as_py()).read_all().column("_mq_use").to_numpy()
                words = Words.unpacked(packed.as_py())
                each = np.repeat(use, words.n)
                for mark in (TRAIN, BAD):
                    weight = np.bincount(words.codes[each == mark], minlength=len(words.types))
                    yield from _weighted_grams(words, weight, mark, order)

    found = sliced.select("rows", "words").mapInArrow(run, "use int, gram string, c long")
    return found.groupBy("use", "gram").agg(F.sum("c").alias("c"))


def _weighted_grams(words: Words, weight: np.ndarray, mark: int, order: int) -> Iterator[pa.RecordBatch]:
    used = np.flatnonzero(weight)
    for a in range(0, len(used), PIECE):
        types = used[a : a + PIECE]
        symbols, spots, heads = words.symbols(types, order)
        *_, h = gram_hashes(symbols, order)
        code, own = pd.factorize(h[spots])
        c = np.bincount(code, weights=np.repeat(weight[types], np.diff(np.append(heads, len(spots)))), minlength=len(own)).astype(np.int64)
        first = np.empty(len(own), np.int64)
        first[code[::-1]] = np.arange(len(spots))[::-1]  # the last to be written stays
        windows = np.ascontiguousarray(symbols[spots[first][:, None] + np.arange(1 - order, 1)])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), mark, np.int32)), pa.array(windows.view(f"<U{order}").ravel().tolist(), pa.string()), pa.array(c)], names=["use", "gram", "c"])


def train(counts: DataFrame, order: int = ORDER) -> tuple[DataFrame, dict[int, float]]:
    """Parts (use, gram, gain, back) of the models of each use, and each one's log probability of an unseen symbol.

    counts: (use, gram, c) of distinct order-grams. What comes to the driver is four rows an order and use.
    """
    spark = counts.sparkSession
    level = common.materialise(counts.select("use", F.lit(order).alias("k"), "gram", "c", F.col("c").alias("a")), "grams")
    every = level
    for k in range(order - 1, 0, -1):
        level = level.groupBy("use", F.substring("gram", 2, k).alias("gram")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("cc"))
        starts = F.startswith("gram", F.lit(chr(EDGE)))
        level = common.materialise(level.select("use", F.lit(k).alias("k"), "gram", "c", F.when(starts, F.col("c")).otherwise(F.col("cc")).alias("a")), "grams")
        every = every.unionAll(level)
    low: dict[tuple, int] = {(r["use"], r["k"], r["a"]): r["n"] for r in every.where("a <= 4").groupBy("use", "k", "a").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = [(use, k, *discounts([low.get((use, k, i), 0) for i in range(1, 5)])) for use, k in sorted({key[:2] for key in low} | {(r["use"], k) for r in every.select("use").distinct().collect() for k in range(1, order + 1)})]
    off = F.broadcast(spark.createDataFrame(rows, "use int, k int, d1 double, d2 double, d3 double"))  # a row an order and use
    every = every.join(off, ["use", "k"]).withColumn("off", F.when(F.col("a") == 1, F.col("d1")).when(F.col("a") == 2, F.col("d2")).otherwise(F.col("d3")))
    context = Window.partitionBy("use", "k", "ctx")  # at most as many rows as there are characters
    every = every.withColumn("ctx", F.expr("substring(gram, 1, k - 1)")).withColumns({"s": F.sum("a").over(context), "gamma": F.sum("off").over(context) / F.sum("a").over(context)})
    every = common.materialise(every.select("use", "k", "gram", "ctx", ((F.col("a") - F.col("off")) / F.col("s")).alias("own"), "gamma"), "parts")
    roots = every.where("k = 1").groupBy("use").agg(F.first("gamma").alias("g"), F.count(F.lit(1)).alias("n")).collect()
    unseen = {r["use"]: float(np.log(r["g"] / (r["n"] + 1))) for r in roots}
    floor = F.create_map(*[F.lit(x) for pair in unseen.items() for x in pair]) if unseen else F.create_map(F.lit(0), F.lit(0.0))
    full = every.where("k = 1").select("use", "gram", (F.col("own") + F.exp(floor[F.col("use")])).alias("p"), F.exp(floor[F.col("use")]).alias("q"))
    gains = full
    for k in range(2, order + 1):
        now = every.where(F.col("k") == k).withColumn("suf", F.substring("gram", 2, k - 1)).join(full.select("use", F.col("gram").alias("suf"), F.col("p").alias("lower")), ["use", "suf"])
        full = common.materialise(now.select("use", "gram", (F.col("own") + F.col("gamma") * F.col("lower")).alias("p"), (F.col("gamma") * F.col("lower")).alias("q")), f"order{k}")
        gains = gains.unionAll(full)
    gains = gains.select("use", "gram", F.log(F.col("p") / F.col("q")).alias("gain"), F.lit(0.0).alias("back"))
    backs = every.where("k > 1").select("use", F.col("ctx").alias("gram"), F.lit(0.0).alias("gain"), F.log("gamma").alias("back")).distinct()
    return gains.unionAll(backs), unseen


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Discounts of counts 1, 2 and 3 or more, from the numbers of n-grams of counts 1 to 4."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    return tuple(min(max(i - (i + 1) * y * n[i] / n[i - 1] if n[i - 1] else 0.5 * i, 0.05), i - 0.05) for i in (1, 2, 3))


def against(parts: DataFrame) -> DataFrame:
    """(gram, gain, back, more_gain, more_back): the trusted model's parts, and the rejected one's less the trusted one's."""
    total = lambda name, mark: F.sum(F.when(F.col("use") == mark, F.col(name)).otherwise(0.0))
    columns = [total(c, TRAIN).alias(c) for c in ("gain", "back")] + [(total(c, BAD) - total(c, TRAIN)).alias(f"more_{c}") for c in ("gain", "back")]
    return common.materialise(parts.groupBy("gram").agg(*columns), "model")


# --- scoring ---

ASKED = "shard int, kind int, slice long, keys binary, parts binary"
_ASKED = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("slice", pa.int64()), ("keys", pa.binary()), ("parts", pa.binary())])


def _by_shard(keys: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """Shards (the keys' leading bits) with the first and the last place of each among sorted keys."""
    edges = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(48 - bits))
    yield from ((s, int(a), int(b)) for s, (a, b) in enumerate(zip(edges, np.append(edges[1:], len(keys)))))


def _planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte, all first bytes first: what is small or zero throughout is squeezed by the shuffle's compression."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def _unplanes(raw: bytes, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _coded(keys: np.ndarray) -> bytes:
    """Sorted keys as the planes of their steps."""
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def _decoded(raw: bytes) -> np.ndarray:
    return np.cumsum(_unplanes(raw, "<u8"), dtype=np.uint64)


def _table(raw: bytes) -> np.ndarray:
    """The four parts of each key, from their planes one part after another."""
    return _unplanes(raw, "<f4").reshape(4, -1).T


def _shard_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ASKED)], schema=_ASKED)


def _larger(batches: Iterator[pa.RecordBatch], rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Batches of some thousand rows joined, so that a shard's rows are packed together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.concat_batches(held)
            held = []
    if sum(b.num_rows for b in held):
        yield pa.concat_batches(held)


def score(sliced: DataFrame, model: DataFrame, start: tuple[float, float], columns: StructType, *, order: int = ORDER) -> DataFrame:
    """The given columns of every document with _mq_n (its symbols), _mq_logp and _mq_window; model as of `against`, start:
    an unseen symbol's log probability and the ratio of the other model's to it."""
    spark = sliced.sparkSession
    partitions = common.shuffle_partitions(spark)
    bits = int(np.ceil(np.log2(max(4 * partitions, model.count() / SHARD, 1))))
    names = ["gain", "back", "more_gain", "more_back"]

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _larger(batches):
            grams = batch.column(0).to_pylist()
            n = np.array([len(g) for g in grams])
            symbols = np.frombuffer("".join(grams).encode("utf-32-le"), "<u4")
            keys, ends = np.zeros(len(n), np.uint64), np.cumsum(n) - 1
            for k, h in enumerate(gram_hashes(symbols, order), 1):
                keys[n == k] = key_of(h[ends[n == k]])
            by = np.argsort(keys)
            keys, parts = keys[by], np.stack([batch.column(c).to_numpy() for c in names], axis=1)[by].astype("<f4")
            yield _shard_rows([(s, 0, 0, _coded(keys[a:b]), _planes(parts[a:b].T.ravel())) for s, a, b in _by_shard(keys, bits) if b > a])

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, packed in zip(batch.column(0), batch.column(1)):
                keys = questions(Words.unpacked(packed.as_py()), order)
                yield _shard_rows([(s, 1, name.as_py(), _coded(keys[a:b]), None) for s, a, b in _by_shard(keys, bits)])

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, own, keys, parts = -1, [], None, None
        for batch in batches:
            out = []
            for s, kind, name, raw, found in zip(*(c.to_pylist() for c in batch.columns)):
                if s != shard:
                    shard, own, keys = s, [], None
                if kind == 0:
                    own.append((_decoded(raw), _table(found)))
                    continue
                if keys is None:  # the model's rows of a shard come before all questions to it
                    keys = np.concatenate([k for k, _ in own]) if own else np.zeros(0, np.uint64)
                    by = np.argsort(keys)
                    keys, parts = keys[by], (np.concatenate([p for _, p in own]) if own else np.zeros((0, 4), "<f4"))[by]
                asked = _decoded(raw)
                at = np.minimum(np.searchsorted(keys, asked), max(len(keys) - 1, 0))
                got = np.where((keys[at] == asked)[:, None], parts[at], np.float32(0)) if len(keys) else np.zeros((len(asked), 4), "<f4")
                out.append((s, 1, name, None, _planes(got.astype("<f4").T.ravel())))
            if out:
                yield _shard_rows(out)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, packed, answers in zip(*batch.columns):
                rows, words = pa.ipc.open_stream(raw.as_py()).read_all(), Words.unpacked(packed.as_py())
                keys = questions(words, order)
                found = sorted((a["shard"], a["parts"]) for a in answers.as_py() or [])
                parts = np.concatenate([_table(p) for _, p in found]).astype(np.float64) if found else np.zeros((0, 4))
                if len(parts) != len(keys):
                    raise AssertionError("a slice lacks answers")
                logp, ratio, count = type_scores(words, keys, parts, start, order)
                n, total, worst = (np.concatenate(x) for x in zip(*_by_document(words, logp, ratio, count)))
                kept = rows.select(columns.names).append_column("_mq_n", pa.array(n)).append_column("_mq_logp", pa.array(total))
                yield from kept.append_column("_mq_window", pa.array(worst, from_pandas=True)).to_batches(max_chunksize=1000)

    both = model.select("gram", *names).mapInArrow(held, ASKED).unionAll(sliced.select("slice", "words").mapInArrow(wanted, ASKED))
    both = both.repartition(partitions, "shard").sortWithinPartitions("shard", "kind")
    answers = both.mapInArrow(answered, ASKED).groupBy("slice").agg(F.collect_list(F.struct("shard", "parts")).alias("answers"))  # bounded by the slice
    shape = StructType([*columns.fields, StructField("_mq_n", LongType()), StructField("_mq_logp", DoubleType()), StructField("_mq_window", DoubleType())])
    return sliced.join(answers, "slice", "left").select("rows", "words", "answers").mapInArrow(scored, shape)


def _by_document(words: Words, logp: np.ndarray, ratio: np.ndarray, count: np.ndarray) -> Iterator[tuple]:
    """Symbols, log probability and worst window of runs of documents of about PIECES words each (or one longer one)."""
    ends = np.cumsum(words.n)
    cuts = [0, *(np.flatnonzero(np.diff(ends // PIECES)) + 1).tolist(), len(ends)] if len(ends) else [0, 0]
    for a, b in zip(cuts, cuts[1:]):
        n = words.n[a:b]
        codes, own = words.codes[ends[a] - n[0] : ends[b - 1]] if b > a else words.codes[:0], np.repeat(np.arange(b - a), n)
        sums = [np.bincount(own, weights=x[codes], minlength=b - a) for x in (count, logp)]
        yield sums[0].astype(np.int64), sums[1], worst_windows(ratio[codes], own, n)


def worst_windows(ratio: np.ndarray, own: np.ndarray, n: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Largest sum of `window` values in a row (all of them in shorter texts) of each text; nan where n is 0."""
    out = np.full(len(n), np.nan)
    if len(ratio):
        first = np.cumsum(n) - n
        upto = np.append(0.0, np.cumsum(ratio))
        end = np.arange(1, len(ratio) + 1)
        sums = upto[end] - upto[np.maximum(first[own], end - window)]
        sums[end - first[own] < np.minimum(n[own], window)] = -np.inf
        out[n > 0] = np.maximum.reduceat(sums, first[n > 0])
    return out


def limits(rows: DataFrame, measure: str, name: str) -> tuple[DataFrame, float | None]:
    """(_mq_lang, name) of languages with trusted documents enough kept out of training, and the limit of all together."""
    known = rows.where(F.col("_mq_use").isin(HELD, BAD, BAD_HELD) & F.col(measure).isNotNull()).select("_mq_lang", "_mq_use", F.col(measure).alias("m"))
    trusted, m = F.col("_mq_use") == HELD, F.col("m")
    quantile = (F.percentile_approx(F.when(trusted, m), QUANTILE, 10_000).alias("q"), F.count(F.when(trusted, 1)).alias("held"))
    limit = (F.col("q") + F.coalesce((F.min(F.when(~trusted & (m > F.col("q")), m)) - F.col("q")) / 2, F.lit(0.0))).alias(name)
    by_lang = known.groupBy("_mq_lang").agg(*quantile).where(F.col("held") >= LEAST_HELD)
    by_lang = known.join(by_lang, "_mq_lang").groupBy("_mq_lang", "q").agg(limit).select("_mq_lang", name)
    overall = known.crossJoin(F.broadcast(known.agg(*quantile))).groupBy("q").agg(limit).head()  # one row
    return by_lang, overall[name] if overall else None


def classify(docs: DataFrame, labels: DataFrame, *, columns: list[str] | None = None, order: int = ORDER) -> DataFrame:
    """The documents (those columns of them, or all) with _mq_logppl, _mq_limit, _mq_window, _mq_window_limit and _mq_keep added."""
    common.text_batches(docs.sparkSession)
    clash = [c for c in docs.columns if c.startswith("_mq_")]
    if clash:
        raise ValueError(f"columns of reserved names: {clash}")
    toxic = F.coalesce(F.col("toxic") != 0, F.lit(False))
    good = F.when((F.col("quality") == 1) & ~toxic, True).when((F.col("quality") == 0) | toxic, False)
    marks = labels.select(F.col("doc_id").alias("_mq_id"), good.alias("_mq_good")).where("_mq_id is not null and _mq_good is not null")
    marks = common.materialise(marks.groupBy("_mq_id").agg(F.max("_mq_good").alias("_mq_good")), "marks")
    if marks.count() <= MOST_BROADCAST:  # beyond it the join shuffles
        marks = F.broadcast(marks)
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    held = F.pmod(F.xxhash64(common.text_column()), F.lit(HELD_OUT)) == 0  # by text, so that copies are kept out together
    use = F.when(F.col("_mq_good"), F.when(held, HELD).otherwise(TRAIN)).when(~F.col("_mq_good"), F.when(held, BAD_HELD).otherwise(BAD)).otherwise(0)
    marked = docs.join(marks, docs["doc_id"] == marks["_mq_id"], "left").withColumns({"_mq_use": use.cast("int"), "_mq_lang": lang, "_mq_text": common.text_column()}).drop("_mq_id", "_mq_good")
    out = StructType([f for f in marked.schema.fields if f.name in ("_mq_use", "_mq_lang") or (f.name != "_mq_text" and (columns is None or f.name in columns))])
    sliced = slices(marked.select(*out.names, "_mq_text"), out.names)
    parts, unseen = train(count_grams(sliced, order), order)
    base = unseen.get(TRAIN, 0.0)
    rows = score(sliced, against(parts), (base, unseen.get(BAD, 0.0) - base), out, order=order)
    rows = rows.withColumn("_mq_logppl", F.when(F.col("_mq_n") > 0, -F.col("_mq_logp") / F.col("_mq_n"))).drop("_mq_n", "_mq_logp")
    if BAD not in unseen or TRAIN not in unseen:
        rows = rows.withColumn("_mq_window", F.lit(None).cast("double"))
    rows = common.materialise(rows, "scored")
    keep = F.lit(True)
    for measure, name in (("_mq_logppl", "_mq_limit"), ("_mq_window", "_mq_window_limit")):
        by_lang, rest = limits(rows, measure, name)
        by_lang = common.materialise(by_lang, "limits")
        if by_lang.count() <= MOST_LANGUAGES:  # beyond it the join shuffles
            by_lang = F.broadcast(by_lang)
        rows = rows.join(by_lang, "_mq_lang", "left").withColumn(name, F.coalesce(name, F.lit(rest).cast("double")))
        keep = keep & F.coalesce(F.col(measure) <= F.col(name), F.lit(True))
    return rows.withColumn("_mq_keep", keep).drop("_mq_use", "_mq_lang")


def op9_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    rows = classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), columns=["doc_id", "lang"])
    return rows.select("doc_id", "lang", F.exp("_mq_logppl").alias("perplexity"), F.exp("_mq_limit").alias("threshold"), F.col("_mq_window").alias("worst_window"), F.col("_mq_window_limit").alias("window_limit"), F.col("_mq_keep").alias("keep"))
