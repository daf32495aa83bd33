"""Best-fit packing: a configuration linear program over the length histogram.

Documents become token pieces of at most `capacity` ids. The histogram of lengths (at most `capacity` entries) goes to
the driver, where a multiplicative-weights loop with knapsack dynamic-programming pricing solves the covering program
over configurations (multisets of lengths that fit one sequence). Whole parts of its solution become sequences; what
rounding leaves goes best-fit into the free space that is left, then into new sequences. Pieces find their places by
their rank among pieces of equal length, so no task ever holds all pieces of a length.

Defined results: null text is empty; an empty document is one piece of the end id alone; repeated rows are packed each;
an empty table gives an empty result; extra columns are dropped; a null doc_id is carried.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.llm import common, tokens

CAPACITY = 4096
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
#: Length classes of the linear program are multiples of this; real lengths count again when free space is filled.
GRID = 4
ROUNDS = 600
#: Parts into which pieces of one length are ranked.
SALTS = 64

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, *, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(tokens.vocabulary(vocabulary))
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in common.by_bytes(batches):
            out: list[list] = [[], [], [], [], []]
            for doc, ids in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1))):
                raw = ids.tobytes() + end
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    for column, value in zip(out, (doc, k, at // 4, len(part) // 4, zlib.crc32(part))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    common.text_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_column().alias("text")).mapInArrow(pieces, PIECES)


# --- the configuration program, on a histogram of at most `capacity` lengths ---


def knapsack(prices: np.ndarray, room: int) -> np.ndarray:
    """Most valuable multiset of sizes 1..len(prices) within `room`, by dynamic programming; counts per size."""
    m = len(prices)
    best = np.zeros(room + 1)
    took = np.zeros(room + 1, dtype=np.int64)
    for c in range(1, room + 1):
        top = min(c, m)
        values = best[c - top : c][::-1] + prices[:top]
        k = int(values.argmax())
        if values[k] > best[c - 1]:
            best[c], took[c] = values[k], k + 1
        else:
            best[c] = best[c - 1]
    counts = np.zeros(m, dtype=np.int64)
    c = room
    while c > 0:
        if took[c]:
            counts[took[c] - 1] += 1
            c -= int(took[c])
        else:
            c -= 1
    return counts


def solve_configurations(demand: np.ndarray, room: int, rounds: int = ROUNDS) -> list[tuple[np.ndarray, float]]:
    """Fractional (configuration, amount) pairs for min sum(x), sum(a x) >= demand; demand[s - 1] items of size s.

    Multiplicative weights: a size's price falls exponentially with its coverage so far; each round takes the
    configuration of the highest price and adds one round's share of the area bound.
    """
    have = demand > 0
    if not have.any():
        return []
    sizes = np.arange(1, len(demand) + 1)
    step = max(1.0, float((demand * sizes).sum()) / room) / rounds
    covered = np.zeros(len(demand))
    inverse = np.where(have, 1.0 / np.maximum(demand, 1), 0.0)
    eta = 4.0 * np.log(len(demand) + 1.0)
    found: dict[bytes, list] = {}
    for t in range(1, rounds + 1):
        behind = np.where(have, covered * rounds / t, np.inf)
        weight = np.where(have, np.exp(-eta * np.clip(behind - 1.0, -1.5, 1.5)), 0.0)
        prices = sizes / room * weight
        counts = np.minimum(knapsack(prices, room), demand)
        covered += step * counts * inverse
        key = counts.tobytes()
        if key in found:
            found[key][1] += step
        else:
            found[key] = [counts, step]
    return [(a, x) for a, x in found.values() if a.any()]


@dataclass
class Layout:
    """Places for pieces: runs of equal places, sorted by (length, first rank)."""

    length: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = self.length.astype(np.int64) << 42 | self.first
        run = np.searchsorted(key, length.astype(np.int64) << 42 | rank, side="right") - 1
        return self.sequence[run] + rank - self.first[run], self.offset[run]


def plan_layout(histogram: dict[int, int], capacity: int = CAPACITY, grid: int = GRID, rounds: int = ROUNDS) -> Layout:
    """Round the program's solution to whole sequences and list each length's places.

    Amounts are rounded down, largest first, and what that leaves is placed best-fit; where few sequences are needed most
    amounts are under one. Should best-fit alone need fewer sequences (rounding lost more than the program won), it stands.
    """
    grid = max(1, min(grid, capacity // 64))
    left = {n: c for n, c in histogram.items() if c}
    room = capacity // grid
    demand = np.zeros(room, dtype=np.int64)
    for n, c in left.items():
        demand[min(room, -(-n // grid)) - 1] += c
    classes: dict[int, list[int]] = {}
    for n in sorted(left):
        classes.setdefault(min(room, -(-n // grid)) - 1, []).append(n)
    kinds: list[tuple[list[int], int]] = []  # lengths in one sequence, number of such sequences

    for counts, amount in sorted(solve_configurations(demand, room, rounds), key=lambda p: -p[1]):
        wanted = int(amount + 1e-9)
        slots = [k for k in np.flatnonzero(counts)[::-1] for _ in range(int(counts[k]))]
        while wanted:  # real lengths of the classes, largest first; each pass uses up at least one length
            own: dict[int, int] = {}
            lengths = []
            for k in slots:
                n = next((n for n in reversed(classes.get(k, ())) if left[n] > own.get(n, 0)), None)
                if n is None:
                    break
                own[n] = own.get(n, 0) + 1
                lengths.append(n)
            if len(lengths) < len(slots) or sum(lengths) > capacity:
                break
            times = min(wanted, *(left[n] // c for n, c in own.items()))
            kinds.append((lengths, times))
            for n, c in own.items():
                left[n] -= c * times
            wanted -= times
    _best_fit(kinds, left, capacity)
    alone: list[tuple[list[int], int]] = []
    _best_fit(alone, {n: c for n, c in histogram.items() if c}, capacity)
    if sum(times for _, times in alone) < sum(times for _, times in kinds):
        kinds = alone

    runs: list[tuple[int, int, int, int]] = []
    used: dict[int, int] = {}
    sequence = 0
    for lengths, times in kinds:
        offset = 0
        for n in lengths:
            runs.append((n, used.get(n, 0), sequence, offset))
            used[n] = used.get(n, 0) + times
            offset += n
        sequence += times
    runs.sort()
    columns = np.array(runs, dtype=np.int64).reshape(-1, 4).T
    return Layout(*columns, sequences=sequence)


def _best_fit(kinds: list[tuple[list[int], int]], left: dict[int, int], capacity: int) -> None:
    """Place the remaining lengths, longest first, where least space stays free; sequences of one kind move together."""
    free: dict[int, list[int]] = {}
    for i, (lengths, _) in enumerate(kinds):
        free.setdefault(capacity - sum(lengths), []).append(i)
    spaces = np.zeros(capacity + 1, dtype=bool)
    for f in free:
        spaces[f] = True
    for n in sorted((n for n, c in left.items() if c), reverse=True):
        todo = left[n]
        while todo:
            ahead = np.flatnonzero(spaces[n:])
            if len(ahead):
                f = n + int(ahead[0])
                i = free[f].pop()
                if not free[f]:
                    del free[f]
                    spaces[f] = False
                lengths, times = kinds[i]
                each = 1 if times > todo else min(f // n, todo // times)
                moved = min(times, todo)
                if moved < times:
                    kinds[i] = (lengths, times - moved)
                    free.setdefault(f, []).append(i)
                    spaces[f] = True
                    i = len(kinds)
                    kinds.append((lengths, moved))
            else:
                each = min(capacity // n, todo)
                moved = todo // each
                lengths, f, i = [], capacity, len(kinds)
                kinds.append((lengths, moved))
            kinds[i] = (lengths + [n] * each, moved)
            todo -= each * moved
            f -= each * n
            free.setdefault(f, []).append(i)
            spaces[f] = True
        left[n] = 0


def pack(pieces: DataFrame, *, capacity: int = CAPACITY, grid: int = GRID, rounds: int = ROUNDS) -> DataFrame:
    """Add sequence_id and offset to rows that have doc_id, piece and length (at most `capacity`).

    Each piece gets its rank among pieces of its length from a window over (length, salt) and the sizes of the salts
    before; both tables of sizes have at most capacity x SALTS rows, which bounds what is broadcast and collected.
    """
    spark = pieces.sparkSession
    # equal (doc_id, piece) rows need not stay apart: they are alike, so the salt may deal them together
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)).cast("int"))
    sizes = [tuple(r) for r in salted.groupBy("length", "_salt").count().collect()]
    histogram: dict[int, int] = {}
    bases = []
    for n, salt, c in sorted(sizes):
        bases.append((n, salt, histogram.get(n, 0)))
        histogram[n] = histogram.get(n, 0) + c
    layout = plan_layout(histogram, capacity, grid, rounds)
    known = spark.createDataFrame(bases or [(0, 0, 0)], "length long, _salt int, _base long")
    rank = F.row_number().over(_order()) - 1
    ranked = salted.join(F.broadcast(known), ["length", "_salt"]).withColumn("_rank", F.col("_base") + rank)
    shared = spark.sparkContext.broadcast(layout)
    columns = [c for c in pieces.columns]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seq, off = shared.value.place(batch.column("length").to_numpy(), batch.column("_rank").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in columns] + [pa.array(seq, pa.int64()), pa.array(off, pa.int64())], names=columns + ["sequence_id", "offset"])

    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([*(pieces.schema[c] for c in columns), StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return ranked.select(*columns, "_rank").mapInArrow(place, schema)


def _order():
    from pyspark.sql import Window

    return Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")


def pack_documents(docs: DataFrame, **options) -> DataFrame:
    """Tokenise, cut and pack whole documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(common.materialise(token_pieces(docs), "pieces"), **options)


def op4_pack_configuration_lp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
