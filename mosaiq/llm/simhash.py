"""SimHash near-duplicates through an inverted index on byte positions.

A fingerprint's eight bytes are its terms, each with its position. Fingerprints that differ in at most `bits` bits share
at least 8 - bits positional bytes, so the index is keyed by every choice of that many positions: a posting list then
holds exactly the fingerprints whose shared bytes reach the guaranteed minimum on those positions. Within a list the
shared positional bytes are tallied per pair, pairs under the minimum fall out, and the rest are verified by bit count.
Equal fingerprints are one entry, lists hold at most 256 ** bits entries, and long lists look up each entry's bit
neighbours in place of comparing pairs. A list gives a tree of links, which keeps what is reachable.

Defined results: null and empty texts have fingerprint zero and link like any other; texts of fewer words than a
shingle hash as one sequence; repeated rows are one component; a null doc_id gets its fingerprint and, as component, the
smallest id known for that fingerprint (null if there is none); an empty table gives an empty result; other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mosaiq.llm import common, graph

SEED = 42
#: Lists up to this long are compared pair by pair inside the task.
SHORT_LIST = 48


def shingles(texts: list[bytes], words: int) -> tuple[list[bytes], np.ndarray]:
    """XXH64 digests of the shingles of all texts in order, and how many each text has."""
    import xxhash

    digest, seed = xxhash.xxh64_digest, SEED
    raw: list[bytes] = []
    counts = np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        w = text.lower().split()
        if len(w) >= words:
            before = len(raw)
            raw += [digest(s, seed) for s in map(b" ".join, zip(*[w[k:] for k in range(words)]))]
            counts[i] = len(raw) - before
        elif w:
            raw.append(digest(b" ".join(w), seed))
            counts[i] = 1
    return raw, counts


def fingerprint_batch(texts: list[bytes], words: int = 3) -> np.ndarray:
    """Big-endian fingerprint bytes, (n, 8): a bit is 1 if set in over half of the shingles' XXH64."""
    raw, counts = shingles(texts, words)
    out = np.zeros((len(texts), 64), dtype=bool)
    if raw:
        bits = np.unpackbits(np.frombuffer(b"".join(raw), dtype=np.uint8).reshape(-1, 8), axis=1)
        has = np.flatnonzero(counts)
        starts = (np.cumsum(counts) - counts)[has]
        sums = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        out[has] = 2 * sums > counts[has, None]
    return np.packbits(out, axis=1)


def fingerprints(docs: DataFrame, *, words: int = 3) -> DataFrame:
    """doc_id and the 64-bit fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.by_bytes(batches, limit=1 << 20):
            prints = fingerprint_batch(batch.column(1).cast(pa.binary()).to_pylist(), words)
            longs = prints.view(">i8").reshape(-1).astype("<i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(longs)], names=["doc_id", "fp"])

    common.text_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_column().alias("text")).mapInArrow(run, "doc_id long, fp long")


def shared_bytes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Tally of equal bytes at equal positions."""
    different = (x ^ y).view(np.uint8).reshape(*np.broadcast_shapes(x.shape, y.shape), 8)
    return 8 - np.count_nonzero(different, axis=-1)


def _verified(x: np.ndarray, y: np.ndarray, bits: int) -> np.ndarray:
    return (shared_bytes(x, y) >= 8 - bits) & (np.bitwise_count(x ^ y) <= bits)


def list_links(prints: np.ndarray, nodes: np.ndarray, free: list[int], bits: int) -> list[tuple[int, int]]:
    """Tree of links among one posting list's distinct fingerprints; `free` are its bit places that may differ."""
    n = len(prints)
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    if n <= SHORT_LIST:
        left, right = np.triu_indices(n, 1)
        ok = _verified(prints[left], prints[right], bits)
        pairs = zip(left[ok].tolist(), right[ok].tolist())
    else:
        order = np.argsort(prints)
        ranked = prints[order]
        found = []
        for k in range(1, bits + 1):
            for places in combinations(free, k):
                flip = np.uint64(0)
                for p in places:
                    flip |= np.uint64(1) << np.uint64(p)
                wanted = prints ^ flip
                at = np.minimum(np.searchsorted(ranked, wanted), n - 1)
                hit = np.flatnonzero(ranked[at] == wanted)
                keep = hit[_verified(prints[hit], ranked[at[hit]], bits)]
                found.append(np.stack([keep, order[at[keep]]], axis=1))
        pairs = map(tuple, np.concatenate(found).tolist())
    for i, j in pairs:
        a, b = root(i), root(j)
        if a != b:
            if nodes[a] > nodes[b]:
                a, b = b, a
            parent[b] = a
    return [(int(nodes[i]), int(nodes[root(i)])) for i in range(n) if root(i) != i]


def links(prints: DataFrame, *, bits: int = 2) -> DataFrame:
    """Links (a, b) among rows of distinct fp, each named by a long `node`; complete up to reachability."""
    choices = list(combinations(range(8), bits))
    masks = []
    for c in choices:
        mask = 0
        for p in range(8):
            if p not in c:
                mask |= 0xFF << (8 * p)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    table = F.array(*[F.struct(F.lit(i).cast("int").alias("places"), F.lit(m).cast("long").alias("mask")) for i, m in enumerate(masks)])
    postings = prints.select("fp", "node", F.explode(table).alias("p")).select(
        F.col("p.places").alias("places"), F.col("fp").bitwiseAND(F.col("p.mask")).alias("shared"), "fp", "node"
    )
    postings = postings.repartition(common.shuffle_partitions(prints.sparkSession), "places", "shared").sortWithinPartitions("places", "shared", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(i).to_numpy() for i in range(4)]
            if held:
                now = [np.concatenate(x) for x in zip(held, now)]
            new = np.flatnonzero((now[0][1:] != now[0][:-1]) | (now[1][1:] != now[1][:-1])) + 1
            last = int(new[-1]) if len(new) else 0
            out = _runs([x[:last] for x in now], new[:-1])
            held = [x[last:] for x in now]
            if out:
                yield _pairs(out)
        if held:
            out = _runs(held, np.array([], dtype=np.int64))
            if out:
                yield _pairs(out)

    def _runs(columns: list[np.ndarray], cuts: np.ndarray) -> list[tuple[int, int]]:
        if not len(columns[0]):
            return []
        starts = np.append(0, cuts)
        ends = np.append(cuts, len(columns[0]))
        out = []
        for k in np.flatnonzero(ends - starts > 1):
            s, e = int(starts[k]), int(ends[k])
            free = [8 * p + q for p in choices[int(columns[0][s])] for q in range(8)]
            out += list_links(columns[2][s:e].astype(np.uint64), columns[3][s:e], free, bits)
        return out

    def _pairs(out: list[tuple[int, int]]) -> pa.RecordBatch:
        a, b = np.array(out, dtype=np.int64).T
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return postings.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, *, words: int = 3, bits: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable over links of at most `bits` bits."""
    prints = common.materialise(fingerprints(docs, words=words), "fingerprints")
    each = common.materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "distinct")
    found = graph.components(links(each.where("node is not null"), bits=bits))
    named = each.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_simhash_byte_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def keep_one(docs: DataFrame, *, words: int = 5, bits: int = 3) -> DataFrame:
    """The document of smallest doc_id of each component, once; rows without a doc_id, which no link can name, stay."""
    found = near_duplicates(docs, words=words, bits=bits)
    first = found.where("doc_id = component_id").select(F.col("doc_id").alias("_mq_id")).distinct()
    kept = docs.where("doc_id is not null").join(first, docs["doc_id"] == first["_mq_id"]).drop("_mq_id")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))
    return kept.withColumn("_mq_place", place).where("_mq_place = 1").drop("_mq_place").unionByName(docs.where("doc_id is null"))
