"""Benchmark decontamination by latent semantic retrieval, then longest-common-subsequence and answer checks.

Benchmark items are cut into chunks of at most `CHUNK` words. A randomised SVD of TF-IDF rows (hashed to `DIMS` terms) runs
as sums of per-task parts A'AX over all the chunks of a block; its basis has `RANK` dimensions, well under the `BLOCK` chunks
that share it, so the space is theirs and no choice of corpus passages bears on it.
Every passage (window of two half-overlapping steps) of every document is projected into that space and compared with every
chunk by the cosine of the two projections. Candidates over `COSINE` are checked: `FEWEST` of the chunk's `ANSWERS` rarest
words must be there, and the chunk's longest common subsequence with the passage and its surroundings must hold `SHARE` of
its words, so a paraphrase that keeps most words in order is found.

Bounds: a block's basis is DIMS x RANK (4 MB) and `BLOCKS` of them are broadcast and searched in one pass over the
documents; a larger benchmark takes more passes. Document frequencies are of all documents; every passage is scored.

Defined results: null and empty texts or items leak nothing; repeated rows of a doc_id count once; a null doc_id is
reported as null; empty tables give an empty result; other columns stay in `clean`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.llm import common
from mosaiq.llm.words import clean_words

DIMS = 1 << 14
CHUNK = 32
STEP = 32
RANK = 64
BLOCK, BLOCKS = 384, 16
COSINE = 0.35
ANSWERS, FEWEST = 5, 2
SHARE = 0.55
#: Passages scored at a time against a block.
ROWS = 2048


def _terms(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(17)).astype(np.int64) & (DIMS - 1)


def term_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that each hashed term is in, over all documents, and their number; DIMS rows come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIMS, np.int64), 0
        for batch in common.by_bytes(batches, 0):
            h, _, doc = clean_words(batch.column(0))
            df += np.bincount(np.unique(doc * DIMS + _terms(h)) % DIMS, minlength=DIMS)
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.flatnonzero(df), -1)), pa.array(np.append(df[df > 0], n))], names=["t", "n"])

    rows = docs.select(common.text_column().alias("text")).mapInArrow(run, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).collect()
    out, total = np.zeros(DIMS, np.int64), 0
    for r in rows:
        if r["t"] < 0:
            total = r["n"]
        else:
            out[r["t"]] = r["n"]
    return out, total


def chunks_of(text: str) -> list[np.ndarray]:
    h, _, _ = clean_words(pa.array([text], pa.string()))
    return [c for c in np.array_split(h, -(-len(h) // CHUNK))] if len(h) else []


def _weighted(h: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    t, n = np.unique(_terms(h), return_counts=True)
    v = n * idf[t]
    return t, v / max(float(np.linalg.norm(v)), 1e-9)


def randomised_svd(rows: DataFrame, rank: int, rounds: int = 3) -> np.ndarray:
    """Orthonormal basis (DIMS, rank) of the main right singular directions of rows (t array<long>, v array<double>)."""
    spark = rows.sparkSession
    basis = np.random.default_rng(7).standard_normal((DIMS, rank)).astype(np.float32)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(basis)

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x, total = shared.value, np.zeros((DIMS, rank), np.float32)
            for batch in batches:
                for t, v in zip(batch.column(0), batch.column(1)):
                    t, v = t.values.to_numpy(), v.values.to_numpy().astype(np.float32)
                    total[t] += v[:, None] * (v @ x[t])
            used = np.flatnonzero(total.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(list(total[used].astype(np.float64)), pa.list_(pa.float64()))], names=["t", "row"])

        parts = rows.mapInArrow(part, "t long, row array<double>")
        # one sum per term: rows of one term are as many as tasks
        summed = parts.groupBy("t").agg(F.reduce(F.collect_list("row"), F.array_repeat(F.lit(0.0), rank), lambda a, b: F.zip_with(a, b, lambda x, y: x + y)).alias("row"))
        image = np.zeros((DIMS, rank), np.float32)
        for r in summed.toLocalIterator():
            image[r["t"]] = r["row"]
        basis = np.linalg.qr(image)[0].astype(np.float32)
        shared.unpersist()
    return basis


def common_subsequence(places: dict[int, int], size: int, words: list[int]) -> int:
    """Length of the longest common subsequence of a chunk (bit masks of each word's places) and words."""
    full = (1 << size) - 1
    v = full
    for w in words:
        m = places.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


class Block:
    """Chunks of one block: what the checks need, and their latent vectors."""

    def __init__(self, chunks: list[tuple[int, np.ndarray]], idf: np.ndarray, basis: np.ndarray):
        self.items = np.array([i for i, _ in chunks], np.int64)
        self.size = np.array([len(h) for _, h in chunks])
        self.places: list[dict[int, int]] = []
        words, owners = [], []
        for c, (_, h) in enumerate(chunks):
            m: dict[int, int] = {}
            for i, w in enumerate(h.tolist()):
                m[w] = m.get(w, 0) | 1 << i
            self.places.append(m)
            own, first = np.unique(h, return_index=True)
            rare = own[np.lexsort((first, -idf[_terms(own)]))][:ANSWERS]
            words.append(rare)
            owners.append(np.full(len(rare), c))
        self.fewest = np.array([min(FEWEST, len(w)) for w in words])
        words, owners = np.concatenate(words), np.concatenate(owners)
        by = np.argsort(words, kind="stable")
        self.answers, self.owners = words[by], owners[by]
        self.map = (basis * idf[:, None]).astype(np.float32)
        latent = np.zeros((len(chunks), basis.shape[1]), np.float32)
        for c, (_, h) in enumerate(chunks):
            latent[c] = self.map[_terms(h)].sum(axis=0)
        self.latent = latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)

    def answered(self, h: np.ndarray, passage: np.ndarray, passages: int, more: np.ndarray) -> np.ndarray:
        """Sorted keys passage * chunks + chunk of the pairs with answer words enough; passage: of each word, more: whether
        the step belongs to the passage before it, too."""
        at = np.searchsorted(self.answers, h)
        hit = np.flatnonzero(self.answers[np.minimum(at, len(self.answers) - 1)] == h)
        if not len(hit):
            return np.zeros(0, np.int64)
        n = np.searchsorted(self.answers, h[hit], side="right") - at[hit]
        word, where = np.repeat(at[hit], n), np.repeat(passage[hit], n)
        entry = word + np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)
        entry = np.concatenate([entry, entry[more[where]]])
        where = np.concatenate([where, where[more[where]] - 1])
        seen = np.unique(where * len(self.answers) + entry)  # a word counts once
        pair, count = np.unique(seen // len(self.answers) * len(self.items) + self.owners[seen % len(self.answers)], return_counts=True)
        return pair[count >= self.fewest[pair % len(self.items)]]


def find(blocks: list[Block], ids: pa.Array, texts: pa.Array, cosine_least: float = COSINE) -> pa.RecordBatch | None:
    """The leaks of some documents."""
    h, _, doc = clean_words(texts)
    if not len(h):
        return None
    n = np.bincount(doc, minlength=len(texts))
    heads = np.cumsum(n) - n
    steps = -(-n // STEP)
    owner = np.repeat(np.arange(len(n)), steps)
    starts = heads[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(steps) - steps, steps)) * STEP
    edges = np.append(starts, len(h))
    passage = np.repeat(np.arange(len(starts)), np.diff(edges))
    more = np.append(False, owner[1:] == owner[:-1])  # the step also ends the passage before it
    terms = _terms(h)
    found: dict[tuple[int, int], tuple[float, float]] = {}
    for block in blocks:
        pairs = block.answered(h, passage, len(starts), more)
        for a in range(0, len(starts), ROWS):
            b = min(a + ROWS, len(starts))
            last = min(b + 1, len(starts))  # the next step completes the last passage
            part = np.add.reduceat(block.map[terms[edges[a] : edges[last]]], starts[a:last] - edges[a], axis=0)
            two = np.flatnonzero(more[a + 1 : last])
            whole = part[: b - a].copy()
            whole[two] += part[two + 1]
            cosine = (whole @ block.latent.T) / np.maximum(np.linalg.norm(whole, axis=1, keepdims=True), 1e-9)
            near = cosine >= cosine_least
            mine = pairs[np.searchsorted(pairs, a * len(block.items)) : np.searchsorted(pairs, b * len(block.items))]
            p, c = mine // len(block.items), mine % len(block.items)
            ok = near[p - a, c]
            for p, c in zip(p[ok].tolist(), c[ok].tolist()):
                d = owner[p]
                lo, hi = max(heads[d], starts[p] - CHUNK), min(heads[d] + n[d], starts[p] + 2 * STEP + CHUNK)
                share = common_subsequence(block.places[c], int(block.size[c]), h[lo:hi].tolist()) / int(block.size[c])
                key = (int(d), int(block.items[c]))
                if share >= SHARE and share > found.get(key, (0.0, 0.0))[0]:
                    found[key] = (share, float(cosine[p - a, c]))
    if not found:
        return None
    rows = ids.take(pa.array([d for d, _ in found]))
    return pa.RecordBatch.from_arrays([rows, pa.array([i for _, i in found]), pa.array([s for s, _ in found.values()]), pa.array([c for _, c in found.values()])], names=["doc_id", "item_id", "lcs_share", "cosine"])


def leaks(docs: DataFrame, benchmark: DataFrame, *, cosine: float = COSINE) -> DataFrame:
    """(doc_id, item_id, lcs_share, cosine) of every document that holds a benchmark item's chunk."""
    spark = docs.sparkSession
    common.text_batches(spark)
    schema = "doc_id long, item_id long, lcs_share double, cosine double"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_column().alias("text"))
    out = spark.createDataFrame([], schema)
    df, total = term_frequencies(texts)
    idf = np.log((1.0 + total) / (1.0 + df)).astype(np.float32) + np.float32(0.05)

    def solved(chunks: list[tuple[int, np.ndarray]]) -> Block:
        weighted = [_weighted(h, idf) for _, h in chunks]
        own = spark.createDataFrame([(t.tolist(), v.tolist()) for t, v in weighted], "t array<long>, v array<double>")
        return Block(chunks, idf, randomised_svd(common.materialise(own.coalesce(4), "svd_rows"), min(RANK, max(2, len(chunks) // 2))))

    def searched(blocks: list[Block]) -> DataFrame:
        shared = spark.sparkContext.broadcast(blocks)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in common.by_bytes(batches, limit=2 << 20):
                got = find(shared.value, batch.column(0), batch.column(1), cosine)
                if got is not None:
                    yield got

        return common.materialise(texts.mapInArrow(run, schema), "leaks")

    block: list[tuple[int, np.ndarray]] = []
    blocks: list[Block] = []
    for row in benchmark.select(F.col("item_id").cast("long"), common.text_column()).toLocalIterator():
        for c in chunks_of(row[1]):
            block.append((row[0], c))
            if len(block) == BLOCK:
                blocks, block = [*blocks, solved(block)], []
            if len(blocks) == BLOCKS:
                out, blocks = out.unionAll(searched(blocks)), []
    if block:
        blocks.append(solved(block))
    if blocks:
        out = out.unionAll(searched(blocks))
    best = F.max(F.struct("lcs_share", "cosine"))
    return out.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", F.col("b.lcs_share").alias("lcs_share"), F.col("b.cosine").alias("cosine"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without those that leak."""
    bad = leaks(docs, benchmark).select(F.col("doc_id").alias("_mq_bad")).distinct()
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad["_mq_bad"]), "left_anti")


def op1_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
