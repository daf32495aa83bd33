"""Document fingerprints by SpotSigs: an anchor (common) word and the chain of content words after it form a signature.

A fingerprint is the document's set of 32-bit signature hashes, sorted, in base64. Likeness is the Jaccard index of two
sets; sets whose sizes alone rule the threshold out are not compared.

Defined results: null text is empty and has the empty fingerprint; two empty fingerprints have likeness 1, an empty and
another 0; a text without any complete chain has one signature, the hash of all its words; rows that repeat a doc_id
follow each other by text; a null doc_id sorts first; a single document's next is itself; an empty table gives an empty
result; other columns are dropped.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.llm import common
from mosaiq.llm.words import clean_words

# Common words of four languages, which anchor signatures.
ANCHORS = frozenset(
    "the of and to in is that for it was on with as be by this are at from an or not "
    "le la les de des et en un une que qui dans pour par sur du au est "
    "der die das und den dem zu von mit ist nicht ein eine im auf "
    "el los las y se del con su lo es para como".split()
)
CHAIN = 2
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def signature_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct uint32 signatures of each text."""
    h, anchor, doc = clean_words(texts, ANCHORS)
    spots = np.flatnonzero(anchor)
    content = np.flatnonzero(~anchor)
    first = np.searchsorted(content, spots)
    ok = first + CHAIN <= len(content)
    spots, first = spots[ok], first[ok]
    last = content[first + CHAIN - 1] if len(spots) else spots
    ok = doc[last] == doc[spots]
    spots, first = spots[ok], first[ok]
    sig = h[spots]
    for k in range(CHAIN):
        sig = (sig ^ (sig >> np.uint64(29))) * _A + h[content[first + k]] * _B
    sig ^= sig >> np.uint64(32)
    key = np.unique(doc[spots].astype(np.uint64) << np.uint64(32) | sig & np.uint64(0xFFFFFFFF))
    owner = (key >> np.uint64(32)).astype(np.int64)
    values = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    edges = np.searchsorted(owner, np.arange(len(texts) + 1))
    sets = [values[a:b] for a, b in zip(edges, edges[1:])]
    upto = np.searchsorted(doc, np.arange(len(texts) + 1))
    for i in np.flatnonzero((np.diff(edges) == 0) & (np.diff(upto) > 0)):
        own = h[upto[i] : upto[i + 1]].tobytes()
        sets[i] = np.frombuffer(hashlib.blake2b(own, digest_size=4).digest(), dtype="<u4")
    return sets


def to_text(signatures: np.ndarray) -> str:
    return base64.b64encode(signatures.astype("<u4").tobytes()).decode()


def jaccard(x: np.ndarray, y: np.ndarray, least: float = 0.0) -> float:
    """Jaccard index of two sorted sets; 0 without looking inside where sizes keep it under `least`."""
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    if min(len(x), len(y)) < least * max(len(x), len(y)):
        return 0.0
    both = np.concatenate([x, y])
    both.sort()
    common_ = int(np.count_nonzero(both[1:] == both[:-1]))
    return common_ / (len(both) - common_)


def with_next(docs: DataFrame) -> DataFrame:
    """Rows in range buckets of doc_id; each bucket also has a copy (_guest) of the first row of the next one.

    Only doc_id boundaries and one id per bucket come to the driver; texts move in one shuffle.
    """
    spark = docs.sparkSession
    common.text_batches(spark)
    parts = common.shuffle_partitions(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_column().alias("text"))
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    docs = docs.withColumn("_key", key)
    splitters = common.range_splitters(docs.select("_key"), "_key", parts)
    docs = docs.withColumn("_bucket", common.bucket_of("_key", splitters))
    firsts = sorted((r["_bucket"], r["m"]) for r in docs.groupBy("_bucket").agg(F.min("_key").alias("m")).collect())
    guests = [(m, firsts[i - 1][0], 2 if i == 0 else 1) for i, (_, m) in enumerate(firsts)]
    heads = spark.createDataFrame(guests or [(0, 0, 1)], "_key long, _to int, _guest int")
    docs = docs.join(F.broadcast(heads), "_key", "left")
    own = F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("g"))
    other = F.struct(F.col("_to").alias("b"), F.col("_guest").alias("g"))
    places = F.when(F.col("_to").isNull(), F.array(own)).otherwise(F.array(own, other))
    docs = docs.select("doc_id", "text", "_key", F.explode(places).alias("p")).select("doc_id", "text", "_key", F.col("p.b").alias("_bucket"), F.col("p.g").alias("_guest"))
    return docs.withColumn("_slot", common.slot_of("_bucket", spark)).repartition(parts, "_slot").sortWithinPartitions("_bucket", "_guest", "_key", "text")


COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text (last quarter from the next document's start), and likenesses."""

    def rows(ids: list, texts: pa.Array, nexts: list[int]) -> pa.RecordBatch:
        """ids: of the rows to give; nexts: for each, the place of its next text."""
        strings = texts.to_pylist()
        n = [len(strings[i]) for i in range(len(ids))]
        edited = [s[: c - c // 4] + strings[j][: c // 4] for s, c, j in zip(strings, n, nexts)]
        sets = signature_sets(texts)
        changed = signature_sets(pa.array(edited, pa.string()))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array(n, pa.int64()),
                pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                pa.array([to_text(sets[i]) for i in range(len(ids))], pa.string()),
                pa.array([to_text(s) for s in changed], pa.string()),
                pa.array([jaccard(sets[i], c) for i, c in enumerate(changed)], pa.float64()),
                pa.array([jaccard(sets[i], sets[j]) for i, j in enumerate(nexts)], pa.float64()),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last row so far, whose next may be in the following slice
        for batch in common.by_bytes(batches, limit=2 << 20):
            batch = batch if held is None else pa.concat_batches([held, batch])
            held = batch.slice(batch.num_rows - 1)
            bucket, guest = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            # each bucket's rows come first, then its guests: the row after an own row is its next
            mine = [i for i in range(batch.num_rows - 1) if not guest[i]]
            if any(bucket[i] != bucket[i + 1] for i in mine):
                raise AssertionError("a bucket lacks the first row of the next one")
            if mine:
                ids = batch.column(0).to_pylist()
                places = pa.array(mine + [i + 1 for i in mine])
                yield rows([ids[i] for i in mine], batch.column(1).take(places), list(range(len(mine), 2 * len(mine)))) if len(mine) < batch.num_rows - 1 else rows(ids[:-1], batch.column(1), [i + 1 for i in mine])

    return with_next(docs).mapInArrow(run, COLUMNS)


def near_pairs(docs: DataFrame, *, least: float = 0.8) -> DataFrame:
    """Pairs (a, b, likeness) of documents with different fingerprints of likeness `least` or more, a < b.

    Equal sets are one entry, named by the smallest doc_id. Entries are partitioned by set length in steps of 1 / least,
    so a partner is in the same or the next class; within a class, only signatures that a set cannot do without
    (its first size - ceil(least * size) + 1, rarest first) index it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.by_bytes(batches):
            sets = signature_sets(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.astype(np.int64) for s in sets], pa.list_(pa.int64()))], names=["doc_id", "sigs"])

    sets = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_column().alias("text")).mapInArrow(run, "doc_id long, sigs array<long>")
    sets = common.materialise(sets.where("size(sigs) > 0").groupBy("sigs").agg(F.min("doc_id").alias("doc_id")), "sets")
    sets = sets.withColumn("n", F.size("sigs")).withColumn("class", F.floor(F.log("n") / -F.log(F.lit(least)) + 1e-9).cast("int"))
    often = sets.select(F.explode("sigs").alias("sig")).groupBy("sig").agg(F.count(F.lit(1)).alias("df"))
    ranked = sets.select("doc_id", "n", "class", F.explode("sigs").alias("sig")).join(often, "sig").groupBy("doc_id", "n", "class").agg(F.sort_array(F.collect_list(F.struct("df", "sig"))).alias("s"))
    need = (F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).cast("int")
    index = ranked.select("doc_id", "n", "class", F.explode(F.slice("s", F.lit(1), need)).alias("s")).select("doc_id", "n", "class", F.col("s.sig").alias("sig"))
    left = index.select(F.col("doc_id").alias("x"), F.col("n").alias("nx"), "sig", F.explode(F.array("class", F.col("class") + 1)).alias("class"))
    right = index.select(F.col("doc_id").alias("y"), F.col("n").alias("ny"), "sig", "class")
    fits = (F.col("x") != F.col("y")) & (F.col("nx") <= F.col("ny")) & (F.col("nx") >= F.col("ny") * least)
    pairs = left.join(right, ["sig", "class"]).where(fits).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    known = sets.select("doc_id", "sigs")
    both = pairs.join(known.select(F.col("doc_id").alias("a"), F.col("sigs").alias("sa")), "a").join(known.select(F.col("doc_id").alias("b"), F.col("sigs").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.select("a", "b", (shared / (F.size("sa") + F.size("sb") - shared)).alias("likeness")).where(F.col("likeness") >= least)


def op2_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
