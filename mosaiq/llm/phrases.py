"""Phrases by Apriori: levels of frequent word runs, each level counting only runs whose two overlapping parts are frequent.

Texts are lower-cased (A-Z), split at PIECE_ENDS into pieces and those into words at spaces and tabs; everything is counted
per language. Level 1 counts words. For level k the frequent runs of k - 1 words go to all tasks as `Filter`, a bit table
of at most FILTER_BYTES however many there are (so a broadcast of proven size): it lets every frequent run through and few
others, and those few fail the count that follows. A task counts the runs of a slice of texts before the shuffle, which
keys on the run itself, so counts are exact and a hot run is a few rows. Scores are joined from the level tables; parts
that make up more than 1 in HOT of all words number fewer than HOT a level and are broadcast, all others are shuffled.

Defined results: null languages are `und`, null texts empty; rows of equal doc_id count each; a language without candidates
has no rows; an empty table gives an empty result. Other columns are not read. Counts are exact up to 10^14.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mosaiq.llm import common
from mosaiq.llm.words import mix, string_hashes

LEAST, LONGEST, COVERED, SCALE, FIRST = 10, 3, 50, 1_000_000, 2000
PIECE_ENDS = r"[.,;:!?\x0A-\x0D]+"
#: Bytes of a level's bit table at most, bits for a run, and positions set for each.
FILTER_BYTES, BITS_EACH, PLACES = 1 << 25, 16, 3
#: Parts with more than one in so many of all words are joined by broadcast.
HOT = 5000
#: Bytes of text counted together.
SLICE = 4 << 20
#: Rows of runs that leave for the JVM together.
SENT = 1 << 15
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Filter:
    """Runs that may be frequent, by hash: a bit table of a power of two of bits."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def size(runs: int) -> int:
        return min(FILTER_BYTES, max(1024, 1 << int(runs * BITS_EACH // 8).bit_length()))

    @staticmethod
    def places(hashes: np.ndarray, size: int) -> list[np.ndarray]:
        return [mix(hashes + np.uint64((i + 1) * int(_STEP) & (1 << 64) - 1)) & np.uint64(8 * size - 1) for i in range(PLACES)]

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for at in self.places(hashes, len(self.bits)):
            found &= (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0
        return found


def _joined(hashes: list[np.ndarray], lang: np.ndarray) -> np.ndarray:
    """Hash of a run of words in a language, from the words' hashes."""
    out = mix(lang + _STEP)
    for h in hashes:
        out = mix(out * _STEP + h)
    return out


def _filter(runs: DataFrame, n: int) -> Filter:
    """The bit table of the frequent runs (lang, phrase). Positions are gathered by 1024 ranges of the table, so a row that
    comes to the driver is a range's bytes, and all of them are the table."""
    size = Filter.size(n)
    share = max(1, size // 1024)

    def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lists = pc.split_pattern(batch.column(1), " ")
                words = string_hashes(lists.flatten()).reshape(batch.num_rows, -1)
                hashes = _joined(list(words.T), string_hashes(batch.column(0)))
                at = np.unique(np.concatenate(Filter.places(hashes, size)))
                yield pa.record_batch([pa.array((at >> np.uint64(3)).astype(np.int64) // share), pa.array(at.astype(np.int64))], ["part", "at"])

    def table(key, spots):
        bits = np.zeros(share, np.uint8)
        part = key[0].as_py()
        at = spots.column("at").to_numpy() - part * share * 8
        np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        return pa.table({"part": [part], "bits": [bits.tobytes()]})

    found = runs.select("lang", "phrase").mapInArrow(spots, "part long, at long").distinct()
    found = found.groupBy("part").applyInArrow(table, "part long, bits binary")
    bits = np.zeros(size, np.uint8)
    for row in found.toLocalIterator():
        bits[row["part"] * share : (row["part"] + 1) * share] = np.frombuffer(row["bits"], np.uint8)
    return Filter(bits)


def _slice_runs(langs: pa.Array, texts: pa.Array, k: int, known: Filter | None) -> pa.RecordBatch:
    """(lang, phrase, f): the runs of k words of these texts, counted, whose two parts of k - 1 words may be frequent."""
    plain = pc.replace_substring(pc.ascii_lower(texts), "\t", " ")
    lists = pc.split_pattern(pc.replace_substring_regex(plain, PIECE_ENDS, " \n "), " ")
    doc = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    coded = pc.dictionary_encode(lists.flatten())
    words, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    blank, ends = pc.equal(words, "").to_numpy(zero_copy_only=False), pc.equal(words, "\n").to_numpy(zero_copy_only=False)
    real = ~blank[codes] if len(codes) else np.zeros(0, bool)
    codes, doc = codes[real], doc[real]
    tongues = pc.dictionary_encode(langs)
    lang = tongues.indices.to_numpy(zero_copy_only=False).astype(np.int64)[doc]
    n = max(0, len(codes) - k + 1)
    inside = ~ends[codes] if len(codes) else np.zeros(0, bool)
    good = (doc[:n] == doc[k - 1 :][:n]) & reduce(np.logical_and, [inside[i : i + n] for i in range(k)])
    at = np.flatnonzero(good)
    if known is not None and len(at):
        own, tongue = string_hashes(words), string_hashes(tongues.dictionary)
        part = lambda a: _joined([own[codes[a + i]] for i in range(k - 1)], tongue[lang[a]])
        at = at[known.holds(part(at))]
        at = at[known.holds(part(at + 1))]
    # runs as numbers: words and languages of the slice, or, where those do not fit 63 bits, ranks of the run so far
    number, wide = lang[at], len(tongues.dictionary)
    for i in range(k):
        if wide * len(words) >= 1 << 62:
            number = np.unique(number, return_inverse=True)[1]
            wide = int(number.max(initial=0)) + 1
        number, wide = number * len(words) + codes[at + i], wide * len(words)
    _, first, f = np.unique(number, return_index=True, return_counts=True)
    at = at[first]
    phrase = pc.binary_join_element_wise(*[words.take(pa.array(codes[at + i])) for i in range(k)], " ")
    return pa.record_batch([tongues.dictionary.take(pa.array(lang[at])), phrase, pa.array(f.astype(np.int64))], ["lang", "phrase", "f"])


def runs(docs: DataFrame, k: int, known: Filter | None = None) -> DataFrame:
    """(lang, phrase, f) of all runs of k words that `known` lets through."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            if held:
                whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
                found = _slice_runs(whole.column(0), whole.column(1), k, known)
                yield from (found.slice(a, SENT) for a in range(0, found.num_rows, SENT))

        for part in common.by_bytes(batches, limit=SLICE):
            if size and size + part.nbytes > SLICE:
                yield from done()
            held.append(part)
            size += part.nbytes
        yield from done()

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), common.text_column().alias("text"))
    found = rows.mapInArrow(count, "lang string, phrase string, f long")
    return found.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def with_count(rows: DataFrame, part, table: DataFrame, name: str, limit: int) -> DataFrame:
    """rows with the count, as `name`, of the run that `part` says; the counts above `limit` come by broadcast."""
    rows = rows.withColumn("_part", part)
    hot = table.where(F.col("f") > limit).select("lang", F.col("phrase").alias("_part"), F.col("f").alias("_hot"))
    marked = rows.join(F.broadcast(hot), ["lang", "_part"], "left")
    warm = marked.where("_hot is not null").withColumn(name, F.col("_hot")).drop("_hot", "_part")
    cold = table.where(F.col("f") <= limit).select("lang", F.col("phrase").alias("_part"), F.col("f").alias(name))
    return warm.unionByName(marked.where("_hot is null").drop("_hot").join(cold, ["lang", "_part"]).drop("_part"))


def _words(phrase: str, start: int, stop: int):
    return F.array_join(F.slice(F.split(F.col(phrase), " "), start + 1, stop - start), " ")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, covered: int = COVERED, first: int = FIRST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the best phrases of 2 to `longest` words of each language."""
    words = common.materialise(runs(docs, 1), "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    levels = {1: common.materialise(words.where(F.col("f") >= least), "level1")}
    sums = totals.agg(F.sum("n")).head()[0] or 0
    limit = sums // HOT
    for k in range(2, longest + 1):
        below = levels[k - 1]
        levels[k] = common.materialise(runs(docs, k, _filter(below, below.count())).where(F.col("f") >= least), f"level{k}")
    scored = []
    for k in range(2, longest + 1):
        # a run is dropped if a longer candidate that holds it has at least `covered` % of its count: the largest decides
        rows = levels[k].select("lang", "phrase", F.col("f").alias("a"))
        inside = [
            levels[j].select("lang", _words("phrase", i, i + k).alias("phrase"), F.col("f").alias("longer"))
            for j in range(k + 1, longest + 1)
            for i in range(j - k + 1)
        ]
        if inside:
            most = reduce(DataFrame.unionByName, inside).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
            held = rows.join(most, ["lang", "phrase"], "left")
            rows = held.where(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a"))).drop("longer")
        for cut in range(1, k):
            rows = with_count(rows, _words("phrase", 0, cut), levels[cut], f"l{cut}", limit)
            rows = with_count(rows, _words("phrase", cut, k), levels[k - cut], f"r{cut}", limit)
        cuts = [
            F.struct(
                F.expr(f"(cast(a as decimal(14,0)) * cast(a as decimal(14,0)) * cast({SCALE} as decimal(7,0))) div (cast(l{c} as decimal(14,0)) * cast(r{c} as decimal(14,0)))").alias("score"),
                F.lit(c).alias("k"), F.col(f"l{c}").alias("l"), F.col(f"r{c}").alias("r"),
            )
            for c in range(1, k)
        ]
        lowest = F.least(*cuts) if len(cuts) > 1 else cuts[0]
        scored.append(rows.withColumn("c", lowest).select("lang", "phrase", "a", "c.l", "c.r", "c.score"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    share = F.pmod(F.xxhash64("phrase"), F.lit(32))
    top = reduce(DataFrame.unionByName, scored).withColumn("share", share)
    top = top.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= first)
    top = top.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= first)
    counted = top.join(totals, "lang")
    return counted.select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", F.col("score").cast("long"))


def op12_apriori_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.text_batches(spark)
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH pieces AS (
  SELECT doc_id, lang, unnest(range(len(p))) AS piece, unnest(p) AS piece_text FROM (
    SELECT doc_id, coalesce(lang, 'und') AS lang, string_split_regex(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS p FROM documents)),
runs AS (SELECT lang, list_filter(string_split_regex(piece_text, '[ \t]+'), lambda w: w <> '') AS w FROM pieces),
spans AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM runs, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k),
counts AS MATERIALIZED (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS f FROM spans GROUP BY ALL),
totals AS (SELECT lang, sum(f) AS n FROM counts WHERE k = 1 GROUP BY lang),
held AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE k > 1 AND f >= 10),
kept AS (SELECT * FROM held h WHERE NOT EXISTS (
  SELECT 1 FROM held t WHERE t.lang = h.lang AND t.k = 3 AND h.k = 2 AND 100 * t.f >= 50 * h.f
    AND (h.w = t.w[1:2] OR h.w = t.w[2:3]))),
cuts AS (SELECT kept.lang, kept.phrase, kept.f AS a, cut, x.f AS l, y.f AS r,
    (1000000::HUGEINT * kept.f * kept.f) // (x.f::HUGEINT * y.f) AS score
  FROM kept, (SELECT unnest([1, 2]) AS cut), counts x, counts y
  WHERE cut < kept.k AND x.lang = kept.lang AND y.lang = kept.lang
    AND x.phrase = array_to_string(kept.w[1:cut], ' ') AND y.phrase = array_to_string(kept.w[cut + 1 :], ' ')),
best AS (SELECT lang, phrase, a, arg_min(l, (score, cut)) AS l, arg_min(r, (score, cut)) AS r, min(score) AS score FROM cuts GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
