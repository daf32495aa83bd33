"""Sharding by balanced label propagation.

Documents with equal texts are one unit (in parts of one shard's rows each, where it has more). Units whose texts share an
anchor, one of ANCHORS minima over the hashes of their five-word shingles, are linked through a hub per anchor, so no pair
is ever listed. Units of more than an eighth of a shard start on the emptiest shard and stay; the others start on the shard
that their text hashes to. In every round each anchor gives a unit of votes, shared among the shards by the rows it has there;
a unit asks for the shard of most votes (the lowest, where several have), its own included, and in every other round only
for shards with room. A shard admits, picked by hash, as many rows as its quota has room for and as leave it in that round.
Rounds end early when none asks. A last levelling moves only the rows that a shard holds over its size, smallest groups
first, to the shards that are short, so counts differ by one at most.

Defined results: null text counts 0 bytes and equals the empty text; texts of fewer than five words have no anchors;
repeated rows are placed each; null doc_ids are placed like others; an empty table gives an empty result; other columns
are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.llm import common
from mosaiq.llm.words import clean_words, mix

SHARDS = 24
ROUNDS = 6
SLACK = 1.05
WORDS = 5
ANCHORS = 4
#: Units of more than this share of a shard are placed by size: at most HEAVY times as many as shards.
HEAVY = 8
_FACTORS = np.random.default_rng(7).integers(0, 1 << 63, ANCHORS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_K = np.uint64(0x9E3779B97F4A7C15)


def anchors(texts: pa.Array) -> pa.Array:
    """For each text the least of its shingle hashes under each of ANCHORS orders; none for fewer words than a shingle."""
    h, _, doc = clean_words(texts)
    n = max(0, len(doc) - WORDS + 1)
    at = np.flatnonzero(doc[:n] == doc[len(doc) - n :])
    s = np.zeros(len(at), np.uint64)
    for k in range(WORDS):
        s = (s ^ (s >> np.uint64(29))) * _K + h[at + k]
    s, owner = mix(s), doc[at]
    starts = np.flatnonzero(np.diff(owner, prepend=-1))
    least = np.stack([np.minimum.reduceat(s * f, starts) for f in _FACTORS], axis=1) if len(starts) else np.zeros((0, ANCHORS), np.uint64)
    size = np.zeros(len(texts), np.int32)
    size[owner[starts]] = ANCHORS
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(least.reshape(-1).view(np.int64)))


def _nodes(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, hub (the hash of the text) and anchors of each row; row tells repeated rows apart."""
    common.text_batches(docs.sparkSession)
    text = common.text_column()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.by_bytes(batches):
            columns = [batch.column(i) for i in (0, 2, 3, 4)] + [anchors(batch.column(1))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "size", "text_crc32", "hub", "anchors"])

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text.alias("text"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("hub"),
    ).mapInArrow(run, "doc_id long, size long, text_crc32 long, hub long, anchors array<long>")
    return common.materialise(rows.withColumn("row", F.monotonically_increasing_id()), "nodes")


def _heavy_homes(spark: SparkSession, heavy: DataFrame, target: float, shards: int) -> DataFrame:
    """The shard of each part of the heavy groups, largest first on the emptiest shard. At most HEAVY * shards rows."""
    loads = [0.0] * shards
    found = []
    for r in sorted(heavy.select("hub", "n").collect(), key=lambda r: (-r["n"], r["hub"])):
        parts = -int(-r["n"] // target)
        homes = []
        for _ in range(parts):
            homes.append(min(range(shards), key=lambda s: (loads[s], s)))
            loads[homes[-1]] += r["n"] / parts
        found.append((r["hub"], homes))
    return spark.createDataFrame(found, "hub long, homes array<int>")


#: Votes of one anchor, in all.
VOTES = 1000


def _admitted(wanted: dict[tuple[int, int], int], room: dict[int, int]) -> dict[int, float]:
    """For each shard the share of the rows asking for it that it can admit, given the rows (from, to) asking to move."""
    asks = {d: sum(n for (_, to), n in wanted.items() if to == d) for _, d in wanted}
    share = dict.fromkeys(asks, 1.0)
    for _ in range(50):
        leave = {d: sum(n * share[to] for (of, to), n in wanted.items() if of == d) for d in asks}
        share = {d: min(share[d], max(0.0, (room[d] + leave[d]) / n)) for d, n in asks.items()}
    return share


def _by_label(df: DataFrame, label: str) -> dict[int, int]:
    """Rows per shard: one number for each comes to the driver."""
    return {r["s"]: r["n"] for r in df.groupBy(F.col(label).alias("s")).agg(F.sum("n").alias("n")).collect()}


def propagate(linked: DataFrame, others: dict[int, int], *, quota: int, shards: int, rounds: int) -> DataFrame:
    """linked has hub, n (rows), homes (of one shard: those move) and anchors; others counts the rows of all else by shard."""
    spark = linked.sparkSession
    now = linked.withColumn("label", F.get("homes", F.lit(0)))
    for turn in range(rounds):
        mine = _by_label(now, "label")
        room = {s: quota - others.get(s, 0) - mine.get(s, 0) for s in range(shards)}
        free = [s for s, n in room.items() if n > 0 or turn % 2 == 0]
        links = now.select("hub", "label", F.explode("anchors").alias("anchor"), "n")
        votes = links.groupBy("anchor", "label").agg(F.sum("n").alias("n"))
        votes = votes.groupBy("anchor").agg(F.collect_list(F.struct("label", "n")).alias("votes"), F.sum("n").alias("all"))  # an entry per shard
        votes = votes.select("anchor", F.transform("votes", lambda v: F.struct(v["label"].alias("label"), (v["n"] * VOTES / F.col("all")).cast("long").alias("n"))).alias("votes"))
        movable = now.where("size(homes) = 1").withColumn("anchor", F.explode("anchors")).join(votes, "anchor")
        heard = F.flatten(F.collect_list("votes")).alias("heard")  # ANCHORS lists
        fixed = now.where("size(homes) > 1").withColumn("heard", F.lit(None).cast("array<struct<label:int,n:bigint>>"))
        asked = movable.groupBy("hub").agg(*[F.first(c).alias(c) for c in now.columns if c != "hub"], heard).unionByName(fixed)
        may = F.array_distinct(F.transform("heard", lambda v: v["label"]))
        may = F.filter(may, lambda s: (s == F.col("label")) | (s.isin(free) if free else F.lit(False)))
        sums = lambda s: F.aggregate(F.filter("heard", lambda v: v["label"] == s), F.lit(0).cast("long"), lambda acc, v: acc + v["n"])
        best = F.array_max(F.transform(may, lambda s: F.struct(sums(s).alias("n"), (-s).alias("minus"))))
        asked = common.materialise(asked.withColumn("wish", F.coalesce(-best["minus"], "label")).drop("heard"), "wishes")
        flows = asked.where("wish <> label").groupBy("label", "wish").agg(F.sum("n").alias("n"))
        wanted = {(r["label"], r["wish"]): r["n"] for r in flows.collect()}  # a row per pair of shards
        if not wanted:
            if turn % 2 == 0:
                break
            continue
        doors = spark.createDataFrame(sorted(_admitted(wanted, room).items()), "wish int, share double")
        luck = F.pmod(F.xxhash64("hub", F.lit(turn)), F.lit(1 << 20)) / float(1 << 20)
        let = (F.col("wish") != F.col("label")) & (luck < F.col("share"))
        now = asked.join(F.broadcast(doors), "wish", "left").withColumn("label", F.when(let, F.col("wish")).otherwise(F.col("label"))).select(now.columns)
    return now


def labelled(nodes: DataFrame, *, shards: int = SHARDS, rounds: int = ROUNDS, slack: float = SLACK) -> DataFrame:
    """nodes with `label`, the shard after propagation, and n, the rows of their text."""
    spark = nodes.sparkSession
    groups = common.materialise(nodes.groupBy("hub").agg(F.count(F.lit(1)).alias("n"), F.first("anchors").alias("anchors")), "groups")
    rows = groups.agg(F.sum("n")).head()[0] or 0
    target = max(1.0, rows / shards)
    first = F.pmod(F.col("hub"), F.lit(shards)).cast("int")
    heavy = _heavy_homes(spark, groups.where(F.col("n") > F.lit(max(1.0, target / HEAVY))), target, shards)
    shared = groups.select("hub", F.explode("anchors").alias("anchor"))
    held = shared.groupBy("anchor").agg(F.min("hub").alias("a"), F.max("hub").alias("b")).where("a <> b").select("anchor")
    held = shared.join(held, "anchor").groupBy("hub").agg(F.collect_list("anchor").alias("anchors"))  # ANCHORS at most
    units = groups.drop("anchors").join(F.broadcast(heavy), "hub", "left").join(held, "hub", "left")
    units = common.materialise(units.withColumn("homes", F.coalesce("homes", F.array(first))), "units")
    others = _by_label(units.where("anchors is null").select(F.explode("homes").alias("label"), (F.col("n") / F.size("homes")).cast("long").alias("n")), "label")
    linked = units.where("anchors is not null")
    for s, n in _by_label(linked.select(F.explode(F.slice("homes", 2, shards)).alias("label"), (F.col("n") / F.size("homes")).cast("long").alias("n")), "label").items():
        others[s] = others.get(s, 0) + n
    parts = linked.withColumn("n", F.ceil(F.col("n") / F.size("homes")))
    settled = propagate(parts, others, quota=int(target * slack) + 1, shards=shards, rounds=rounds).select("hub", "label")
    known = units.join(settled, "hub", "left")
    known = known.select("hub", "n", F.when(F.size("homes") > 1, F.col("homes")).otherwise(F.array(F.coalesce("label", F.get("homes", F.lit(0))))).alias("homes"))
    known = common.materialise(known.where((F.col("n") > 1) | (F.get("homes", F.lit(0)) != first)), "known")
    # groups of more rows than this number at most 4 * partitions and are broadcast; the others are small enough to shuffle
    large = F.col("n") > max(1, rows // (4 * common.shuffle_partitions(spark)))
    hot = F.broadcast(known.where(large))
    near = nodes.join(hot, "hub")
    far = nodes.join(hot.select("hub"), "hub", "left_anti").join(known.where(~large), "hub", "left")
    part = F.pmod(F.xxhash64(F.coalesce("doc_id", "row")), F.size("homes")).cast("int")
    return near.unionByName(far).withColumns({"n": F.coalesce("n", F.lit(1)), "label": F.coalesce(F.get("homes", part), first)}).drop("homes", "anchors")


def level(nodes: DataFrame, shards: int) -> DataFrame:
    """nodes with shard and slot: each shard keeps its rows up to its size, large groups first; only the surplus moves."""
    ranked, total = common.global_rank(nodes.withColumn("_small", -F.col("n")), ["label", "_small", "hub", "doc_id", "row"], "ranked")
    counted = {r["label"]: r["count"] for r in ranked.groupBy("label").count().collect()}  # a row per shard
    held = [counted.get(s, 0) for s in range(shards)]
    least, more = divmod(total, shards)
    fullest = set(sorted(range(shards), key=lambda s: (-held[s], s))[:more])
    size = [least + (s in fullest) for s in range(shards)]
    start = np.append(0, np.cumsum(held))[:-1].tolist()
    surplus = np.append(0, np.cumsum([max(0, h - z) for h, z in zip(held, size)]))[:-1].tolist()
    short = [s for s in range(shards) if held[s] < size[s]] or [0]
    gaps = np.append(0, np.cumsum([max(0, size[s] - held[s]) for s in short]))[:-1].tolist()
    of = lambda values, place: F.get(F.array(*[F.lit(int(v)) for v in values]), place)
    ranked = ranked.withColumn("_at", F.col("rank") - of(start, F.col("label")))
    ranked = ranked.withColumn("_over", F.col("_at") - of(size, F.col("label"))).withColumn("_moved", F.col("_over") + of(surplus, F.col("label")))
    gap = common.bucket_of("_moved", gaps[1:]).cast("int")
    stays = F.col("_over") < 0
    return ranked.withColumns(
        {
            "shard": F.when(stays, F.col("label")).otherwise(of(short, gap)).cast("int"),
            "slot": F.when(stays, F.col("_at")).otherwise(of([held[s] for s in short], gap) + F.col("_moved") - of(gaps, gap)).cast("long"),
        }
    )


def shard(docs: DataFrame, *, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    placed = level(labelled(_nodes(docs), shards=shards, rounds=rounds), shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
