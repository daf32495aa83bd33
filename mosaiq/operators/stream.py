"""Frames as a stream: the pairs of doubling and the segments, with each job's last frame held as state keyed by job."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

STATE = "job long, count long, last long"
PLACED = "job long, place long, frame long, ahead long, fresh boolean, closed boolean"


def placed(frames: DataFrame, state: DataFrame) -> DataFrame:
    """A batch's frames and each open job's last one: (job, place, frame, ahead, fresh, closed), ahead being the next of them.

    frames: (job long, frame long, done boolean); state: a row of `STATE` a job, its last frame and how many there were. A
    job's frames come in order, in any split; within a batch they are sorted. A frame that is not after the last is a repeat
    and gives nothing; a row that is done closes the job. Rows without a job are left out, a null frame only closes. Every
    open job has a row, so the next state is in the result. All of a job meets in one task, once, sorted by frame."""
    known = frames.where("job is not null").select("job", "frame", F.coalesce("done", F.lit(False)).alias("done"), F.lit(None).cast("long").alias("count"))
    rows = known.unionByName(state.select("job", F.col("last").alias("frame"), F.lit(False).alias("done"), "count")).repartition("job")
    rows = rows.groupBy("job", "frame").agg(F.max("done").alias("done"), F.max("count").alias("count"))
    whole, line = Window.partitionBy("job"), Window.partitionBy("job").orderBy("frame")
    last = F.max(F.when(F.col("count").isNotNull(), F.col("frame")))
    rows = rows.withColumns({"closed": F.max("done").over(whole), "_count": F.max("count").over(whole), "_last": last.over(whole)})
    rows = rows.where("frame is not null and (_last is null or frame >= _last)")
    place = F.coalesce(F.col("_count") - 1, F.lit(0)) + F.row_number().over(line) - 1
    return rows.select("job", place.cast("long").alias("place"), "frame", F.lead("frame").over(line).alias("ahead"), F.col("count").isNull().alias("fresh"), "closed")


def state_after(rows: DataFrame) -> DataFrame:
    """The state that a batch leaves: a row of `STATE` for each job that is not closed."""
    return rows.where("ahead is null and not closed").select("job", (F.col("place") + 1).alias("count"), F.col("frame").alias("last"))


def slots(rows: DataFrame, *, length: int = 30) -> DataFrame:
    """Delivered slots at twice the rate, with their segment of so many frames: (job, segment, slot, before, after).

    A frame is in the batch that brings it, the slot after it in the batch that brings the next one, or closes the job; the
    last frame is then paired with itself."""
    after = F.coalesce("ahead", F.when(F.col("closed"), F.col("frame")))
    slot = lambda odd, to: F.struct((2 * F.col("place") + odd).alias("slot"), to.alias("after"))
    both = F.array(F.when(F.col("fresh"), slot(0, F.col("frame"))), F.when(after.isNotNull(), slot(1, after)))
    each = rows.select("job", F.floor(F.col("place") / length).cast("int").alias("segment"), "frame", F.explode(F.filter(both, lambda x: x.isNotNull())).alias("s"))
    return each.select("job", "segment", "s.slot", F.col("frame").alias("before"), "s.after")


def started(frames: DataFrame, folder: str) -> StreamingQuery:
    """Run a stream of frames until nothing new is there; batch n is the table folder/placed/n, and holds the state for n + 1.

    A run goes on where the last one in this folder ended; a batch that is run again writes its own table again."""
    def advance(batch, n):
        spark = batch.sparkSession
        before = spark.read.schema(PLACED).parquet(f"{folder}/placed/{n - 1}") if n else spark.createDataFrame([], PLACED)
        placed(batch, state_after(before)).write.mode("overwrite").parquet(f"{folder}/placed/{n}")

    return frames.writeStream.foreachBatch(advance).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()


def doubled(spark, folder: str, *, length: int = 30) -> DataFrame:
    """The slots of all batches of that folder so far."""
    return slots(spark.read.schema(PLACED).parquet(f"{folder}/placed/*"), length=length)
