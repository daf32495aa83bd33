"""Slices of documents count the columns that they carry, so that a worker's and an executor's memory hold for texts too."""

import pyarrow as pa

from mosaiq.llm import common, ngram_quality


def test_carried_texts_count(spark, monkeypatch):
    """Only the words' texts counted: a slice with the texts carried beside took three times its size, and 3014 MB of an executor."""
    monkeypatch.setattr(ngram_quality, "SLICE", 60_000)
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, "5")
    try:
        docs = spark.createDataFrame([(i, f"{i:04d} " * 200) for i in range(200)], "doc_id long, text string").coalesce(1).withColumn("_mq_text", ngram_quality.F.col("text"))
        held = [[pa.ipc.open_stream(r["rows"]).read_all() for r in ngram_quality.slices(docs, names).collect()] for names in (["doc_id"], ["doc_id", "text"])]
    finally:
        spark.conf.set(batch, before)
    for tables in held:
        assert sorted(i for t in tables for i in t["doc_id"].to_pylist()) == list(range(200))
    assert max(t.num_rows for t in held[0]) == 60  # a slice ends with the five rows in which it reaches its size
    assert max(t.num_rows for t in held[1]) <= 25


def test_buckets_outlive_their_catalogue_entry(spark):
    """A query called alone left its tables in the session's catalogue, where the pipeline's test found them."""
    rows = common.materialise_by(spark.range(1000).withColumn("v", ngram_quality.F.col("id") * 2), "id", "rows")
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("mosaiq_")]
    other = spark.range(10).join(rows, "id").hint("merge")
    assert rows.count() == 1000 and {(r.id, r.v) for r in other.collect()} == {(i, 2 * i) for i in range(10)}
    plan = rows.groupBy("id").count()._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "Exchange" not in plan
