"""A stream's slots against a plain version, batch by batch."""

from mosaiq.operators import stream

BATCHES = [
    [(1, 5, False), (1, 3, False), (1, 5, None), (2, 7, False), (None, 1, False), (3, None, True), (4, None, False), (6, 1, False), (6, 2, True)],
    [(1, 4, False), (1, 5, False), (1, 9, False), (2, None, True), (5, 1, False), (5, 2, True)],
    [(1, 10, False), (1, 12, False), (2, 1, False), (6, 2, False), (6, 4, False)],
    [],
    [(1, None, True), (4, None, True), (2, 1, True), (6, None, True)],
]


def _plain(batches, length):
    found, state = [], {}
    for rows in batches:
        for job in {r[0] for r in rows} - {None}:
            count, last = state.get(job, (0, None))
            for frame in sorted({f for j, f, _ in rows if j == job and f is not None}):
                if last is None or frame > last:
                    if last is not None:
                        found.append((job, (count - 1) // length, 2 * count - 1, last, frame))
                    found.append((job, count // length, 2 * count, frame, frame))
                    count, last = count + 1, frame
            state[job] = (count, last)
            if any(d for j, _, d in rows if j == job):
                if last is not None:
                    found.append((job, (count - 1) // length, 2 * count - 1, last, last))
                del state[job]
    return sorted(found)


def test_slots_batch_by_batch(spark):
    """Repeats, late frames, jobs that are closed, opened again, or have no frame."""
    state, got = spark.createDataFrame([], stream.STATE), []
    for rows in BATCHES:
        done = stream.placed(spark.createDataFrame(rows, "job long, frame long, done boolean"), state)
        got += [tuple(r) for r in stream.slots(done, length=2).collect()]
        state = spark.createDataFrame(stream.state_after(done).collect(), stream.STATE)
    assert sorted(got) == _plain(BATCHES, 2) and state.count() == 0


def test_runs_go_on_where_the_last_ended_and_call_no_python_a_job(spark, tmp_path):
    """A Python call a job and batch did not end in 170 s on 900,000 orders (F15)."""
    for rows in BATCHES:
        spark.createDataFrame(rows, "job long, frame long, done boolean").write.mode("append").parquet(str(tmp_path / "in"))
        stream.started(spark.readStream.schema("job long, frame long, done boolean").parquet(str(tmp_path / "in")), str(tmp_path)).awaitTermination()
    assert sorted(map(tuple, stream.doubled(spark, str(tmp_path), length=2).collect())) == _plain(BATCHES, 2)
    plan = stream.placed(spark.createDataFrame(BATCHES[0], "job long, frame long, done boolean"), spark.range(0).selectExpr("id job", "id count", "id last"))._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Python" not in plan.replace("PythonRDD", "") and plan.count("hashpartitioning(") == 1
