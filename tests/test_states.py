import datetime as dt

from lamina.streaming import jobs, states

START = dt.datetime(2024, 1, 1)
KIND = "job_id long, seq long, ts timestamp, status string, progress long, phase string, message string"


def test_states_of_finished_jobs_go_and_late_events_count(spark, tmp_path):
    def event(job, seq, minute, status=None, progress=None, phase=None, message=None):
        return (job, seq, START + dt.timedelta(minutes=minute), status, progress, phase, message)

    batches = [
        [event(j, 10, 0, "running", 5, "cut") for j in range(6)] + [event(0, 12, 2, "done", 100)],
        [event(1, 11, 1, None, 7), event(0, 11, 1, None, 50, "late", "said late"), event(1, 12, 30, "error", None, None, "broken")],  # job 0's event comes late: only what is unset counts
        [event(9, 1, 200, "running", 1)],  # time goes on
        [event(9, 2, 201, None, 2)],  # and the timers of jobs 0 and 1 have run out
    ]
    for name, value in states.STORE.items():
        spark.conf.set(name, value)
    held, written = [], []
    try:
        source = tmp_path / "in"
        stream = None
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(str(source))
            stream = spark.readStream.schema(KIND).parquet(str(source))
            q = states.tracked(stream, "10 minutes", 60 * 60_000).writeStream.outputMode("update").foreachBatch(lambda b, _: written.extend(b.collect())).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
            q.awaitTermination(120)
            held.append([p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]][-1])
    finally:
        for name in states.STORE:
            spark.conf.unset(name)
    last = {r["job_id"]: r for r in written}
    assert (last[0]["status"], last[0]["progress"], last[0]["phase"], last[0]["message"], last[0]["events"]) == ("done", 100, "late", "said late", 3)
    assert (last[1]["status"], last[1]["progress"], last[1]["message"]) == ("error", 7, "broken")
    expected = {r["job_id"]: r for r in jobs.current(spark.createDataFrame([e for b in batches for e in b], KIND)).collect()}
    for job, row in last.items():
        assert all(row[c] == expected[job][c] for c in (*jobs.FIELDS, "updated_at", "events")), job
    assert held[-1] < max(held)
