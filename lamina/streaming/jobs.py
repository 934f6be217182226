"""Job state: events set some of a job's fields, the last value of each field holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIELDS = ["status", "progress", "phase", "message"]


def current(events: DataFrame) -> DataFrame:
    """job_id, fields, updated_at, events: each field's last value that isn't null. Works on batches, and on streams in complete or update mode."""
    last = [F.max_by(F.when(F.col(f).isNotNull(), F.col(f)), F.when(F.col(f).isNotNull(), F.col("seq"))).alias(f) for f in FIELDS]
    return events.groupBy("job_id").agg(*last, F.max("ts").alias("updated_at"), F.count("*").alias("events"))


def download_status(status: Column) -> Column:
    """HTTP status of a download: unknown job, not done yet, or ready."""
    return F.when(status.isNull(), 404).when(status == "done", 200).otherwise(409)


def progress(steps: DataFrame, key: str, order: str) -> DataFrame:
    """start_progress and end_progress of each step of a job, from 20 to 62 per cent, rounded half to even."""
    w = Window.partitionBy(key)
    k, n = F.row_number().over(w.orderBy(order)), F.count("*").over(w)
    at = lambda i: F.lit(20) + F.bround(i / n * 42).cast("long")
    return steps.withColumn("start_progress", at(k - 1)).withColumn("end_progress", at(k))


def follow(events: DataFrame, path: str, checkpoint: str):  # noqa: ANN201
    """A running query that writes the new state of each job that events change to a table of states, for one run over what is there.

    The state of a job is its row with the most events: see latest(). Only the jobs of a batch are written.
    """

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("append").parquet(path)

    return current(events).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(store).trigger(availableNow=True).start()


def latest(states: DataFrame) -> DataFrame:
    """The last row of each job in a table that follow() wrote."""
    columns = [c for c in states.columns if c != "job_id"]
    return states.groupBy("job_id").agg(F.max_by(F.struct(*columns), "events").alias("s")).select("job_id", "s.*")
