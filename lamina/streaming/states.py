"""Job state as a stateful stream: a state for each job that is under way, and a timer that ends finished ones."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lamina.streaming.jobs import FIELDS

#: The states that end a job.
ENDED = ("done", "error")
KINDS = {"status": "string", "progress": "long", "phase": "string", "message": "string"}
ROW = "job_id long, " + ", ".join(f"{f} {KINDS[f]}" for f in FIELDS) + ", updated_at timestamp, events long"
#: Each field with the number of the event that set it.
STATE = ", ".join(f"{f} {KINDS[f]}, {f}_seq long" for f in FIELDS) + ", updated_at timestamp, events long"


class Tracked(StatefulProcessor):
    """Holds the last value of each field, by seq. An ended job's state goes when no event has come for so long."""

    def __init__(self, linger_ms: int):
        self.linger_ms = linger_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("job", STATE)

    def ends_at(self, updated_at: pd.Timestamp) -> int:
        return int(updated_at.timestamp() * 1000) + self.linger_ms

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        known = list(self.held.get()) if self.held.exists() else [None] * (2 * len(FIELDS)) + [None, 0]
        for batch in rows:
            for event in batch.to_dict("records"):
                for i, f in enumerate(FIELDS):
                    if not pd.isna(event[f]) and (known[2 * i + 1] is None or event["seq"] >= known[2 * i + 1]):
                        known[2 * i : 2 * i + 2] = [int(event[f]) if KINDS[f] == "long" else event[f], int(event["seq"])]
                ts = pd.Timestamp(event["ts"])
                known[-2] = ts if known[-2] is None else max(ts, pd.Timestamp(known[-2]))
                known[-1] += 1
        known[-2] = known[-2].to_pydatetime()
        self.held.update(tuple(known))
        if known[0] in ENDED:
            self.handle.registerTimer(self.ends_at(pd.Timestamp(known[-2])))
        values = {"job_id": key[0]} | {f: known[2 * i] for i, f in enumerate(FIELDS)} | {"updated_at": known[-2], "events": known[-1]}
        frame = pd.DataFrame([values])
        yield frame.astype({f: "Int64" for f in FIELDS if KINDS[f] == "long"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        if self.held.exists():
            known = self.held.get()
            if known[0] in ENDED and self.ends_at(pd.Timestamp(known[-2])) <= expiredTimerInfo.getExpiryTimeInMs():
                self.held.clear()  # no event has come since, and the job hasn't been taken up again
        return iter(())

    def close(self) -> None:
        pass


def tracked(events: DataFrame, late: str = "10 minutes", linger_ms: int = 3_600_000) -> DataFrame:
    """job_id, fields, updated_at, events: the new state of each job that events change, as a stream in update mode.

    Fields as jobs.current() gives them. An event may come so late; a later one is dropped. The state of a job that is
    done or has failed is held for so many milliseconds of event time after its last event, so that what is held grows
    with the jobs under way, not with all jobs; an event that comes after that begins the job anew. The session's state
    store must be one that transformWithState takes: see STORE.
    """
    rows = events.select("job_id", "seq", "ts", *FIELDS).withColumn("progress", F.col("progress").cast("long")).withWatermark("ts", late)
    return rows.groupBy("job_id").transformWithStateInPandas(Tracked(linger_ms), ROW, "Update", "eventTime")


#: Settings of a session that runs tracked().
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
