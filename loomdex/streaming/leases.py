"""Lease timers over a log of job events: a running job that nothing is heard of goes back to the queue, or fails.

Each job is a key with its last status and attempts as state. A timer in event time is set to
the end of a running job's lease; events that come late, but not later than the watermark,
are put in their place. The result equals ``state.recover`` of the whole log at the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "status string, ts long, event_id long, attempts long"
OUT = "job_id long, status string, attempts long, at timestamp"


def lease_transitions(log: DataFrame, lease_seconds: int = 3600, most_attempts: int = 5, late: str = "2 hours") -> DataFrame:
    """``job_id, status, attempts, at`` whenever a job's events or its timer change it, of a stream (job_id, event_id, ts, status).

    The last row of a job, by ``at`` and attempts, is what it is now. A job's events of one
    batch, and its state, are all that a task holds of it.
    """

    def micros(x: pd.Series) -> pd.Series:
        return x.astype("datetime64[us]").astype("int64")

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, ts, event, attempts = state.get if state.exists else (None, -(1 << 62), -1, 0)
        if state.hasTimedOut:
            at = ts + lease_seconds * 1_000_000
            status = "failed" if attempts >= most_attempts else "queued"
        else:
            for f in frames:
                attempts += int((f["status"] == "running").sum())
                f = f.assign(us=micros(f["ts"])).sort_values(["us", "event_id"])
                last = f.iloc[-1]
                if (int(last["us"]), int(last["event_id"])) > (ts, event):
                    status, ts, event = last["status"], int(last["us"]), int(last["event_id"])
            at = ts
        state.update((status, ts, event, attempts))
        ends = (ts + lease_seconds * 1_000_000) // 1000 - 1  # a timer goes off once the watermark is beyond it
        if status == "running":
            state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "attempts": [attempts], "at": [pd.Timestamp(at, unit="us")]})

    rows = log.select("job_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "status").withWatermark("ts", late)
    return rows.groupBy("job_id").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
