"""Queue, outbox and health: mutable state as folds over logs."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


def backoff_seconds(attempts: Column) -> Column:
    """min(300, 2 ** min(n, 8))."""
    return F.least(F.lit(300), F.pow(F.lit(2.0), F.least(attempts, F.lit(8))).cast("int")).cast("long")


def job_states(log: DataFrame) -> DataFrame:
    """Each job's last status (by time, then event id), its first time and its number of attempts."""
    return log.groupBy("job_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"), F.count_if(F.col("status") == "running").alias("attempts"))


def claimable(jobs: DataFrame, now: Column, most_attempts: int = 5) -> DataFrame:
    """Jobs that may be claimed: queued and due, or running with an expired lease; attempts left."""
    due = (F.col("status") == "queued") & (F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= now))
    lost = (F.col("status") == "running") & (F.col("lease_expires_at") <= now)
    return jobs.where((due | lost) & (F.col("attempts") < most_attempts))


def claim_order(jobs: DataFrame) -> DataFrame:
    return jobs.orderBy(F.desc("priority"), F.asc_nulls_first("next_attempt_at"), "created_at", "job_id")


def run_once(jobs: DataFrame, now: datetime, handlers: dict[str, Callable[[Row], None]], worker: str, lease_seconds: int = 60, most_attempts: int = 5) -> list[Row]:
    """Claim the first job that is due and run its kind's handler; the new log rows (job_id, status, ...), none if nothing is due.

    A handler that raises sends the job back with its backoff, or fails it for good once its
    attempts are used up; so does a kind without a handler. One job is claimed at a time: the
    handlers are Spark jobs themselves, and the log is what other workers see.
    """
    due = claim_order(claimable(jobs, F.lit(now), most_attempts)).limit(1).collect()
    if not due:
        return []
    job = due[0]
    attempt = job.attempts + 1
    at = {"job_id": job.job_id, "worker": worker, "attempts": attempt}
    out = [Row(**at, status="running", next_attempt_at=None, lease_expires_at=now + timedelta(seconds=lease_seconds), error=None)]
    try:
        handlers[job.kind](job)
    except Exception as e:  # a job's failure is its own
        gone = attempt >= most_attempts
        later = None if gone else now + timedelta(seconds=min(300, 2 ** min(attempt, 8)))
        return [*out, Row(**at, status="failed" if gone else "queued", next_attempt_at=later, lease_expires_at=None, error=type(e).__name__)]
    return [*out, Row(**at, status="succeeded", next_attempt_at=None, lease_expires_at=None, error=None)]


def heartbeat(jobs: DataFrame, worker: str, now: Column, lease_seconds: int = 60) -> DataFrame:
    """Jobs with the leases of a worker's running ones moved on."""
    mine = (F.col("status") == "running") & (F.col("worker") == worker)
    return jobs.withColumn("lease_expires_at", F.when(mine, now + F.make_interval(secs=F.lit(lease_seconds))).otherwise(F.col("lease_expires_at")))


def cancel(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """Jobs after some (job_id) are cancelled: only those that haven't ended."""
    asked = ids.select("job_id").distinct().withColumn("_asked", F.lit(True))
    ended = F.col("status").isin("succeeded", "failed", "cancelled")
    return jobs.join(asked, "job_id", "left").withColumn("status", F.when(F.col("_asked") & ~ended, "cancelled").otherwise(F.col("status"))).drop("_asked")


def recover(jobs: DataFrame, now: Column, most_attempts: int = 5) -> DataFrame:
    """Running jobs whose lease is over go back to the queue, or fail for good once attempts are used up."""
    lost = (F.col("status") == "running") & (F.col("lease_expires_at") <= now)
    status = F.when(lost & (F.col("attempts") >= most_attempts), "failed").when(lost, "queued").otherwise(F.col("status"))
    return jobs.withColumn("status", status)


def outbox_diff(current: DataFrame, projected: DataFrame, enqueued: DataFrame, profile: str, rebuild: str | None = None) -> DataFrame:
    """Operations (chunk_id, op, generation, idempotency_key) that bring a projection to the current chunks.

    Current chunks (chunk_id, generation) are upserted in their generation, projected ones
    (chunk_id, generation, status) that aren't current deleted in the next. A key that is
    ``enqueued`` (idempotency_key) already isn't again; a rebuild's token makes keys of its own.
    """
    new = current.select("chunk_id", F.lit("upsert").alias("op"), "generation")
    stale = projected.where("status <> 'deleted'").join(current.select("chunk_id"), "chunk_id", "left_anti").select("chunk_id", F.lit("delete").alias("op"), (F.col("generation") + 1).alias("generation"))
    suffix = F.when(F.col("op") == "upsert", f":rebuild:{rebuild}").otherwise("") if rebuild else F.lit("")
    key = F.concat(F.lit("qdrant:chunk:"), F.col("chunk_id"), F.lit(":"), F.col("generation").cast("string"), F.lit(":"), F.col("op"), F.lit(f":{profile}"), suffix)
    return new.unionByName(stale).withColumn("idempotency_key", key).join(enqueued.select("idempotency_key"), "idempotency_key", "left_anti").select("chunk_id", "op", "generation", "idempotency_key")


def readiness(components: DataFrame) -> DataFrame:
    """One row: a required component down is not_ready, an optional one degraded."""
    down = ~F.col("healthy")
    return components.agg(F.when(F.coalesce(F.bool_or(down & F.col("required")), F.lit(False)), "not_ready").when(F.coalesce(F.bool_or(down), F.lit(False)), "degraded").otherwise("ready").alias("status"))
