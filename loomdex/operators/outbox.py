"""The outbox of a projection as rows: a batch is claimed with a lease, and marked done or failed.

Each function returns the outbox (id, status, operation, generation, chunk_id, attempts,
max_attempts, next_attempt_at, lease_owner, lease_expires_at, created_at, error) after its
step, as a new table; the driver is the only one that claims, so no rows are locked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import held
from .state import backoff_seconds

COLUMNS = ("id", "status", "operation", "generation", "chunk_id", "attempts", "max_attempts", "next_attempt_at", "lease_owner", "lease_expires_at", "created_at", "error")


def _set(df: DataFrame, test: Column, **values: Column) -> DataFrame:
    """Rows with columns set where a test holds."""
    return df.withColumns({c: F.when(F.coalesce(test, F.lit(False)), v).otherwise(F.col(c)) for c, v in values.items()})


def exhaust(outbox: DataFrame, now: Column) -> DataFrame:
    """Rows whose lease ran out with no attempt left are failed, where the model would wait for ever."""
    lost = (F.col("status") == "processing") & (F.col("lease_expires_at") < now) & (F.col("attempts") >= F.col("max_attempts"))
    return _set(outbox, lost, status=F.lit("failed"), lease_owner=F.lit(None), lease_expires_at=F.lit(None), error=F.lit("lease_expired"))


def claim_batch(outbox: DataFrame, worker: str, now: Column, size: int, lease_seconds: int) -> tuple[DataFrame, DataFrame]:
    """The outbox after a worker took the first ``size`` rows that are due, and these rows.

    Pending rows are due from their next attempt on, those in process once their lease is over;
    attempts must be left. First come, first served. A taken row has one attempt more.
    """
    due = ((F.col("status") == "pending") & (F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= now))) | ((F.col("status") == "processing") & (F.col("lease_expires_at") < now))
    first = held(outbox.where(due & (F.col("attempts") < F.col("max_attempts"))).orderBy("created_at", "id").limit(size).select("id"))
    marked = outbox.join(F.broadcast(first.withColumn("_taken", F.lit(True))), "id", "left")
    after = _set(marked, F.col("_taken"), status=F.lit("processing"), lease_owner=F.lit(worker), lease_expires_at=now + F.make_interval(secs=F.lit(lease_seconds)), attempts=F.col("attempts") + 1)
    after = after.select(*COLUMNS, "_taken")
    return after.drop("_taken"), after.where("_taken").drop("_taken")


def work_items(claimed: DataFrame, chunks: DataFrame, current: DataFrame) -> DataFrame:
    """Claimed rows with their chunk's text and hash, and ``is_current``: whether the gate still lets it through."""
    text = chunks.select("chunk_id", "text", F.sha2("text", 256).alias("content_hash"))
    here = current.select("chunk_id").distinct().withColumn("is_current", F.lit(True))
    return claimed.join(text, "chunk_id", "left").join(here, "chunk_id", "left").withColumn("is_current", F.coalesce("is_current", F.lit(False)))


def mark(outbox: DataFrame, projected: DataFrame, results: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """The outbox and the projection's states (chunk_id, generation, status) after results (id, is_current, error) of claimed rows.

    Without an error a row has succeeded, and its chunk is ``deleted`` if that was asked or it is
    no longer current, else ``current``, in the row's generation. With one it waits
    min(300, 2 ** attempts) seconds, or is failed for good once attempts are used up. Rows
    that aren't in process any more keep what they are.
    """
    done = results.select("id", "is_current", F.col("error").alias("_error"), F.lit(True).alias("_done"))
    rows = outbox.join(done, "id", "left")
    mine = F.col("_done") & (F.col("status") == "processing")
    well, again = F.col("_error").isNull(), F.col("attempts") < F.col("max_attempts")
    status = F.when(well, "succeeded").when(again, "pending").otherwise("failed")
    later = F.when(~well & again, now + F.make_interval(secs=backoff_seconds(F.col("attempts"))))
    chunk = F.when(well, F.when((F.col("operation") == "delete") | ~F.col("is_current"), "deleted").otherwise("current")).when(again, "pending").otherwise("failed")
    news = rows.where(mine).groupBy("chunk_id").agg(F.max_by(F.struct(chunk.alias("status"), F.when(well, F.col("generation")).alias("generation")), F.struct("generation", "id")).alias("_new"))
    after = _set(rows, mine, next_attempt_at=later, lease_owner=F.lit(None), lease_expires_at=F.lit(None), error=F.left("_error", F.lit(100)), status=status)
    states = projected.join(news, "chunk_id", "left")
    states = states.select("chunk_id", F.coalesce("_new.generation", "generation").alias("generation"), F.coalesce("_new.status", "status").alias("status"))
    return after.select(*COLUMNS), states
