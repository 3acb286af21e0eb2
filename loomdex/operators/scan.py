"""Snapshot diff: what a scan found against what was known, one full outer join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import settle


def hash_needed(full_rehash: bool = False) -> Column:
    """Whether a scanned file must be hashed: new, or its size or time changed. Columns as ``diff`` joins them."""
    return F.lit(full_rehash) | F.col("old_size").isNull() | (F.col("old_size") != F.col("size")) | (F.col("old_mtime") != F.col("mtime"))


def carry_hashes(previous: DataFrame, current: DataFrame, full_rehash: bool = False) -> DataFrame:
    """Current files with ``needs_hash`` and the hash that is carried over where they don't."""
    old = previous.select("key", F.col("size").alias("old_size"), F.col("mtime").alias("old_mtime"), F.col("hash").alias("old_hash"))
    joined = current.join(old, "key", "left").withColumn("needs_hash", hash_needed(full_rehash))
    return joined.withColumn("hash", F.when(F.col("needs_hash"), F.col("hash")).otherwise(F.col("old_hash"))).drop("old_size", "old_mtime", "old_hash")


def diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Changes between snapshots of (key, hash, failed): ``kind, key, old_key, hash``.

    A hash that left one key and came to one other is a rename; one that left or came to
    several is ambiguous on both sides. A file that couldn't be read is ``read_failed``
    and, if it was known, not deleted. Unchanged files have no row.
    """
    old = previous.select(F.col("key"), F.col("hash").alias("old_hash"))
    new = current.select("key", F.col("hash").alias("new_hash"), F.coalesce("failed", F.lit(False)).alias("failed"))
    both = settle(old.join(new, "key", "full"))  # seven branches read it
    gone = both.where("new_hash IS NULL AND failed IS NULL").select("key", F.col("old_hash").alias("hash"))
    came = both.where("old_hash IS NULL AND NOT failed").select("key", F.col("new_hash").alias("hash"))
    left = gone.groupBy("hash").agg(F.count("*").alias("n_gone"), F.min("key").alias("gone_key"))
    right = came.groupBy("hash").agg(F.count("*").alias("n_came"), F.min("key").alias("came_key"))
    match = left.join(right, "hash")
    one = match.where("n_gone = 1 AND n_came = 1")
    renamed = one.select(F.lit("renamed").alias("kind"), F.col("came_key").alias("key"), F.col("gone_key").alias("old_key"), "hash")
    several = match.where("n_gone > 1 OR n_came > 1").select("hash")
    none = F.lit(None).cast("string")
    parts = [renamed]
    for rows, kind in ((gone, "deleted"), (came, "created")):
        parts.append(rows.join(match.select("hash"), "hash", "left_anti").select(F.lit(kind).alias("kind"), "key", none.alias("old_key"), "hash"))
        parts.append(rows.join(several, "hash", "left_semi").select(F.lit("ambiguous_rename").alias("kind"), "key", none.alias("old_key"), "hash"))
    changed = both.where("old_hash <> new_hash AND NOT failed").select(F.lit("modified").alias("kind"), "key", none.alias("old_key"), F.col("new_hash").alias("hash"))
    failed = both.where("failed").select(F.lit("read_failed").alias("kind"), "key", none.alias("old_key"), none.alias("hash"))
    out = changed.unionByName(failed)
    for p in parts:
        out = out.unionByName(p)
    return out


def counters(changes: DataFrame) -> DataFrame:
    """One row of counts; ambiguous changes count as new and as deleted."""
    n = lambda *kinds: F.count_if(F.col("kind").isin(*kinds))
    return changes.agg(n("created", "ambiguous_rename").alias("new_count"), n("modified").alias("modified_count"), n("renamed").alias("renamed_count"), n("deleted", "ambiguous_rename").alias("deleted_count"), n("read_failed").alias("failed_count"))


def apply_changes(states: DataFrame, changes: DataFrame) -> DataFrame:
    """File states (key, document_id, hash, lifecycle) after a scan: renames keep their document,
    deletions end it, a path that comes back revives the document that it had."""
    renames = changes.where("kind = 'renamed'").select(F.col("old_key").alias("key"), F.col("key").alias("to"))
    moved = states.join(renames, "key", "left").select(F.coalesce("to", "key").alias("key"), "document_id", "hash", "lifecycle")
    latest = changes.select("key", "kind", F.col("hash").alias("new_hash"))
    both = moved.join(latest, "key", "full")
    gone = (F.col("kind") == "deleted") | ((F.col("kind") == "ambiguous_rename") & F.col("document_id").isNotNull())
    return both.select("key", F.coalesce("document_id", F.sha2("key", 256)).alias("document_id"), F.when(gone, F.col("hash")).otherwise(F.coalesce("new_hash", "hash")).alias("hash"), F.when(gone, "deleted").when(F.col("kind") == "read_failed", "error").when(F.col("kind").isNotNull(), "active").otherwise(F.col("lifecycle")).alias("lifecycle"))


def to_parse(before: DataFrame, after: DataFrame) -> DataFrame:
    """Documents whose content must be parsed: new or changed hashes of active files, and former errors."""
    old = before.select("document_id", F.col("hash").alias("old_hash"), F.col("lifecycle").alias("old_lifecycle"))
    return after.where("lifecycle = 'active'").join(old, "document_id", "left").where("old_hash IS NULL OR old_hash <> hash OR old_lifecycle <> 'active'").select(after["*"])
