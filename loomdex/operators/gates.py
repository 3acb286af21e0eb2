"""The current-source gate: what may be seen is what the current, ready version of an active document holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def current_versions(documents: DataFrame, versions: DataFrame, require_ready: bool = True) -> DataFrame:
    """Documents (document_id, vault_id, lifecycle, current_version_id) with their current version (version_id, status)."""
    on = (versions.document_id == documents.document_id) & (versions.version_id == documents.current_version_id)
    rows = documents.where("lifecycle = 'active'").join(versions, on).select(documents.document_id, documents.vault_id, versions.version_id, versions.status)
    return rows.where("status = 'ready'") if require_ready else rows


def current_chunks(chunks: DataFrame, documents: DataFrame, versions: DataFrame, vault: str | None = None, require_ready: bool = True) -> DataFrame:
    """Chunks (chunk_id, version_id, ...) of current versions, in one vault if it is named."""
    current = current_versions(documents, versions, require_ready)
    current = current if vault is None else current.where(F.col("vault_id") == vault)
    return chunks.join(current.select("version_id", "document_id", "vault_id"), "version_id")


def latest(df: DataFrame, by: list[str], order: str, *columns: str) -> DataFrame:
    """The columns of each key's row with the largest ``order``: one partial aggregate, no window."""
    return df.groupBy(*by).agg(F.max_by(F.struct(*columns), order).alias("r")).select(*by, "r.*")


def upsert(existing: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Rows of ``new`` and those of ``existing`` whose key isn't in it."""
    return new.unionByName(existing.join(new.select(*keys), list(keys), "left_anti"))


def insert_missing(existing: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Rows of ``new``, one a key, whose key isn't in ``existing``: what would be inserted."""
    return new.dropDuplicates(list(keys)).join(existing.select(*keys), list(keys), "left_anti")
