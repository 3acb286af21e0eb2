"""Enumerated domains of the data model and data-quality operators that return violating rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The domains of the model's enumerated columns.
DOMAINS = {
    "scan_kind": ("created", "modified", "renamed", "deleted", "ambiguous_rename", "read_failed"),
    "scan_type": ("incremental", "full_rehash", "measure"),
    "lifecycle": ("active", "deleted", "error"),
    "version_status": ("discovered", "parsing", "ready", "failed", "superseded"),
    "block_type": ("paragraph", "list", "table", "fenced_code", "indented_code", "blockquote", "heading", "thematic_break", "html", "other"),
    "retrieval_role": ("structural_anchor", "content_evidence"),
    "link_kind": ("wikilink", "markdown", "embed"),
    "link_resolution": ("resolved", "unresolved", "ambiguous", "external"),
    "outbox_status": ("pending", "processing", "succeeded", "failed"),
    "job_status": ("queued", "running", "succeeded", "failed", "cancelled"),
    "decision": ("create", "merge", "keep_separate", "defer"),
}


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def outside(df: DataFrame, column: str, domain: str) -> DataFrame:
    """Rows whose value isn't in the domain."""
    return df.where(~F.col(column).isin(*DOMAINS[domain]) | F.col(column).isNull())


def bad_spans(df: DataFrame, start: str, end: str, length: str) -> DataFrame:
    """Rows whose half-open span is empty, reversed or out of its text."""
    return df.where(~((F.col(start) >= 0) & (F.col(start) < F.col(end)) & (F.col(end) <= F.col(length))))


def dangling(df: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key has no parent row: the referential check before a snapshot is published."""
    return df.join(parents, df[key] == parents[parent_key], "left_anti")
