"""Sinks: document versions, projections, aliases and audit rows, written so that a retry changes nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lineage import exists, remove, settle


def store_versions(spark: SparkSession, new: DataFrame, path: str, key: str = "document_id", buckets: int = 256, gone: DataFrame | None = None) -> None:
    """Replace the derived rows of the documents in ``new``, drop those of ``gone`` and leave all others.

    Rows lie in folders by a hash of their document. Folders that the two touch are written
    again whole, from what they held of other documents and from ``new``, and removed if
    nothing is left; a retry gives the same. A bucket that is large is written by several tasks.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    rows = new.withColumn("bucket", bucket)
    empty: set[int] = set()
    if exists(spark, path):
        names = new.select(key) if gone is None else new.select(key).unionByName(gone.select(key))
        names = names.distinct()
        touched = sorted(r[0] for r in names.select(bucket).distinct().collect())
        old = spark.read.schema(rows.schema).parquet(path).where(F.col("bucket").isin(touched)).join(names, key, "left_anti")
        rows = settle(old.select(*rows.columns).unionByName(rows))  # what is overwritten can't be read meanwhile
        empty = set(touched) - {r[0] for r in rows.select("bucket").distinct().collect()}
    rows.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    for b in empty:
        remove(spark, f"{path}/bucket={b}")


def supersede(versions: DataFrame, stored: DataFrame) -> DataFrame:
    """Versions (document_id, version_id, status) after ``stored`` ones became ready: the others of the
    same documents are superseded, an identical older version comes back to life."""
    s = stored.select("document_id", F.col("version_id").alias("_new")).distinct()
    both = versions.join(s, "document_id", "left")
    kept = both.select("document_id", "version_id", F.when(F.col("_new").isNull(), F.col("status")).when(F.col("_new") == F.col("version_id"), "ready").otherwise("superseded").alias("status"))
    return kept.unionByName(stored.join(versions, ["document_id", "version_id"], "left_anti").select("document_id", "version_id", F.lit("ready").alias("status")))


def soft_delete(documents: DataFrame, gone: DataFrame) -> DataFrame:
    """Documents of ``gone`` become deleted and lose their current version."""
    mark = gone.select("document_id").distinct().withColumn("_gone", F.lit(True))
    rows = documents.join(mark, "document_id", "left")
    off = F.col("_gone").isNotNull()
    return rows.withColumn("lifecycle", F.when(off, "deleted").otherwise(F.col("lifecycle"))).withColumn("current_version_id", F.when(~off, F.col("current_version_id"))).drop("_gone")


def put_vectors(existing: DataFrame, upserts: DataFrame, deletes: DataFrame, dimension: int, id_col: str = "chunk_id") -> DataFrame:
    """A vector table after upserts and deletes; a vector of another dimension fails the write."""
    checked = upserts.withColumn("embedding", F.when(F.size("embedding") == dimension, F.col("embedding")).otherwise(F.raise_error(F.lit(f"a vector isn't of dimension {dimension}"))))
    gone = upserts.select(id_col).unionByName(deletes.select(id_col)).distinct()
    return existing.join(gone, id_col, "left_anti").unionByName(checked)


def switch_alias(spark: SparkSession, alias: str, path: str) -> None:
    """Point a name at a physical table; readers see the old or the new one."""
    spark.read.parquet(path).createOrReplaceTempView(alias)


def collection_state(vectors: DataFrame, expected: int) -> DataFrame:
    return vectors.agg(F.count("*").alias("n"), (F.count("*") == expected).alias("complete"), F.min(F.size("embedding")).alias("least_dimension"), F.max(F.size("embedding")).alias("most_dimension"))


def audit_row(query: Column, strategy: Column, status: Column, n: Column, started: Column, ended: Column) -> Column:
    """A query run's record: the query by its hash only, and its latency."""
    return F.struct(F.sha2(query, 256).alias("query_sha256"), strategy.alias("strategy"), status.alias("status"), n.alias("result_count"), ((ended.cast("double") - started.cast("double")) * 1000).cast("long").alias("latency_ms"))
