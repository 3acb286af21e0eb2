"""File states as a stream of scans: each micro-batch is one scan, diffed against the state that the batch before it left.

States are written as one folder for each batch number, so a batch that is run again after
a failure reads the same predecessor and overwrites its own folder: nothing is applied twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import scan

STATE = "key string, document_id string, hash string, lifecycle string"


def _before(spark: SparkSession, path: str, number: int) -> DataFrame:
    """The states of the largest batch number below ``number``."""
    states = spark.read.schema(f"{STATE}, batch long").option("basePath", f"{path}/states").parquet(*_folders(spark, path)) if _folders(spark, path) else None
    last = None if states is None else states.where(F.col("batch") < number).agg(F.max("batch")).first()[0]
    return spark.createDataFrame([], STATE) if last is None else states.where(F.col("batch") == last).drop("batch")


def _folders(spark: SparkSession, path: str) -> list[str]:
    """The state folders that exist, through Hadoop's own file system, so any store works."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/states/batch=*")
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    return [f.getPath().toString() for f in found or []]


def apply_scan(path: str):
    """A foreachBatch function: a batch of scanned files (key, hash, failed) becomes changes and states under ``path``."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        held = batch.select("key", "hash", "failed").persist()
        try:
            old = _before(spark, path, number)
            changes = scan.diff(old.where("lifecycle <> 'deleted'").select("key", "hash"), held)
            changes.write.mode("overwrite").parquet(f"{path}/changes/batch={number}")
            done = spark.read.parquet(f"{path}/changes/batch={number}")
            scan.apply_changes(old, done).write.mode("overwrite").parquet(f"{path}/states/batch={number}")
        finally:
            held.unpersist()

    return run


def follow(spark: SparkSession, scans: str, path: str, checkpoint: str) -> StreamingQuery:
    """Apply every scan file (Parquet: key, hash, failed) that has come to the folder ``scans``, in order, and stop."""
    files = spark.readStream.schema("key string, hash string, failed boolean").option("maxFilesPerTrigger", 1).parquet(scans)
    return files.writeStream.foreachBatch(apply_scan(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
