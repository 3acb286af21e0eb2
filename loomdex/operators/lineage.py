"""Cutting lineage, and folders that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; the warehouse where it is unset, as in tests."""
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def scratch(spark: SparkSession, kind: str) -> str:
    """A new folder there for files of one kind."""
    return f"{shared(spark)}/{kind}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists, in any store that Spark reads."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it exists, in any store that Spark writes."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def held(df: DataFrame) -> DataFrame:
    """A few rows, which a limit bounds, as a local table: its size is known, so joins broadcast it."""
    rows = df.toArrow()
    out = df.sparkSession.createDataFrame(rows, df.schema)
    out.held = rows.num_rows
    return out


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(f"{shared(df.sparkSession)}/_checkpoints")
    return df.checkpoint(eager=True)
