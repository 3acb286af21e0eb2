"""Evaluation metrics of ranked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .selection import select_ranks


def document_rank(paths: Column, expected: Column) -> Column:
    """Position of a document among the distinct documents of a hit list; null if it isn't there."""
    return F.nullif(F.array_position(F.array_distinct(paths), expected), F.lit(0))


def recall_mrr(ranks: DataFrame, k: int = 5, rank: str = "rank") -> DataFrame:
    hit = F.col(rank).isNotNull() & (F.col(rank) <= k)
    return ranks.agg(F.avg(F.when(hit, 1.0).otherwise(0.0)).alias("recall"), F.avg(F.when(hit, 1.0 / F.col(rank)).otherwise(0.0)).alias("mrr"))


def latency_percentiles(samples: DataFrame, column: str, by: str) -> DataFrame:
    """``by, p50, p95``: the median, and the sample nearest to 0.95 (n - 1), halves to even. Nulls don't count.

    Exact, by narrowing ranges of values: no group is sorted or meets in one task.
    """
    n = samples.where(F.col(column).isNotNull()).groupBy(by).agg((F.count("*") - 1).alias("last")).where(F.col(by).isNotNull())
    wanted = n.select(by, F.floor(F.col("last") / 2).alias("low"), F.ceil(F.col("last") / 2).alias("high"), F.bround(F.col("last") * F.lit(0.95)).cast("long").alias("tail"))
    each = wanted.select(by, F.explode(F.array_distinct(F.array("low", "high", "tail"))).alias("rank"))
    held = select_ranks(samples, column, by, each).join(wanted, by)
    pick = lambda rank: F.max(F.when(F.col("rank") == F.col(rank), F.col("value")))
    return held.groupBy(by).agg(((pick("low") + pick("high")) / 2).alias("p50"), pick("tail").alias("p95"))


def acceptance(rows: DataFrame, status: str = "status") -> DataFrame:
    valid = F.count_if(F.col(status) == "valid")
    return rows.agg(valid.alias("valid"), F.count_if(F.col(status) == "invalid").alias("invalid"), (valid / F.nullif(F.count_if(F.col(status).isin("valid", "invalid")), F.lit(0))).alias("rate"))
