"""Mergeable sketches: partial results of any grouping that add up to the whole's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_sketches(rows: DataFrame, by: list[str], column: str, bits: int = 12) -> DataFrame:
    """``by, sketch``: a HyperLogLog sketch of each group's distinct values, of at most 2 ** bits registers."""
    return rows.groupBy(*by).agg(F.hll_sketch_agg(column, F.lit(bits)).alias("sketch"))


def distinct_estimates(sketches: DataFrame, *by: str) -> DataFrame:
    """``by, n``: estimates of the union of sketches, by fewer columns than they were made with."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n"))
