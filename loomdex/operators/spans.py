"""Interval joins: points in spans, and spans in spans, of the same key.

A span lies in at most two bins as wide as the next power of two of its length. Spans of one
such level that share a bin are about as long as the bin, so a point that looks into its bin of
every level meets little but the spans that hold it: rows grow with points, spans and hits,
not with points times spans of a key, however spans nest. Bins also split a hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _level(start: Column, end: Column) -> Column:
    """The smallest power of two, as its exponent, that is at least a span's length."""
    return F.ceil(F.log2(F.greatest(end - start, F.lit(1)).cast("double"))).cast("int")


def _bin(at: Column, level: Column) -> Column:
    return F.floor(at / F.pow(F.lit(2.0), level)).cast("long")


def inside(points: DataFrame, spans: DataFrame, key: str, point: str, start: str = "char_start", end: str = "char_end") -> DataFrame:
    """Points (key, point, ...) joined to the spans (key, start, end, ...) with start <= point < end.

    Points keep their columns; spans bring those that points don't have. Null keys and points, and empty
    spans, join nothing. Positions are exact up to 2**53.
    """
    level = _level(F.col(start), F.col(end))
    held = spans.where(F.col(start) < F.col(end)).withColumn("_level", level)
    held = held.withColumn("_bin", F.explode(F.sequence(_bin(F.col(start), F.col("_level")), _bin(F.col(end) - 1, F.col("_level")))))
    levels = sorted(r[0] for r in held.select("_level").distinct().collect())  # 63 at the most
    look = F.explode(F.array(*[F.struct(F.lit(n).cast("int").alias("_level"), _bin(F.col(point), F.lit(n)).alias("_bin")) for n in levels])) if levels else F.explode(F.array().cast("array<struct<_level: int, _bin: bigint>>"))
    asked = points.withColumn("_at", look).withColumns({"_level": F.col("_at._level"), "_bin": F.col("_at._bin"), "_point": F.col(point)}).drop("_at")
    held = held.withColumns({"_start": F.col(start), "_end": F.col(end)})  # points may have columns of these names
    twins = [c for c in held.columns if c in points.columns and c != key]
    found = asked.join(held.drop(*twins), [key, "_level", "_bin"]).where("_point >= _start AND _point < _end")
    return found.select(*points.columns, *[c for c in spans.columns if c not in points.columns])


def first_inside(points: DataFrame, spans: DataFrame, key: str, point: str, span_id: str, order: str) -> DataFrame:
    """Each point with the first span, by ``order``, that holds it, or null."""
    slim = spans.select(key, "char_start", "char_end", F.col(span_id).alias("_id"), F.col(order).alias("_order"))
    best = inside(points.select(key, point).distinct(), slim, key, point).groupBy(key, point).agg(F.min_by("_id", F.struct("_order", "_id")).alias(span_id))
    return points.join(best, [key, point], "left").select(*[points[c] for c in points.columns], best[span_id])


def within(inner: DataFrame, outer: DataFrame, key: str, start: str = "span_start", end: str = "span_end") -> DataFrame:
    """Inner spans (key, char_start, char_end, ...) with each outer span (key, start, end) that holds them whole."""
    return inside(inner, outer, key, "char_start", start, end).where(F.col("char_end") <= F.col(end))
