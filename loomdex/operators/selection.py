"""Exact order statistics without a sort: ranges of values are narrowed until few rows are left.

A pass sketches the values in each wanted rank's range, which bounds a narrower one; the next
counts what lies below it, so ranks stay exact. Every pass is a partial aggregate, so the values of
one group, of whatever size, meet in no task; only the last few thousand of a range are sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import settle

#: Values of a range that are sorted at last, at the most; parts that a pass cuts a range into.
FEW, PARTS = 10_000, 256


def select_ranks(values: DataFrame, column: str, by: str, ranks: DataFrame) -> DataFrame:
    """``by, rank, value``: the value of each wanted rank (by, rank; from 0) among its group's values in ascending order.

    Nulls have no rank; ranks beyond a group have no row. ``column`` is numeric; not a number
    comes last, as Spark orders it.
    """
    rows = values.where(F.col(column).isNotNull()).select(F.col(by).alias("_by"), F.col(column).alias("_v"))
    count = rows.groupBy("_by").agg(F.count("*").alias("inside"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    state = settle(ranks.select(F.col(by).alias("_by"), F.col("rank").cast("long").alias("rank")).distinct().join(count, "_by").where("rank >= 0 AND rank < inside").withColumn("below", F.lit(0).cast("long")))
    done = []
    while True:
        easy = F.col("lo") == F.col("hi")
        done.append(state.where(easy).select("_by", "rank", F.col("lo").alias("value")))
        held = _in_range(rows, state.where(~easy & (F.col("inside") <= FEW)))
        last = held.groupBy("_by", "rank", "below").agg(F.array_sort(F.collect_list("_v")).alias("v"))
        done.append(last.select("_by", "rank", F.element_at("v", (F.col("rank") - F.col("below") + 1).cast("int")).alias("value")))
        state = state.where(~easy & (F.col("inside") > FEW))
        if state.isEmpty():
            break
        grid = [i / PARTS for i in range(PARTS + 1)]
        cuts = _in_range(rows, state).groupBy("_by", "rank").agg(F.percentile_approx("_v", grid, 40 * PARTS).alias("cuts"))
        part = F.floor((F.col("rank") - F.col("below")) / F.col("inside") * PARTS).cast("int")
        # a cut's rank is off by less than one part, so the range between the cuts around holds the rank
        low = F.when(part >= 1, F.get("cuts", part - 1)).otherwise(F.col("lo"))
        high = F.when(part + 2 <= PARTS, F.get("cuts", part + 2)).otherwise(F.col("hi"))
        narrow = settle(state.join(cuts, ["_by", "rank"]).select("_by", "rank", "below", F.col("lo").alias("from"), F.col("hi").alias("to"), low.alias("lo"), high.alias("hi")))
        seen = _in_range(rows, narrow, "from", "to").groupBy("_by", "rank").agg(F.count_if(F.col("_v") < F.col("lo")).alias("less"), F.count_if(F.col("_v").between(F.col("lo"), F.col("hi"))).alias("inside"))
        state = settle(narrow.join(seen, ["_by", "rank"]).select("_by", "rank", "inside", "lo", "hi", (F.col("below") + F.col("less")).alias("below")))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select(F.col("_by").alias(by), "rank", "value")


def _in_range(rows: DataFrame, state: DataFrame, low: str = "lo", high: str = "hi") -> DataFrame:
    """Values of the wanted ranges; wanted ranks are few, and go to every task only if they are."""
    few = state.limit(10_001).count() <= 10_000
    return rows.join(F.broadcast(state) if few else state, "_by").where(F.col("_v").between(F.col(low), F.col(high)))
