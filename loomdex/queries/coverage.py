"""Queries: general relational coverage and windows over the event stream's table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..streaming import windows
from . import query
from .model import table


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag)::BIGINT * 2 + grouping(l_linestatus)::BIGINT AS g FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_counts(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))


@query("SELECT o_orderstatus, o_orderpriority, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup_totals(spark, d):
    return table(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def set_intersect(spark, d):
    o = table(spark, d, "orders")
    return o.where("o_orderstatus = 'O'").select("o_custkey").intersect(o.where("o_orderstatus = 'F'").select("o_custkey"))


@query("SELECT l_partkey FROM lineitem WHERE l_quantity > 25 EXCEPT ALL SELECT l_partkey FROM lineitem WHERE l_quantity <= 25")
def set_except_all(spark, d):
    l = table(spark, d, "lineitem")
    return l.where("l_quantity > 25").select("l_partkey").exceptAll(l.where("l_quantity <= 25").select("l_partkey"))


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS moving FROM orders")
def window_frame(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(-2, 0)
    return table(spark, d, "orders").select("o_orderkey", F.round(F.sum("o_totalprice").over(w), 2).alias("moving"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts)::VARCHAR AS start, event_type, count(*) AS n, round(sum(value), 6) AS value FROM events GROUP BY ALL")
def tumbling_counts(spark, d):
    return windows.tumbling_counts(table(spark, d, "events")).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("value", 6).alias("value"))


@query("""SELECT user_id, min(ts)::TIMESTAMP AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT user_id, ts, event_id,
    CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")
def session_windows(spark, d):
    return windows.sessions(table(spark, d, "events")).select("user_id", "start", "n")


@query("""SELECT e.event_id, arg_max(p.event_id, (p.ts, p.event_id)) AS last_purchase FROM events e LEFT JOIN events p ON p.user_id = e.user_id AND p.event_type = 'purchase' AND (p.ts, p.event_id) <= (e.ts, e.event_id) WHERE e.event_type = 'view' GROUP BY 1""")
def as_of_purchase(spark, d):
    """As-of join by one window over the union of both sides, not by an inequality join."""
    e = table(spark, d, "events").where("event_type IN ('view', 'purchase')")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w)
    return e.select("event_id", "event_type", last.alias("last_purchase")).where("event_type = 'view'").drop("event_type")


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-01' GROUP BY ALL""")
def pricing_summary(spark, d):
    rows = table(spark, d, "lineitem").where("l_shipdate <= TIMESTAMP '1998-09-01'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA' GROUP BY 1""")
def local_supplier_volume(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region").where("r_name = 'ASIA'"), F.col("r_regionkey") == F.col("n_regionkey")).select("n_nationkey", "n_name")
    s = table(spark, d, "supplier").join(n, F.col("n_nationkey") == F.col("s_nationkey")).select("s_suppkey", "s_nationkey", "n_name")
    rows = table(spark, d, "lineitem").join(s, F.col("s_suppkey") == F.col("l_suppkey")).join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(table(spark, d, "customer"), (F.col("c_custkey") == F.col("o_custkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    return rows.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
