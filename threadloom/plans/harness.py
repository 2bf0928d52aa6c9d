"""Breadth queries over the star schema and the events table. They stand for no operator of the engine; they show that
its tables answer ordinary SQL questions in the same session."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from threadloom.sources.tables import table


def harness_pricing(spark, d):
    li = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.count("*").alias("n"), F.round(F.avg("l_discount"), 6).alias("avg_disc"))


def harness_nation_revenue(spark, d):
    li, o, c, n = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "nation"))
    got = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return got.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.countDistinct("o_orderkey").alias("orders"))


def harness_event_hours(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("n"))


def harness_sessions(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("gap", F.col("ts") - F.lag("ts").over(w))
    return e.groupBy("user_id").agg(F.count_if(F.col("gap").isNull() | (F.col("gap") > F.expr("interval 30 minutes"))).alias("sessions"), F.count("*").alias("events"))


def harness_top_orders(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").withColumn("k", F.row_number().over(w)).where("k <= 2").select("o_custkey", "o_orderkey", "k")


QUERIES = {f.__name__: f for f in (harness_pricing, harness_nation_revenue, harness_event_hours, harness_sessions, harness_top_orders)}

ORACLES = {
    "harness_pricing": "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, count(*) AS n, round(avg(l_discount), 6) AS avg_disc FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL",
    "harness_nation_revenue": """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS orders
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""",
    "harness_event_hours": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL",
    "harness_sessions": """WITH g AS (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)
      SELECT user_id, count(*) FILTER (gap IS NULL OR gap > 1800000000) AS sessions, count(*) AS events FROM g GROUP BY user_id""",
    "harness_top_orders": "SELECT o_custkey, o_orderkey, CAST(k AS INTEGER) AS k FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 2",
}
