"""Global positions without one global window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.sources.store import forget, written


def with_ordinal(df: DataFrame, order: list[str], name: str = "seq") -> DataFrame:
    """Adds the 0-based position of each row in the total order of ``order``; null sorts first, ties in any order.

    The rows are written first, since finding the ranges and dealing the rows out each read them. They are dealt out in even ranges
    of the order, a random number dividing ties, so neither clustered nor repeated keys fill one task, numbered inside their range and
    written. Only the table of range sizes, a row a range, meets in one window. Wide columns are better joined to the result.
    """
    df = written(df, "unnumbered")
    keys = [F.col(c).asc_nulls_first() for c in order]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.withColumn("_tie", F.rand(7)).repartitionByRange(parts, *keys, "_tie").sortWithinPartitions(*keys, "_tie")
    rows = written(ranged.withColumns({"_p": F.spark_partition_id(), "_k": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}).drop("_tie"), "ranges")
    forget(df)
    before = F.sum("n").over(Window.orderBy("q").rowsBetween(Window.unboundedPreceding, -1))
    starts = rows.groupBy(F.col("_p").alias("q")).agg(F.count("*").alias("n")).select("q", F.coalesce(before, F.lit(0)).alias("_start"))
    placed = rows.join(F.broadcast(starts), F.col("_p") == F.col("q"))  # a row a partition
    return placed.withColumn(name, (F.col("_start") + F.col("_k")).cast("long")).drop("_p", "_k", "q", "_start")
