"""Numbers and ranks over a whole table without a task that sees all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import deleted, written


def distinct_counts(df: DataFrame, column: str) -> DataFrame:
    """value, n, before (rows with smaller values), code (distinct values that are smaller) of each value; null is the smallest.

    Values are counted with map-side combine and sorted by ranges; what lies before a range is added up over ranges, a row
    each. Infinite and NaN values have Spark's order. No rows give none. The result is written to the shared folder.
    """
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    dealt = written(counts.repartitionByRange("value").withColumn("part", F.spark_partition_id()), "ranks")
    up = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = dealt.groupBy("part").agg(F.sum("n").alias("rows"), F.count("*").alias("values"))
    whole = Window.orderBy("part")  # a row a range
    first = parts.select("part", up("rows", whole).alias("rows"), up("values", whole).alias("values"))
    inner = Window.partitionBy("part").orderBy("value")
    each = dealt.withColumn("b", up("n", inner)).withColumn("c", F.row_number().over(inner) - 1)
    out = written(each.join(first, "part").select("value", "n", (F.col("rows") + F.col("b")).alias("before"), (F.col("values") + F.col("c")).alias("code")), "ranks")
    deleted(dealt)
    return out


def mid_ranked(df: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` with ``name``: the mid-rank (from 1) of ``column`` among all rows."""
    at = distinct_counts(df, column).select(F.col("value").alias("__v"), (F.col("before") + (F.col("n") + 1) / 2).cast("double").alias(name))
    return df.join(at, F.col(column).eqNullSafe(F.col("__v"))).drop("__v")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with ``name``: the number (from 0) of each row in order of ``order``, counted in ranges; written to the shared folder."""
    part, inner = F.spark_partition_id(), F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)
    dealt = written(df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", part.alias("__part"), inner.alias("__inner")), "numbered")
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    first = dealt.groupBy("__part").agg(F.count("*").alias("n")).select("__part", before.alias("__first"))
    out = written(dealt.join(first, "__part").withColumn(name, F.col("__first") + F.col("__inner")).drop("__part", "__inner", "__first"), "numbered")
    deleted(dealt)
    return out
