"""Running sums over a whole table without a window over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written


def running(rows: DataFrame, order: str, value: Column) -> DataFrame:
    """Adds before: the sum of value over all rows before, in order of a column without ties.

    Rows are cut into ranges of the order, which are written so that they stay, summed
    within their range, and get the sums of the ranges before.
    """
    parts = written(rows.withColumn("range_value", value).repartitionByRange(order).withColumn("range_part", F.spark_partition_id()), "ranges")
    until = (Window.unboundedPreceding, -1)
    sums = parts.groupBy("range_part").agg(F.sum("range_value").alias("range_sum"))  # a row for each range
    base = sums.select("range_part", F.coalesce(F.sum("range_sum").over(Window.orderBy("range_part").rowsBetween(*until)), F.lit(0)).alias("range_base"))
    own = F.coalesce(F.sum("range_value").over(Window.partitionBy("range_part").orderBy(order).rowsBetween(*until)), F.lit(0))
    out = parts.withColumn("before", own).join(base, "range_part").withColumn("before", F.col("before") + F.col("range_base"))
    return out.drop("range_part", "range_base", "range_value")
