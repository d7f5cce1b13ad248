"""Consecutive numbers over a total order, without a global window."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from veracell.functions.session import cut_lineage


def number_rows(df: DataFrame, order: list, name: str = "n") -> DataFrame:
    """1-based position in the given order.

    Rows are range-partitioned and sorted, the partition is written down and checkpointed, and
    each partition adds the row count of those before it (one line per partition).
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    fixed = cut_lineage(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys)
        .withColumn("__part", F.spark_partition_id())
        .withColumn("__pos", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = fixed.groupBy("__part").agg(F.count(F.lit(1)).alias("__rows")).select(
        "__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__offset"))
    return fixed.join(F.broadcast(offsets), "__part").withColumn(
        name, F.col("__offset") + F.col("__pos") + 1).drop("__part", "__pos", "__offset")
