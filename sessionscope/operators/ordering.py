"""Global order without a single task: dense row index and prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionscope.operators.staging import stage

_ROW_BITS = 33  # monotonically_increasing_id keeps the partition above these bits


def with_global_index(df: DataFrame, order: list[Column], name: str = "idx", prefix_sums: dict[str, str] | None = None) -> DataFrame:
    """Add a dense 0-based index in the given order; ``prefix_sums`` maps a column to the name of its running total.

    Rows are dealt by range and sorted inside their partition; a row per partition (not per record) is
    then summed up to give each partition its offset. ``order`` should be total for a repeatable index.
    """
    sums = prefix_sums or {}
    placed = stage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id()), "ordered")
    placed = placed.withColumn("_pid", F.shiftright("_row", _ROW_BITS)).withColumn("_pos", F.col("_row").bitwiseAND((1 << _ROW_BITS) - 1))
    totals = placed.groupBy("_pid").agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_t_{c}") for c in sums])
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    offsets = totals.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"), *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in sums])
    out = placed.join(F.broadcast(offsets), "_pid").withColumn(name, F.col("_off") + F.col("_pos"))
    if sums:
        inside = Window.partitionBy("_pid").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumns({new: F.col(f"_b_{c}") + F.sum(c).over(inside) for c, new in sums.items()})
    return out.select(*df.columns, name, *sums.values())
