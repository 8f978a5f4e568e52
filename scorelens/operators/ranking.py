"""Global positions in a total order without a single-partition window.

``prefix_sum`` range-partitions by the order columns (Spark samples the
bounds), numbers rows inside each range partition with a window partitioned
by that partition, and adds the total of all earlier partitions.  The only
single-task step works on one row per partition, so its size is bounded by
the partition count, never by the data.

The partition id is written out with the rows once (``stage``) before the two
branches (local numbering, partition totals) read it: range bounds come from a
sample of shuffle output, whose row order is not deterministic, so two
independent evaluations of the range exchange may disagree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import stage


def prefix_sum(df: DataFrame, order_cols: list[str], weight: str | None = None,
               out: str = "cum", n_partitions: int | None = None,
               stage_mode: str = "table") -> DataFrame:
    """Add ``out`` = sum of ``weight`` (1 per row by default) over all rows up
    to and including this one in ``order_cols`` order.  Rows that tie on every
    order column are numbered in an arbitrary order, so ties should be
    interchangeable (identical rows) or made unique by the caller."""
    w = F.col(weight) if weight else F.lit(1)
    # Without an explicit count AQE may coalesce adjacent ranges (small data)
    # while the shuffle-partition setting sizes the split at scale; a coalesced
    # partition is still one contiguous range, so its id keeps the order.
    ranged = (df.repartitionByRange(n_partitions, *order_cols) if n_partitions
              else df.repartitionByRange(*order_cols))
    ranged = (ranged
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_w", w.cast("bigint")))
    ranged = stage(ranged, "ranked", stage_mode)
    local = ranged.withColumn(
        "_local", F.sum("_w").over(Window.partitionBy("_pid").orderBy(*order_cols)
                                   .rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    totals = ranged.groupBy("_pid").agg(F.sum("_w").alias("_tot"))
    # One row per partition: the single-partition window is bounded by the partition count.
    offsets = totals.select("_pid", F.coalesce(
        F.sum("_tot").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("_off"))
    return (local.join(F.broadcast(offsets), "_pid")
            .withColumn(out, F.col("_off") + F.col("_local"))
            .drop("_pid", "_w", "_local", "_off"))


def row_index(df: DataFrame, order_cols: list[str], out: str = "idx",
              n_partitions: int | None = None) -> DataFrame:
    """0-based position in ``order_cols`` order (the distributed zipWithIndex)."""
    return (prefix_sum(df, order_cols, None, "_cum", n_partitions)
            .withColumn(out, F.col("_cum") - 1).drop("_cum"))
