"""Consecutive row numbers without pulling all rows into one task.

``row_number()`` over an unpartitioned window moves every row to a single
task.  Here the frame is range-partitioned and sorted by the ordering key,
materialised once with a reliable ``checkpoint()`` (range bounds come from a
sample and could differ between two executions), then each partition's row
count is turned into an offset.  The offset table has one row per partition,
so broadcasting it is bounded by the partition count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def consecutive_index(df: DataFrame, order_cols: list, out_col: str = "row_idx",
                      start: int = 0, num_partitions: int | None = None,
                      group_cols: list | None = None) -> DataFrame:
    """Add ``out_col`` = start, start+1, ... in the order of ``order_cols``,
    restarting for every value of ``group_cols`` (if given).

    ``order_cols`` must define a total order within a group (add a unique
    tie-breaker).  With groups, rows are range-partitioned by (group, order),
    so a group's rows are contiguous inside a partition; each (partition,
    group) contributes its row count and first id, and offsets are running
    sums per group over partitions.  Without groups the offset table has one
    row per partition and is broadcast; with groups it is joined as the
    planner sees fit (its size grows with the number of groups).
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    groups = list(group_cols or [])
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(g) if isinstance(g, str) else g for g in groups] + list(order_cols)
    ordered = (df.repartitionByRange(n, *keys)
               .sortWithinPartitions(*keys)
               .withColumn("_pid", F.spark_partition_id())
               .withColumn("_mid", F.monotonically_increasing_id()))
    ordered = ordered.checkpoint(eager=True)
    counts = ordered.groupBy("_pid", *groups).agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_m0"))
    w = Window.partitionBy(*groups).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", *groups, "_m0", F.sum("_n").over(w).alias("_off"))
    offsets = F.broadcast(offsets) if not groups else offsets
    local = F.col("_mid") - F.col("_m0")
    return (ordered.join(offsets, ["_pid", *groups])
            .withColumn(out_col, F.coalesce(F.col("_off"), F.lit(0)) + local + F.lit(start))
            .drop("_pid", "_mid", "_off", "_m0"))
