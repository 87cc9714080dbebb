"""Row numbers within a group without sending a whole group to one task.

``Window.partitionBy(g).orderBy(o)`` sorts each group inside one task, so a
session holding a third of all rows becomes a third of the job on one core.
:func:`rank_within` range-partitions by (group, order) instead, so a large
group is split across many partitions; each partition numbers its rows
locally (``monotonically_increasing_id`` after a total-order sort within the
partition is the row's position), and a small per-(group, partition) count
table supplies the offsets.  The offset table has at most one row per
partition a group touches.

The order columns must make the order total (include a unique key).
The numbered rows are checkpointed, which also cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rank_within(df: DataFrame, keys, order, name: str = "rank", partitions: int | None = None) -> DataFrame:
    from ..session import ensure_checkpoint_dir
    keys, order = list(keys), list(order)
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    parted = (df.repartitionByRange(n, *keys, *order)
                .sortWithinPartitions(*keys, *order)
                .withColumn("_pid", F.spark_partition_id())
                .withColumn("_mid", F.monotonically_increasing_id()))
    # Partition ids and positions must be the same for the offset table and
    # the rows it is joined back to; range bounds come from sampling, so the
    # numbered rows are written once (shared checkpoint folder) and reused.
    parted = parted.checkpoint()
    stats = parted.groupBy(*keys, "_pid").agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_cnt"))
    w = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.withColumn("_off", F.coalesce(F.sum("_cnt").over(w), F.lit(0)))
    out = parted.join(stats.select(*keys, "_pid", "_first", "_off"), keys + ["_pid"])
    return out.withColumn(name, (F.col("_off") + F.col("_mid") - F.col("_first") + 1).cast("long")) \
              .drop("_pid", "_mid", "_first", "_off")
