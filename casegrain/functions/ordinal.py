"""Exact global ordinal without a single-task window.

``row_number() OVER (ORDER BY …)`` with no partition moves every row into
one task.  Instead: range-partition on the order key, sort within
partitions, number rows inside each partition, and add the running count
of the partitions before it.  The offsets table has one row per partition
(a proven size bound), so broadcasting it is safe.  The partitioned rows are
written once and read by both the counts and the result: range bounds are
sampled, so two computations of them could differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casegrain.session import materialize


def exact_ordinal(df: DataFrame, order_cols: list, out: str = "ordinal",
                  total_out: str | None = None, num_partitions: int | None = None) -> DataFrame:
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    tagged = materialize(df.repartitionByRange(n, *cols)
                         .sortWithinPartitions(*cols)
                         .withColumn("_pid", F.spark_partition_id())
                         .withColumn("_mid", F.monotonically_increasing_id()), "ordinal")
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"), F.min("_mid").alias("_base"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_pid", "_base",
        F.coalesce(F.sum("_cnt").over(w), F.lit(0)).alias("_off"),
        F.sum("_cnt").over(Window.partitionBy(F.lit(1))).alias("_total"),
    )
    res = tagged.join(F.broadcast(offsets), "_pid").withColumn(
        out, (F.col("_off") + F.col("_mid") - F.col("_base") + 1).cast("bigint"))
    if total_out:
        res = res.withColumn(total_out, F.col("_total").cast("bigint"))
    return res.drop("_pid", "_mid", "_base", "_off", "_total")


def running_total(df: DataFrame, order_col: str, value_cols: list[str], out_prefix: str = "cum_",
                  num_partitions: int | None = None) -> DataFrame:
    """Inclusive running sums (and running row count) in ``order_col`` order.

    Same two-level scheme as :func:`exact_ordinal`: sums inside each range
    partition, plus the totals of the partitions before it (a table with
    one row per partition, broadcast).  ``order_col`` must be unique.
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tagged = materialize(df.repartitionByRange(n, F.col(order_col))
                         .withColumn("_pid", F.spark_partition_id()), "running")
    inner = Window.partitionBy("_pid").orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    local = tagged.select("*", F.count(F.lit(1)).over(inner).alias("_lc"),
                          *[F.sum(c).over(inner).alias(f"_ls_{c}") for c in value_cols])
    totals = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_tc"),
                                        *[F.sum(c).alias(f"_ts_{c}") for c in value_cols])
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_pid", F.coalesce(F.sum("_tc").over(before), F.lit(0)).alias("_oc"),
                            *[F.coalesce(F.sum(f"_ts_{c}").over(before), F.lit(0)).alias(f"_os_{c}")
                              for c in value_cols])
    res = local.join(F.broadcast(offsets), "_pid")
    res = res.withColumn(f"{out_prefix}count", (F.col("_lc") + F.col("_oc")).cast("bigint"))
    for c in value_cols:
        res = res.withColumn(f"{out_prefix}{c}", F.col(f"_ls_{c}") + F.col(f"_os_{c}"))
    drop = ["_pid", "_lc", "_oc"] + [f"_ls_{c}" for c in value_cols] + [f"_os_{c}" for c in value_cols]
    return res.drop(*drop)
