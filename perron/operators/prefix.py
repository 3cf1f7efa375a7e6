"""Global running sums and row numbers without a single-partition window.

Rows are range-partitioned by their sort key, every partition is summed on its own, and the
per-partition totals (one row per partition, so bounded by the partition count) give each
partition its offset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perron.staging import stage


def prefix_sums(df: DataFrame, keys: Sequence[str], sums: Sequence[str], index: str = "idx") -> DataFrame:
    """Add ``index`` (0-based global position by ``keys``) and, for each column c of ``sums``,
    ``c_before`` (sum over all earlier rows) and ``c_total`` (sum over all rows).

    ``keys`` ought to order rows totally; rows that tie take any order among themselves. Range
    partitioning cuts between different keys only, so a caller with a hot key adds tie columns.
    Sums are BIGINT; nulls count as 0. An empty frame gives an empty frame.
    """
    placed = stage(
        df.repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys]).withColumn("_pid", F.spark_partition_id()),
        "ranged",
    )
    parts = placed.groupBy("_pid").agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(F.coalesce(F.col(c), F.lit(0))).cast("long").alias(f"_t_{c}") for c in sums]
    )
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = parts.select(
        "_pid",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o_n"),
        *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sums],
        *[F.sum(f"_t_{c}").over(whole).alias(f"{c}_total") for c in sums],
    )
    local = Window.partitionBy("_pid").orderBy(*[F.col(k).asc_nulls_first() for k in keys])
    earlier = local.rowsBetween(Window.unboundedPreceding, -1)
    run: list[Column] = [(F.row_number().over(local) - 1).cast("long").alias("_l_n")]
    run += [F.coalesce(F.sum(F.coalesce(F.col(c), F.lit(0))).over(earlier), F.lit(0)).cast("long").alias(f"_l_{c}") for c in sums]
    return (
        placed.select("*", *run)
        .join(F.broadcast(offsets), "_pid")  # one row per partition
        .select(
            *df.columns,
            (F.col("_o_n") + F.col("_l_n")).cast("long").alias(index),
            *[(F.col(f"_o_{c}") + F.col(f"_l_{c}")).cast("long").alias(f"{c}_before") for c in sums],
            *[F.col(f"{c}_total").cast("long").alias(f"{c}_total") for c in sums],
        )
    )
