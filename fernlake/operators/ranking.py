"""Ranks, running sums and suffix maxima over a whole table without a single-task window.

Rows are range-partitioned by the order, written with their partition's number (a range
exchange that runs again may cut elsewhere), and windows run inside partitions. What lies
before or after a partition comes from a table with one row a partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernlake.runtime import exchanged, materialize

PART = "_part"


def ordered_parts(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` with its range partition's number in ``_part``; partitions ascend in ``order``."""
    cut, _ = materialize(df.repartitionByRange(*order).withColumn(PART, F.spark_partition_id()), "ordered")
    return cut


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Rows numbered from 1 in ``order``, which should be total for a reproducible result."""
    cut = ordered_parts(df, order)
    sizes = cut.groupBy(PART).agg(F.count("*").alias("_n"))
    before = sizes.select(PART, F.coalesce(F.sum("_n").over(Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(PART).orderBy(*order))
    return cut.withColumn("_own", own).join(F.broadcast(before), PART).withColumn(name, F.col("_before") + F.col("_own")).drop(PART, "_own", "_before")


def rank_within(df: DataFrame, group: str, order: list[Column], name: str = "rank") -> DataFrame:
    """Rows numbered from 1 within each ``group`` (compared null-safely); a group may span many tasks."""
    ranked = global_rank(df, [F.col(group), *order], "_global")
    first = ranked.groupBy(F.col(group).alias("_group")).agg(F.min("_global").alias("_first"))
    return ranked.join(exchanged(first), F.col(group).eqNullSafe(F.col("_group"))).withColumn(name, F.col("_global") - F.col("_first") + 1).drop("_global", "_first", "_group")
