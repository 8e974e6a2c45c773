"""Seeded samples of names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernlake.functions.names import seeded_order


def sample_names(files: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """At most ``k`` distinct file names in a seeded order: a top-k, nothing is sorted whole."""
    return files.select("file_name").filter("file_name is not null").distinct().orderBy(seeded_order(seed, F.col("file_name")), "file_name").limit(k)


def sample_per_split(splits: DataFrame, k: int = 30, seed: int = 42) -> DataFrame:
    """At most ``k`` files of each split."""
    from pyspark.sql import Window

    order = Window.partitionBy("split").orderBy(seeded_order(seed, F.col("file_name")), "file_name")
    return splits.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= k).select("split", "file_name")
