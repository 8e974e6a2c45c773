"""Choosing the distance threshold, the size cap and the crop for grouping.

A sweep joins hashes once, at its largest threshold, and groups all its settings in one run. Settings are few and
each is a small row, so ranking them is a tiny sort.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernlake.operators.groups import distribution_columns, grouped_runs, summary_columns
from fernlake.operators.pairs import distinct_pairs
from fernlake.runtime import Scratch, exchanged, materialize

# What recommendations are measured against.
LARGEST_CLUSTER = 50
PCT_RANGE = (10.0, 50.0)
PCT_BEST = 30.0
PREFERRED_THRESHOLD = 10


def pair_counts(hashed: DataFrame, close: DataFrame) -> DataFrame:
    """``distance, pairs`` of files, counted from hashes without spelling the pairs out."""
    sizes = hashed.groupBy("hash").agg(F.count("*").alias("n"))
    far = close.join(exchanged(sizes.select(F.col("hash").alias("a"), F.col("n").alias("na"))), "a").join(exchanged(sizes.select(F.col("hash").alias("b"), F.col("n").alias("nb"))), "b").select("distance", (F.col("na") * F.col("nb")).alias("k"))
    same = sizes.select(F.lit(0).alias("distance"), F.expr("n * (n - 1) div 2").alias("k"))
    return far.union(same).groupBy("distance").agg(F.sum("k").alias("pairs"))


def sweep(encodings: DataFrame, thresholds: list[int], caps: list[int | None] = (None,), bits: int = 64) -> DataFrame:
    """A row for each threshold and cap: pairs, groups by size and their summary.

    Hashes are joined once, at the largest threshold, and all settings are grouped in one run, on runs of equal hashes
    rather than files. Names with two hashes go by the smaller; files without a hash are groups of their own.
    """
    if not thresholds or not caps:
        raise ValueError("a sweep needs thresholds and caps")
    settings = [(t, c) for t in thresholds for c in caps]
    if any(c is not None and c < 1 for c in caps):
        raise ValueError("the cap is at least 1")
    spark, scratch = encodings.sparkSession, Scratch(encodings.sparkSession)
    files = scratch.keep(encodings.filter("file_name is not null").groupBy("file_name").agg(F.min("hash").alias("hash")), "files")
    hashed = files.filter("hash is not null")
    close = scratch.keep(distinct_pairs(hashed, max(thresholds), bits), "close")
    rows = spark.createDataFrame([(i, t, c) for i, (t, c) in enumerate(settings)], "seq int, threshold int, cap int")
    _, tops = grouped_runs(hashed, settings, close)
    sizes = tops.groupBy("seq", "root").agg(F.sum("weight").alias("size")).select("seq", "size")
    alone = files.filter("hash is null").join(F.broadcast(rows.select("seq"))).select("seq", F.lit(1).cast("long").alias("size"))
    told = sizes.unionByName(alone).groupBy("seq").agg(*summary_columns(), *distribution_columns())
    counted = F.broadcast(rows).join(pair_counts(hashed, close), F.col("distance") <= F.col("threshold")).groupBy("seq").agg(F.sum("pairs").alias("num_duplicate_pairs"))
    found = rows.join(counted, "seq", "left").join(told, "seq", "left").na.fill(0)
    out = found.select(
        "threshold",
        F.element_at(F.lit([c for _, c in settings]).cast("array<int>"), F.col("seq") + 1).alias("cap"),  # null is no 0
        *[c for c in found.columns if c not in ("seq", "threshold", "cap")],
        (F.col("num_groups") - F.col("num_singleton_groups")).alias("num_multi_image_groups"),
        (F.col("largest_group_size") <= LARGEST_CLUSTER).alias("passes_cluster_size_check"),
        "seq",
    )
    made, _ = materialize(out, "sweep")
    scratch.drop()
    return made


def evaluate_setting(encodings: DataFrame, threshold: int, cap: int | None = None, bits: int = 64) -> DataFrame:
    """The one row of a sweep of one setting."""
    return sweep(encodings, [threshold], [cap], bits).drop("seq")


def production_score(results: DataFrame) -> DataFrame:
    """``violations``, ``passes_production_criteria`` and ``production_score`` beside each result."""
    pct = F.col("pct_in_multi_image_groups")
    broken = F.array(
        F.when(F.col("largest_group_size") > LARGEST_CLUSTER, F.format_string("largest_group_size=%d > %d", "largest_group_size", F.lit(LARGEST_CLUSTER))),
        F.when(pct < PCT_RANGE[0], F.format_string("pct_multi=%.1f < %.1f", pct, F.lit(PCT_RANGE[0]))),
        F.when(pct > PCT_RANGE[1], F.format_string("pct_multi=%.1f > %.1f", pct, F.lit(PCT_RANGE[1]))),
        F.when(F.col("num_multi_image_groups") < 1, F.lit("no multi-image groups")),
    )
    judged = results.withColumn("violations", F.array_compact(broken)).withColumn("passes_production_criteria", F.size("violations") == 0)
    score = F.when(F.col("passes_production_criteria"), 0.0).otherwise(-1000.0) - F.col("largest_group_size") * 10 - F.col("groups_size_over_20") * 50 - F.col("groups_size_over_50") * 500 - F.abs(pct - PCT_BEST) + F.col("num_multi_image_groups") * F.lit(0.1)
    return judged.withColumn("production_score", score)


def recommend_production(results: DataFrame) -> DataFrame:
    """The best-scored result that passes, else the best-scored; of equal ones the first of the sweep."""
    return production_score(results).orderBy(F.desc("passes_production_criteria"), F.desc("production_score"), "seq").limit(1)


def recommend_threshold(results: DataFrame, preferred: int = PREFERRED_THRESHOLD) -> DataFrame:
    """Of the results without an oversized cluster (or of all, if each has one) the nearest to ``preferred``, then the largest share, then the smallest cluster."""
    return results.orderBy(F.desc("passes_cluster_size_check"), F.abs(F.col("threshold") - preferred), F.desc("pct_in_multi_image_groups"), "largest_group_size", "seq").limit(1)


def better_variant(swept: dict[str, DataFrame], preferred: int = PREFERRED_THRESHOLD) -> DataFrame:
    """The recommended row of the better of several sweeps, with the sweep's name in ``variant``."""
    rows = [recommend_threshold(rows, preferred).withColumn("variant", F.lit(name)) for name, rows in swept.items()]
    order = [F.desc("passes_cluster_size_check"), F.col("largest_group_size"), F.desc("pct_in_multi_image_groups"), F.desc("variant")]
    return reduce(DataFrame.unionByName, rows).orderBy(*order).limit(1)


def compare_crops(with_crop: DataFrame, no_crop: DataFrame, thresholds: list[int], preferred: int = PREFERRED_THRESHOLD, bits: int = 64) -> DataFrame:
    """The recommended row of the better variant, named in ``variant``, for encodings hashed with and without a crop."""
    return better_variant({v: sweep(e, thresholds, bits=bits) for v, e in (("with_crop", with_crop), ("no_crop", no_crop))}, preferred)
