"""Train, validation and test splits, by group or at random, and what can be wrong with them.

Shuffles order by a hash of seed and key, so any engine reproduces them; ranks are counted
over range partitions, never in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernlake.functions.names import basename, normalized_id, seeded_order
from fernlake.operators.groups import group_summary
from fernlake.operators.ranking import global_rank, rank_within

SPLITS = ("train", "val", "test")


class SplitError(ValueError):
    """A split breaks a rule that must hold before it is saved."""


def check_ratios(train: float, val: float) -> None:
    if train <= 0 or val < 0 or train + val >= 1:
        raise ValueError("train is positive, val not negative, and both together below 1")


def group_counts(n: int, train: float = 0.6, val: float = 0.2) -> tuple[int, int]:
    """Groups for training and validation; the rest is for testing, and one at least unless training takes all."""
    check_ratios(train, val)
    first = max(1, int(train * n)) if n else 0
    second = int(val * n)
    return first, (max(0, n - first - 1) if first + second >= n else second)


def _named(rank: str, train: int, val: int):
    return F.when(F.col(rank) <= train, "train").when(F.col(rank) <= train + val, "val").otherwise("test")


def split_groups(manifest: DataFrame, train: float = 0.6, val: float = 0.2, seed: int = 42) -> DataFrame:
    """``file_name, split``: whole groups, shuffled by ``seed``."""
    check_ratios(train, val)
    ranked = global_rank(manifest.select("group_id").distinct(), [seeded_order(seed, F.col("group_id")), F.col("group_id")])
    counts = group_counts(ranked.count(), train, val)
    return manifest.join(ranked.select("group_id", _named("rank", *counts).alias("split")), "group_id").select("file_name", "split")


def random_split(files: DataFrame, train: float = 0.6, val: float = 0.2, seed: int = 42, size: int | None = None) -> DataFrame:
    """``file_name, split`` of single files, shuffled by ``seed``; ``size`` keeps only the first so many of them."""
    ranked = global_rank(files.select("file_name").filter("file_name is not null").distinct(), [seeded_order(seed, F.col("file_name")), F.col("file_name")])
    n = ranked.count()
    n = n if size is None else min(n, size)
    return ranked.filter(F.col("rank") <= n).select("file_name", _named("rank", int(train * n), int(val * n)).alias("split"))


def downsample_train(splits: DataFrame, manifest: DataFrame, seed: int = 42, max_images_per_group: int = 1) -> DataFrame:
    """The split without the training files of a group beyond its first so many, shuffled by ``seed``."""
    if max_images_per_group < 1:
        raise ValueError("at least one image of a group stays")
    grouped = splits.join(manifest, "file_name")
    rank = F.row_number().over(_window("group_id", [seeded_order(seed, F.col("file_name")), F.col("file_name")]))
    kept = grouped.filter("split = 'train'").withColumn("k", rank).filter(F.col("k") <= max_images_per_group)
    return splits.filter("split <> 'train'").select("file_name", "split").union(kept.select("file_name", "split"))


def _window(partition: str, order: list):
    from pyspark.sql import Window

    return Window.partitionBy(partition).orderBy(*order)


def samples_for_split(samples: DataFrame, splits: DataFrame, split: str) -> DataFrame:
    """Samples of one split by the base name of their file; raises where a sample has no split."""
    named = samples.withColumn("_name", basename(F.col("file_name")))
    found = named.join(splits.select(F.col("file_name").alias("_name"), F.col("split").alias("_split")), "_name", "left")
    known = F.coalesce("_split", F.raise_error(F.concat(F.lit("no split for "), F.coalesce("_name", F.lit("null")))))
    return found.filter(known == split).drop("_name", "_split")


def coco_for_split(images: DataFrame, annotations: DataFrame, splits: DataFrame, split: str) -> tuple[DataFrame, DataFrame]:
    """Images of one split and their annotations, by semi joins."""
    names = splits.filter(F.col("split") == split).select(F.col("file_name").alias("_name"))
    own = images.withColumn("_name", basename(F.col("file_name"))).join(names, "_name", "left_semi").drop("_name")
    return own, filter_by_image_ids(annotations, own)


def filter_by_image_ids(rows: DataFrame, images: DataFrame) -> DataFrame:
    """Rows whose ``image_id`` is one of the images', compared as strings."""
    wanted = images.select(normalized_id(F.col("image_id")).alias("_id")).distinct()
    return rows.withColumn("_id", normalized_id(F.col("image_id"))).join(wanted, "_id", "left_semi").drop("_id")


# checks: each gives the rows that break a rule


def uncovered_files(files: DataFrame, splits: DataFrame) -> DataFrame:
    return files.select("file_name").join(splits, "file_name", "left_anti").distinct()


def leaking_groups(splits: DataFrame, manifest: DataFrame) -> DataFrame:
    """``group_id, splits`` of groups in more than one split; files without a group raise."""
    joined = splits.join(manifest, "file_name", "left")
    group = F.coalesce("group_id", F.raise_error(F.concat(F.lit("no group for "), F.col("file_name"))))
    return joined.select(group.alias("group_id"), "split").groupBy("group_id").agg(F.sort_array(F.collect_set("split")).alias("splits")).filter(F.size("splits") > 1)


def orphan_annotations(annotations: DataFrame, images: DataFrame) -> DataFrame:
    known = images.select(normalized_id(F.col("image_id")).alias("_id"))
    return annotations.withColumn("_id", normalized_id(F.col("image_id"))).join(known, "_id", "left_anti").drop("_id")


def check_split(splits: DataFrame, manifest: DataFrame, files: DataFrame, images: DataFrame | None = None, annotations: DataFrame | None = None, label: str = "all") -> None:
    """Raise ``SplitError`` with the first few offenders of each broken rule."""
    found = [("files without a split", uncovered_files(files, splits)), ("groups in several splits", leaking_groups(splits, manifest)), ("files in several splits", splits.groupBy("file_name").agg(F.count_distinct("split").alias("n")).filter("n > 1"))]
    if images is not None and annotations is not None:
        found.append((f"[{label}] annotations of no image", orphan_annotations(annotations, images)))
    broken = [f"{what}: {[tuple(r) for r in few]}" for what, rows in found if (few := rows.limit(5).collect())]
    if broken:
        raise SplitError("; ".join(broken))


# statistics


def class_distribution(images: DataFrame, annotations: DataFrame, splits: DataFrame) -> DataFrame:
    """``split, category, annotations``; boxes without a category count as ``unknown``.

    Images are known to the split by their base name; of images that share one, the last id counts.
    """
    named = images.select(normalized_id(F.col("image_id")).alias("_id"), basename(F.col("file_name")).alias("file_name")).groupBy("file_name").agg(F.max("_id").alias("_id"))
    placed = named.join(splits, "file_name").select("_id", "split")
    own = annotations.select(normalized_id(F.col("image_id")).alias("_id"), F.coalesce(F.col("category_id").cast("string"), F.lit("unknown")).alias("category"))
    return own.join(placed, "_id").groupBy("split", "category").agg(F.count("*").alias("annotations"))


def per_split(images: DataFrame, annotations: DataFrame, splits: DataFrame, manifest: DataFrame) -> DataFrame:
    """``split, images, annotations, groups`` for all three splits, zero where one is empty."""
    spark = splits.sparkSession
    names = spark.range(1).select(F.explode(F.array(*map(F.lit, SPLITS))).alias("split"))
    counted = splits.join(manifest, "file_name").groupBy("split").agg(F.count("*").alias("images"), F.count_distinct("group_id").alias("groups"))
    boxes = class_distribution(images, annotations, splits).groupBy("split").agg(F.sum("annotations").alias("annotations"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return F.broadcast(names).join(counted, "split", "left").join(boxes, "split", "left").select("split", zero("images"), zero("annotations"), zero("groups"))


def split_statistics(images: DataFrame, annotations: DataFrame, splits: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row: the group summary, counts of each split, and whether no group leaks."""
    parts = per_split(images, annotations, splits, manifest)
    wide = parts.agg(*[F.coalesce(F.max(F.when(F.col("split") == s, F.col(c))), F.lit(0)).alias(f"{c}_{s}") for c in ("images", "annotations", "groups") for s in SPLITS])
    leak = leaking_groups(splits, manifest).agg((F.count("*") == 0).alias("leakage_check_passed"))
    return group_summary(manifest).crossJoin(wide).crossJoin(leak)  # one row each


def naive_leakage(manifest: DataFrame, train: float = 0.6, val: float = 0.2, seed: int = 42, trials: int = 1) -> DataFrame:
    """``trial, leaking_groups, leaking_pct``: groups that a split of single images would tear apart, for each seed from ``seed`` on."""
    spark = manifest.sparkSession
    torn, groups = _torn_groups(manifest, train, val, seed, trials)
    seeds = spark.range(seed, seed + trials).withColumnRenamed("id", "trial")
    counted = torn.groupBy("trial").agg(F.count("*").alias("k"))
    return F.broadcast(seeds).join(counted, "trial", "left").select("trial", F.coalesce("k", F.lit(0)).cast("long").alias("leaking_groups"), (F.lit(100.0) * F.coalesce("k", F.lit(0)) / max(1, groups)).alias("leaking_pct"))


def naive_leakage_examples(manifest: DataFrame, train: float = 0.6, val: float = 0.2, seed: int = 42, examples: int = 5) -> DataFrame:
    """``group_id, splits`` of the first few groups, by id, that a split of single images would tear apart."""
    return _torn_groups(manifest, train, val, seed, 1)[0].orderBy("group_id").limit(examples).select("group_id", "splits")


def files_by_split(splits: DataFrame) -> DataFrame:
    """``split, position, file_name``: each split's files in order of their names, as rows."""
    return rank_within(splits.select("split", "file_name").distinct(), "split", [F.col("file_name")], "position").select("split", "position", "file_name")


def _torn_groups(manifest: DataFrame, train: float, val: float, seed: int, trials: int) -> tuple[DataFrame, int]:
    """``trial, group_id, splits`` of groups in several splits, and the number of all groups."""
    files = manifest.select("file_name", "group_id").distinct()
    n, groups = files.agg(F.count("*"), F.count_distinct("group_id")).first()
    spread = files.withColumn("trial", F.explode(F.sequence(F.lit(seed), F.lit(seed + trials - 1)))).withColumn("trial", F.col("trial").cast("long"))
    ranked = rank_within(spread, "trial", [seeded_order(F.col("trial"), F.col("file_name")), F.col("file_name")])
    placed = ranked.select("trial", "group_id", _named("rank", int(train * n), int(val * n)).alias("split"))
    return placed.groupBy("trial", "group_id").agg(F.sort_array(F.collect_set("split")).alias("splits")).filter(F.size("splits") > 1), groups
