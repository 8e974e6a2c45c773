"""The runs a user starts: group, split, report, tune, prepare a training folder, evaluate."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernlake.functions.hashes import from_hex, hash_images
from fernlake.functions.names import basename
from fernlake.operators import groups, metrics, pairs, sampling, splits, tuning
from fernlake.sources import artifacts, coco, export

STRATEGIES = ("random", "manifest", "phash_groups")


def encode_images(spark: SparkSession, data_dir: str, out: str, crop: artifacts.HashCrop, recompute: bool = False) -> DataFrame:
    """``file_name, hash_hex`` of the images that have a file; hashes of this crop are kept and only missing ones made and written.

    Kept hashes of files that are gone do not come back.
    """
    images, _, _ = coco.read_coco_dir(spark, data_dir)
    there = coco.available_images(images, coco.list_files(spark, data_dir), data_dir).select(basename(F.col("file_name")).alias("file_name")).distinct()
    path = f"{out}/phash_encodings-{crop.key}"
    kept = None if recompute else artifacts.load_segments(spark, path)
    missing = there if kept is None else there.join(kept, "file_name", "left_anti")
    if kept is not None and missing.isEmpty():
        return kept.join(there, "file_name", "left_semi")
    pixels = coco.read_pixels(spark, data_dir)
    if kept is not None:  # no picture is hashed again; the filter cannot pass the hashing itself
        pixels = pixels.join(missing.select(F.col("file_name").alias("_name")), basename(F.col("image.origin")) == F.col("_name"), "left_semi")
    made = hash_images(pixels, crop.top_frac, crop.bottom_frac, crop.left_frac, crop.right_frac).join(missing, "file_name", "left_semi").dropDuplicates(["file_name"])
    artifacts.add_segment(made, path, {"hash_config": asdict(crop)}, replace=recompute)
    return artifacts.load_segments(spark, path).join(there, "file_name", "left_semi")


def build_duplicate_groups(spark: SparkSession, data_dir: str, out: str | None = None, threshold: int = 10, cap: int | None = 50, crop: artifacts.HashCrop | None = None, recompute: bool = False, encodings: DataFrame | None = None) -> DataFrame:
    """``file_name, group_id``; hashes, pairs, groups, statistics and configuration are saved in ``out``."""
    out, crop = out or f"{data_dir}/metadata", crop or artifacts.HashCrop()
    crop.save(spark, f"{out}/{artifacts.FILES['hash_config']}")
    hashed = (encodings if encodings is not None else encode_images(spark, data_dir, out, crop, recompute)).select("file_name", from_hex(F.col("hash_hex")).alias("hash"))
    artifacts.save_pairs(pairs.similar_pairs(hashed, threshold), f"{out}/{artifacts.FILES['duplicate_pairs']}")
    manifest = groups.group_manifest(groups.build_groups(hashed, threshold, cap or None))
    artifacts.save_table(manifest, f"{out}/group_manifest", {"max_distance_threshold": threshold, "max_group_size": cap})
    manifest = spark.read.parquet(f"{out}/group_manifest")
    artifacts.save_json(spark, groups.group_summary(manifest).first().asDict(), f"{out}/{artifacts.FILES['group_statistics']}")
    artifacts.save_pipeline_config(spark, f"{out}/{artifacts.FILES['pipeline_config']}", {"max_distance_threshold": threshold, "max_group_size": cap, "hash_config": asdict(crop)})
    return manifest


def split_by_groups(spark: SparkSession, data_dir: str, manifest: DataFrame, out: str | None = None, seed: int = 42, train: float = 0.6, val: float = 0.2, export_coco: bool = False) -> DataFrame:
    """``file_name, split``, checked before it is saved; optionally the annotations of each split."""
    out = out or f"{data_dir}/metadata"
    images, annotations, _ = coco.read_coco_dir(spark, data_dir)
    files = images.select(basename(F.col("file_name")).alias("file_name")).filter("file_name <> ''").distinct()
    full = groups.fill_singletons(manifest, files)
    made = splits.split_groups(full, train, val, seed)
    splits.check_split(made, full, files, images, annotations)
    artifacts.save_table(made, f"{out}/split_manifest", {"seed": seed, "train_ratio": train, "val_ratio": val})
    made = spark.read.parquet(f"{out}/split_manifest")
    if export_coco:
        export.write_coco_splits(images, annotations, made, f"{out}/splits")
    artifacts.save_json(spark, splits.split_statistics(images, annotations, made, full).first().asDict(), f"{out}/{artifacts.FILES['split_statistics']}")
    return made


def report_split(spark: SparkSession, data_dir: str, made: DataFrame, manifest: DataFrame, random_trials: int = 0, seed: int = 42) -> dict:
    """Statistics of a split, its class distribution and, for contrast, what splitting single images would leak."""
    images, annotations, _ = coco.read_coco_dir(spark, data_dir)
    manifest = groups.fill_singletons(manifest, made)
    report = splits.split_statistics(images, annotations, made, manifest).first().asDict()
    report["class_distribution"] = [r.asDict() for r in splits.class_distribution(images, annotations, made).orderBy("split", "category").toLocalIterator()]
    if random_trials:
        trials = [r["leaking_groups"] for r in splits.naive_leakage(manifest, seed=seed, trials=random_trials).orderBy("trial").collect()]
        report["random_leakage"] = {"leaking_groups_per_trial": trials, "mean_leaking_groups": sum(trials) / len(trials)}
    return report


def _sampled(encodings: DataFrame, sample: int | None, seed: int) -> DataFrame:
    if sample is None:
        return encodings
    names = sampling.sample_names(encodings, sample, seed)
    return encodings.join(F.broadcast(names) if sample <= 100_000 else names, "file_name", "left_semi")


def tune_threshold(encodings: DataFrame, thresholds: list[int] = (4, 6, 8, 10, 12, 14), sample: int | None = 800, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """The sweep over a seeded sample of hashes, and its recommended row."""
    swept = tuning.sweep(_sampled(encodings, sample, seed), list(thresholds))
    return swept, tuning.recommend_threshold(swept)


def tune_crop(variants: dict[str, DataFrame], thresholds: list[int] = (4, 6, 8, 10, 12, 14), sample: int | None = 800, seed: int = 42) -> tuple[dict[str, DataFrame], DataFrame]:
    """The sweep of each variant's hashes of the same sampled files, and the recommended row of the better variant."""
    swept = {name: tuning.sweep(_sampled(encodings, sample, seed), list(thresholds)) for name, encodings in variants.items()}
    return swept, tuning.better_variant(swept)


def sweep_production(encodings: DataFrame, thresholds: list[int] = (3, 4, 5, 6), caps: list[int | None] = (40, 50, 60)) -> tuple[DataFrame, DataFrame]:
    swept = tuning.sweep(encodings, list(thresholds), list(caps))
    return tuning.production_score(swept), tuning.recommend_production(swept)


def resolve_splits(spark: SparkSession, data_dir: str, strategy: str = "random", train: float = 0.6, val: float = 0.2, seed: int = 42, size: int | None = None, split_path: str | None = None, group_path: str | None = None) -> DataFrame:
    """``file_name, split`` by strategy: shuffled images, a given manifest, or the saved group split.

    With a manifest ``size`` is ignored, all files must be covered, and no group may leak if groups are known.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; there are {', '.join(STRATEGIES)}")
    images, _, _ = coco.read_coco_dir(spark, data_dir)
    files = images.select(basename(F.col("file_name")).alias("file_name")).filter("file_name <> ''").distinct()
    if strategy == "random":
        return splits.random_split(files, train, val, seed, size)
    if strategy == "manifest" and split_path is None:
        raise ValueError("the manifest strategy needs a split manifest")
    if strategy == "phash_groups":
        split_path, group_path = split_path or f"{data_dir}/metadata/split_manifest", group_path or f"{data_dir}/metadata/group_manifest"

    def load(path: str, loader) -> DataFrame:
        if path.endswith(".json"):
            return loader(spark, path)
        found = artifacts.load_table(spark, path)
        if found is None:
            raise FileNotFoundError(f"{path}: build groups and split by them first")
        return found

    made = load(split_path, artifacts.load_splits)
    if group_path is not None:
        splits.check_split(made, load(group_path, artifacts.load_groups), files)
    elif not (missing := splits.uncovered_files(files, made)).isEmpty():
        raise splits.SplitError(f"files without a split: {[r[0] for r in missing.limit(5).collect()]}")
    return made


def prepare_training_folder(spark: SparkSession, data_dir: str, folder: str, single_class: bool = True, class_name: str = "object", copy_images: bool = False, **split_options) -> dict:
    """Labels, images, ``data.yaml`` and a summary in ``folder``, a shared one; labels and images of earlier splits go."""
    made = resolve_splits(spark, data_dir, **split_options)
    images, annotations, categories = coco.read_coco_dir(spark, data_dir)
    rows = export.label_rows(images, annotations, None if single_class else categories)
    there = coco.available_images(images, coco.list_files(spark, data_dir), data_dir)
    counts = {}
    for split in splits.SPLITS:
        own = splits.samples_for_split(there.join(made.select(F.col("file_name").alias("_f")), basename(F.col("file_name")) == F.col("_f"), "left_semi"), made, split)
        export.place_images(own, f"{folder}/images/{split}", copy_images, overwrite=True)
        labelled = rows.join(own.select("image_id"), "image_id", "left_semi")
        export.write_labels(labelled, f"{folder}/labels/{split}", overwrite=True)
        counts[f"{split}_images"] = labelled.count()
    names = [class_name] if single_class else [r["name"] for r in coco.class_map(categories).orderBy("class_index").collect()]
    summary = {"data_dir": data_dir, "output_dir": folder, "data_yaml": export.write_data_yaml(spark, folder, names), "single_class": single_class, "class_names": names, "copy_images": copy_images, **split_options, **counts}
    artifacts.save_json(spark, summary, f"{folder}/split_summary.json")
    return summary


def preview_splits(spark: SparkSession, data_dir: str, made: DataFrame, folder: str, per_split: int = 30, seed: int = 42, copy: bool = False, manifest: DataFrame | None = None, num_groups: int = 10) -> dict:
    """Pictures to look at: ``samples/<split>`` with a seeded sample of each split and, where a ``manifest`` is given,
    ``groups/<split>`` with the first images of its largest groups, named by position and group. What is shown is listed in ``preview_manifest.json``.
    """
    images, _, _ = coco.read_coco_dir(spark, data_dir)
    there = coco.available_images(images, coco.list_files(spark, data_dir), data_dir).select(basename(F.col("file_name")).alias("file_name"), "image_path")
    chosen = sampling.sample_per_split(made, per_split, seed)
    shown: dict = {"data_dir": data_dir, "samples_per_split": per_split, "seed": seed, "samples": {}, "counts": {r["split"]: r["count"] for r in made.groupBy("split").count().collect()}}
    for split in splits.SPLITS:
        own = chosen.filter(F.col("split") == split)
        shown["samples"][split] = sorted(r["file_name"] for r in own.collect())  # at most per_split names
        export.place_images(there.join(own, "file_name"), f"{folder}/samples/{split}", copy, overwrite=True)
    if manifest is not None:
        top = groups.top_groups_per_split(manifest, made, num_groups)
        shown["group_previews"] = {split: [] for split in splits.SPLITS}
        for r in top.orderBy("split", "position").collect():  # at most num_groups rows a split
            shown["group_previews"][r["split"]].append({"group_id": r["group_id"], "size": r["size"], "files": r["files"]})
        named = top.select("split", F.explode("files").alias("file_name"), F.format_string("%03d_%s_", "position", "group_id").alias("before")).join(there, "file_name")
        for split in splits.SPLITS:
            own = named.filter(F.col("split") == split).select(F.concat("before", "file_name").alias("file_name"), "image_path")
            export.place_images(own, f"{folder}/groups/{split}", copy, overwrite=True)
    artifacts.save_json(spark, shown, f"{folder}/preview_manifest.json")
    return shown


def sample_dataset(spark: SparkSession, data_dir: str, folder: str, size: int = 30, seed: int = 42) -> int:
    """A small data set in ``folder``: that many images with a file, their annotations, their files."""
    if size <= 0:
        raise ValueError("a sample has at least one image")
    images, annotations, categories = coco.read_coco_dir(spark, data_dir, coco.SAMPLE_ORDER)
    files = coco.list_files(spark, data_dir)
    there = coco.available_images(images, files, data_dir, sub_path=True)
    there = there.unionByName(coco.available_images(images.join(there, "image_id", "left_anti"), files, data_dir))
    chosen = there.join(sampling.sample_names(there, size, seed), "file_name", "left_semi")
    export.place_images(chosen, f"{folder}/images", copy=True, overwrite=True)
    own = chosen.drop("image_path")
    export.write_coco_document(own, splits.filter_by_image_ids(annotations, own), categories, f"{folder}/annotations.json")
    return own.count()


def evaluate_run(spark: SparkSession, data_dir: str, predictions: DataFrame, split: str = "test", iou_threshold: float = 0.5, nms_threshold: float | None = None, path: str | None = None, **split_options) -> DataFrame:
    """Quality of ``predictions`` on one split; the row is saved as JSON where ``path`` is given."""
    made = resolve_splits(spark, data_dir, **split_options)
    images, annotations, _ = coco.read_coco_dir(spark, data_dir)
    own, boxes = splits.coco_for_split(images, annotations, made, split)
    truths = coco.as_boxes(boxes).withColumnRenamed("ann_idx", "gt_idx")
    summary = metrics.evaluate(own, predictions, truths, iou_threshold, nms_threshold).withColumn("split", F.lit(split))
    if path:
        artifacts.save_evaluation(summary, path)
    return summary
