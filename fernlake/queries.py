"""Queries over the driver's tables and their SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernlake import fixtures as fx
from fernlake.functions.boxes import crop_box, normalized
from fernlake.functions.names import basename, stem
from fernlake.operators import detection, groups, metrics, pairs, sampling, splits, tuning
from fernlake.runtime import new_path
from fernlake.sources import artifacts, coco, export

BITS = 16
MATCH_IOU, NMS_IOU = 0.5, 0.3
WINDOW_SIZES, WINDOW_OVERLAP = [384, 640], 0.25
CROP = {"top": 0.06, "bottom": 0.10, "left": 0.0, "right": 0.0}
THRESHOLDS = [0, 1, 2]
DIGITS = 6


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, DIGITS) for c in columns})


def iou_pairs(spark: SparkSession, d: str) -> DataFrame:
    return detection.iou_pairs(fx.predictions(spark, d), fx.truths(spark, d))


def max_iou_per_pred(spark: SparkSession, d: str) -> DataFrame:
    return detection.max_iou_with(fx.predictions(spark, d), fx.truths(spark, d)).select("image_id", "pred_idx", "max_iou")


def mean_iou(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.mean_iou(fx.predictions(spark, d), fx.truths(spark, d)), "mean_iou")


def yolo_norm_boxes(spark: SparkSession, d: str) -> DataFrame:
    boxes = fx.annotations(spark, d).join(fx.images(spark, d), "image_id").withColumn("b", normalized(*map(F.col, ("x", "y", "w", "h", "width", "height"))))
    return boxes.select("image_id", "gt_idx", F.col("b.cx").alias("cx"), F.col("b.cy").alias("cy"), F.col("b.nw").alias("nw"), F.col("b.nh").alias("nh"))


def crop_boxes(spark: SparkSession, d: str) -> DataFrame:
    return fx.images(spark, d).select("image_id", crop_box(F.col("width"), F.col("height"), **CROP).alias("b")).select("image_id", "b.*")


def window_grid(spark: SparkSession, d: str) -> DataFrame:
    return detection.window_grid(fx.images(spark, d), WINDOW_SIZES, WINDOW_OVERLAP)


def samples_left_join(spark: SparkSession, d: str) -> DataFrame:
    found = coco.samples(fx.images(spark, d), fx.annotations(spark, d))
    return found.select("image_id", "file_name", "width", "height", F.size("bboxes").alias("n_boxes"), F.expr("aggregate(bboxes, 0D, (t, b) -> t + b.x2)").alias("sum_x2"))


def _listing(spark: SparkSession, d: str) -> DataFrame:
    kept = fx.images(spark, d).filter("cast(image_id as bigint) % 7 <> 0")
    return kept.selectExpr("concat('/data/images/', file_name) as path").union(kept.filter("cast(image_id as bigint) % 2 = 0").selectExpr("concat('/data/', file_name) as path"))


def available_images_semi(spark: SparkSession, d: str) -> DataFrame:
    return coco.available_images(fx.images(spark, d), _listing(spark, d), "/data").select("image_id", "file_name", "image_path")


def _some_images(spark: SparkSession, d: str) -> DataFrame:
    return fx.images(spark, d).filter("cast(image_id as bigint) % 11 <> 0")


def orphan_annotations_anti(spark: SparkSession, d: str) -> DataFrame:
    return splits.orphan_annotations(fx.annotations(spark, d), _some_images(spark, d)).select("image_id", "gt_idx", "category_id")


def coco_filter(spark: SparkSession, d: str) -> DataFrame:
    return splits.filter_by_image_ids(fx.annotations(spark, d), fx.images(spark, d).filter("cast(image_id as bigint) % 3 = 0")).select("image_id", "gt_idx", "category_id")


def multi_class_map(spark: SparkSession, d: str) -> DataFrame:
    return coco.class_map(fx.categories(spark, d).withColumnRenamed("id", "category_id"))


def hamming_pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairs.similar_pairs(fx.encodings(spark, d, BITS), 2, BITS)


def hamming_pairs_64(spark: SparkSession, d: str) -> DataFrame:
    return pairs.similar_pairs(fx.encodings(spark, d), 16)


def components_uncapped(spark: SparkSession, d: str) -> DataFrame:
    return groups.build_groups(fx.encodings(spark, d, BITS), 1, None, BITS)


def group_manifest(spark: SparkSession, d: str) -> DataFrame:
    return groups.group_manifest(groups.build_groups(fx.encodings(spark, d, BITS), 2, None, BITS))


def group_summary(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(groups.group_summary(fx.groups(spark, d)), "pct_in_multi_image_groups")


def group_size_distribution(spark: SparkSession, d: str) -> DataFrame:
    return groups.size_distribution(fx.groups(spark, d))


def top_groups(spark: SparkSession, d: str) -> DataFrame:
    return groups.top_groups(fx.groups(spark, d)).select("position", "group_id", "size", F.array_join("files", ",").alias("files"))


def top_groups_per_split(spark: SparkSession, d: str) -> DataFrame:
    found = groups.top_groups_per_split(fx.groups(spark, d), splits.random_split(fx.groups(spark, d).select("file_name")), 5, 4)
    return found.select("split", "position", "group_id", "size", F.concat_ws(",", "files").alias("files"))


def group_split(spark: SparkSession, d: str) -> DataFrame:
    return splits.split_groups(fx.groups(spark, d))


def random_split(spark: SparkSession, d: str) -> DataFrame:
    return splits.random_split(fx.groups(spark, d))


def class_distribution(spark: SparkSession, d: str) -> DataFrame:
    return splits.class_distribution(fx.images(spark, d), fx.annotations(spark, d), splits.split_groups(fx.groups(spark, d)))


def per_split(spark: SparkSession, d: str) -> DataFrame:
    g = fx.groups(spark, d)
    return splits.per_split(fx.images(spark, d), fx.annotations(spark, d), splits.split_groups(g), g)


def split_statistics(spark: SparkSession, d: str) -> DataFrame:
    g = fx.groups(spark, d)
    return _rounded(splits.split_statistics(fx.images(spark, d), fx.annotations(spark, d), splits.random_split(g), g), "pct_in_multi_image_groups")


def leaking_groups(spark: SparkSession, d: str) -> DataFrame:
    g = fx.groups(spark, d)
    return splits.leaking_groups(splits.random_split(g), g).select("group_id", F.array_join("splits", ",").alias("splits"))


def naive_leakage_trials(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(splits.naive_leakage(fx.groups(spark, d), trials=3), "leaking_pct")


def downsample_train(spark: SparkSession, d: str) -> DataFrame:
    g = fx.groups(spark, d)
    return splits.downsample_train(splits.split_groups(g), g, max_images_per_group=2)


def coverage_check(spark: SparkSession, d: str) -> DataFrame:
    g = fx.groups(spark, d)
    return splits.uncovered_files(g, splits.random_split(g, size=1000))


def sample_k(spark: SparkSession, d: str) -> DataFrame:
    return sampling.sample_names(fx.images(spark, d), 800)


def sample_per_split(spark: SparkSession, d: str) -> DataFrame:
    return sampling.sample_per_split(splits.split_groups(fx.groups(spark, d)))


SWEEP_COLUMNS = ["threshold", "num_duplicate_pairs", "total_images", "num_groups", "num_singleton_groups", "largest_group_size", "pct_in_multi_image_groups", "num_multi_image_groups", "groups_size_2_5", "groups_size_6_10", "groups_size_11_20", "groups_size_over_20", "groups_size_over_50", "passes_cluster_size_check"]


def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(tuning.sweep(fx.encodings(spark, d, BITS), THRESHOLDS, bits=BITS).select(*SWEEP_COLUMNS), "pct_in_multi_image_groups")


def production_score(spark: SparkSession, d: str) -> DataFrame:
    scored = tuning.production_score(tuning.sweep(fx.encodings(spark, d, BITS), THRESHOLDS, bits=BITS))
    return _rounded(scored.select("threshold", "passes_production_criteria", F.size("violations").alias("n_violations"), "production_score"), "production_score")


def recommend_threshold(spark: SparkSession, d: str) -> DataFrame:
    return tuning.recommend_threshold(tuning.sweep(fx.encodings(spark, d, BITS), THRESHOLDS, bits=BITS)).select("threshold", "largest_group_size")


def recommend_production(spark: SparkSession, d: str) -> DataFrame:
    return tuning.recommend_production(tuning.sweep(fx.encodings(spark, d, BITS), THRESHOLDS, bits=BITS)).select("threshold", "passes_production_criteria")


def capped_groups(spark: SparkSession, d: str) -> DataFrame:
    return groups.build_groups(fx.encodings(spark, d, BITS), 2, 10, BITS)


GRID_COLUMNS = ["threshold", "cap", "num_groups", "largest_group_size", "num_multi_image_groups", "pct_in_multi_image_groups", "passes_production_criteria", "violations", "production_score"]


def production_grid(spark: SparkSession, d: str) -> DataFrame:
    scored = tuning.production_score(tuning.sweep(fx.encodings(spark, d, BITS), [1, 2], [10, 50], BITS))
    return _rounded(scored.withColumn("violations", F.array_join("violations", "; ")).select(*GRID_COLUMNS), "pct_in_multi_image_groups", "production_score")


def nms(spark: SparkSession, d: str) -> DataFrame:
    return detection.suppress(fx.predictions(spark, d), NMS_IOU).select("image_id", "pred_idx")


def greedy_match(spark: SparkSession, d: str) -> DataFrame:
    return metrics.matched(fx.predictions(spark, d), fx.truths(spark, d), MATCH_IOU).select("image_id", "pred_idx", "gt_idx")


def prf(spark: SparkSession, d: str) -> DataFrame:
    truths = fx.truths(spark, d)
    counts = metrics.precision_recall_f1(metrics.image_counts(metrics.matched(fx.predictions(spark, d), truths, MATCH_IOU), truths))
    return _rounded(counts, "precision", "recall", "f1")


def average_precision(spark: SparkSession, d: str) -> DataFrame:
    truths = fx.truths(spark, d)
    rows = metrics.matched(fx.predictions(spark, d), truths, MATCH_IOU)
    return _rounded(metrics.average_precision(rows, truths.count()), "average_precision")


def evaluate_summary(spark: SparkSession, d: str) -> DataFrame:
    found = metrics.evaluate(fx.images(spark, d), fx.predictions(spark, d), fx.truths(spark, d), MATCH_IOU, NMS_IOU)
    return _rounded(found, "precision", "recall", "f1", "mean_iou", "average_precision", "avg_boxes_before_nms", "avg_boxes_after_nms")


def negative_windows(spark: SparkSession, d: str) -> DataFrame:
    return detection.training_crops(fx.images(spark, d), fx.truths(spark, d)).filter("label = 0")


def training_crops(spark: SparkSession, d: str) -> DataFrame:
    """How many crops of each label an image gives, and the sum of their corners."""
    made = detection.training_crops(fx.images(spark, d), fx.truths(spark, d))
    return made.groupBy("image_id", "label").agg(F.count("*").alias("crops"), F.sum(F.expr("x1 + y1 + x2 + y2")).alias("corners"))


def _numbered(spark: SparkSession, d: str) -> DataFrame:
    """A manifest of all files but those whose number ends in seven."""
    return fx.groups(spark, d).filter(~F.col("file_name").endswith("7.jpg"))


def fill_singletons(spark: SparkSession, d: str) -> DataFrame:
    return groups.fill_singletons(_numbered(spark, d), fx.images(spark, d))


def group_members(spark: SparkSession, d: str) -> DataFrame:
    return groups.members(fx.groups(spark, d)).select("group_id", F.array_join("files", ",").alias("files"))


def files_by_split(spark: SparkSession, d: str) -> DataFrame:
    return splits.files_by_split(splits.split_groups(fx.groups(spark, d)))


def naive_leakage_examples(spark: SparkSession, d: str) -> DataFrame:
    return splits.naive_leakage_examples(fx.groups(spark, d)).select("group_id", F.array_join("splits", ",").alias("splits"))


def samples_for_split(spark: SparkSession, d: str) -> DataFrame:
    return splits.samples_for_split(fx.images(spark, d), splits.split_groups(fx.groups(spark, d)), "val").select("image_id", "file_name")


def split_filter(spark: SparkSession, d: str) -> DataFrame:
    _, boxes = splits.coco_for_split(fx.images(spark, d), fx.annotations(spark, d), splits.split_groups(fx.groups(spark, d)), "test")
    return boxes.select("image_id", "gt_idx", "category_id")


def file_stems(spark: SparkSession, d: str) -> DataFrame:
    shown = fx.images(spark, d).select("image_id", F.concat(F.lit("/data/a.b/"), F.replace("file_name", F.lit("_"), F.lit(".")), F.when(F.col("width") > 640, F.lit("/")).otherwise("")).alias("path"))
    return shown.select("image_id", basename(F.col("path")).alias("name"), stem(F.col("path")).alias("stem"))


def yolo_label_folder(spark: SparkSession, d: str) -> DataFrame:
    """The label files of all images, written one file a row, and those with boxes read back."""
    folder = new_path(spark, "labels")
    export.write_labels(export.label_rows(fx.images(spark, d), fx.annotations(spark, d)), folder)
    return export.read_labels(fx.images(spark, d), folder)


def yolo_label_files(spark: SparkSession, d: str) -> DataFrame:
    return export.label_texts(export.label_rows(fx.images(spark, d), fx.annotations(spark, d)))


def _categories(spark: SparkSession, d: str) -> DataFrame:
    return fx.categories(spark, d).withColumnRenamed("id", "category_id")


def label_classes(spark: SparkSession, d: str) -> DataFrame:
    rows = export.label_rows(fx.images(spark, d), fx.annotations(spark, d), _categories(spark, d).filter("category_id <> 30"))
    return rows.select("image_id", F.expr("inline(labels)")).select("image_id", F.col("i").alias("gt_idx"), "label")


def crop_quality(spark: SparkSession, d: str) -> DataFrame:
    scored = fx.predictions(spark, d).selectExpr("pmod(pred_idx, 2) as label", "(score * 1000 - 500) / 125 as logit")
    return _rounded(metrics.crop_quality(scored), "accuracy", "loss")


def _linear(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch.assign(logit=((batch["x1"] * 7 + batch["y1"] * 13 + batch["size"]) % 17 - 8).astype(float))


def window_scores(spark: SparkSession, d: str) -> DataFrame:
    """Windows that a linear scorer rates above the threshold."""
    found = detection.detect_windows(detection.window_grid(fx.images(spark, d), WINDOW_SIZES, WINDOW_OVERLAP), _linear)
    return _rounded(found.select("image_id", "pred_idx", "x1", "y1", "x2", "y2", "score"), "score")


def compare_crops(spark: SparkSession, d: str) -> DataFrame:
    """The better of hashes as they are and hashes without their two lowest bits."""
    hashed = fx.encodings(spark, d, BITS)
    best = tuning.compare_crops(hashed, hashed.withColumn("hash", F.expr("hash & ~3L")), THRESHOLDS, bits=BITS)
    return _rounded(best.select("variant", "threshold", "largest_group_size", "pct_in_multi_image_groups"), "pct_in_multi_image_groups")


# what is written and read again


def coco_document(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of the document that is found first of two in a data folder."""
    folder = new_path(spark, "coco")
    boxes = fx.annotations(spark, d).select("image_id", F.col("gt_idx").alias("ann_idx"), F.array("x", "y", "w", "h").alias("bbox"), "category_id")
    export.write_coco_document(fx.images(spark, d), boxes, _categories(spark, d), f"{folder}/{coco.ANNOTATION_FILES[0]}")
    export.write_coco_document(fx.images(spark, d).limit(0), boxes.limit(0), _categories(spark, d), f"{folder}/{coco.ANNOTATION_FILES[1]}")
    _, found, _ = coco.read_coco_dir(spark, folder)
    return found.select("image_id", "ann_idx", *[F.element_at("bbox", i + 1).alias(c) for i, c in enumerate("xywh")], "category_id")


def coco_sample_order(spark: SparkSession, d: str) -> DataFrame:
    """Images of the document that the sample order finds first, and the names of its categories."""
    folder = new_path(spark, "coco")
    none = fx.annotations(spark, d).select("image_id", F.array("x", "y", "w", "h").alias("bbox"), "category_id").limit(0)
    export.write_coco_document(fx.images(spark, d), none, _categories(spark, d), f"{folder}/{coco.SAMPLE_ORDER[0]}")
    export.write_coco_document(fx.images(spark, d).limit(0), none, _categories(spark, d).limit(0), f"{folder}/{coco.SAMPLE_ORDER[2]}")
    found, _, named = coco.read_coco_dir(spark, folder, coco.SAMPLE_ORDER)
    return found.select("image_id", "file_name", "width", "height").join(F.broadcast(named.agg(F.count("*").alias("categories"))))


def coco_split_documents(spark: SparkSession, d: str) -> DataFrame:
    """Boxes by split, read from the document of each."""
    boxes = fx.annotations(spark, d).select("image_id", F.col("gt_idx").alias("ann_idx"), F.array("x", "y", "w", "h").alias("bbox"), "category_id")
    paths = export.write_coco_split_documents(fx.images(spark, d), boxes, _categories(spark, d), splits.split_groups(fx.groups(spark, d)), new_path(spark, "coco"))
    found = [coco.read_coco(spark, path)[1].select(F.lit(split).alias("split"), "image_id", "ann_idx", "category_id") for split, path in paths.items()]
    return found[0].union(found[1]).union(found[2])


def group_manifest_file(spark: SparkSession, d: str) -> DataFrame:
    path = f"{new_path(spark, 'manifest')}/{artifacts.FILES['group_manifest']}"
    artifacts.save_manifest(fx.groups(spark, d), path, "groups")
    return artifacts.load_groups(spark, path)


def split_manifest_file(spark: SparkSession, d: str) -> DataFrame:
    path = f"{new_path(spark, 'manifest')}/{artifacts.FILES['split_manifest']}"
    artifacts.save_manifest(splits.split_groups(fx.groups(spark, d)), path, "splits", metadata={"seed": 42})
    return artifacts.load_splits(spark, path)


def encodings_file(spark: SparkSession, d: str) -> DataFrame:
    path = f"{new_path(spark, 'encodings')}/{artifacts.FILES['phash_encodings']}"
    artifacts.save_manifest(fx.encodings(spark, d).select("file_name", F.lower(F.lpad(F.hex("hash"), 16, "0")).alias("hash_hex")), path, "encodings")
    return artifacts.load_encodings(spark, path)


def pairs_file(spark: SparkSession, d: str) -> DataFrame:
    path = f"{new_path(spark, 'pairs')}/{artifacts.FILES['duplicate_pairs']}"
    artifacts.save_pairs(pairs.similar_pairs(fx.encodings(spark, d, BITS), 2, BITS), path)
    return artifacts.load_pairs(spark, path)


def hash_config_file(spark: SparkSession, d: str) -> DataFrame:
    """A crop by the shares of small and large images, read back from its file, and what the file holds."""
    path = f"{new_path(spark, 'config')}/{artifacts.FILES['hash_config']}"
    small, large = fx.images(spark, d).agg(*[F.round(F.avg((F.col("width") == w).cast("int")) / 10, DIGITS) for w in (640, 2048)]).first()
    artifacts.HashCrop(small, large, 0.05, 0.0).save(spark, path)
    crop, raw = artifacts.HashCrop.load(spark, path), artifacts.load_json(spark, path)
    return spark.range(1).select(*[F.lit(getattr(crop, f)).alias(f) for f in ("top_frac", "bottom_frac", "left_frac", "right_frac")], F.lit(raw["hash_backend"]).alias("hash_backend"), F.lit(raw["pipeline_version"]).alias("pipeline_version"), F.lit("created_at" in raw).alias("stamped"))


def pipeline_config_file(spark: SparkSession, d: str) -> DataFrame:
    """A configuration after two updates with what the groups come to, and the artifacts that are found beside it."""
    folder = new_path(spark, "config")
    path = f"{folder}/{artifacts.FILES['pipeline_config']}"
    summary = group_summary(spark, d).first()
    first = artifacts.save_pipeline_config(spark, path, {"num_groups": 0, "cap": summary["largest_group_size"]})
    artifacts.save_pipeline_config(spark, path, {"num_groups": summary["num_groups"]})
    kept = artifacts.load_json(spark, path)
    there = ",".join(sorted(artifacts.artifact_map(spark, folder)))
    return spark.range(1).select(F.lit(kept["num_groups"]).cast("long").alias("num_groups"), F.lit(kept["cap"]).cast("long").alias("cap"), F.lit(kept["created_at"] == first["created_at"]).alias("first_stamp_kept"), F.lit(kept["updated_at"] >= first["updated_at"]).alias("last_stamp_moved"), F.lit(there).alias("artifacts"))


def evaluation_file(spark: SparkSession, d: str) -> DataFrame:
    path = f"{new_path(spark, 'evaluation')}/evaluation.json"
    artifacts.save_evaluation(prf(spark, d), path)
    return spark.read.schema("evaluated_at string, tp long, fp long, fn long, precision double, recall double, f1 double").json(path, multiLine=True).select("tp", "fp", "fn", "precision", "recall", "f1", F.col("evaluated_at").isNotNull().alias("stamped"))


def metric_rows(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of two runs, appended and read again."""
    path = new_path(spark, "metrics")
    summary = group_summary(spark, d).first().asDict()
    artifacts.append_metrics(spark, path, "a", {"num_groups": summary["num_groups"], "note": "first", "passed": True})
    artifacts.append_metrics(spark, path, "b", {"largest": summary["largest_group_size"]})
    return spark.read.parquet(path).select("run_id", "key", "value_double", "value_string")


QUERIES = {f.__name__: f for f in (
    iou_pairs, max_iou_per_pred, mean_iou, yolo_norm_boxes, crop_boxes, window_grid, samples_left_join, available_images_semi,
    orphan_annotations_anti, coco_filter, multi_class_map, hamming_pairs, hamming_pairs_64, components_uncapped, group_manifest,
    group_summary, group_size_distribution, top_groups, top_groups_per_split, group_split, random_split, class_distribution, per_split, split_statistics,
    leaking_groups, naive_leakage_trials, downsample_train, coverage_check, sample_k, sample_per_split, threshold_sweep,
    production_score, recommend_threshold, recommend_production, capped_groups, production_grid, nms, greedy_match, prf,
    average_precision, evaluate_summary, negative_windows, training_crops, fill_singletons, group_members, files_by_split,
    naive_leakage_examples, samples_for_split, split_filter, file_stems, yolo_label_files, yolo_label_folder, label_classes, crop_quality, window_scores,
    compare_crops, coco_document, coco_sample_order, coco_split_documents, group_manifest_file, split_manifest_file, encodings_file,
    pairs_file, hash_config_file, pipeline_config_file, evaluation_file, metric_rows,
)}


# SQL


def _area(b: str) -> str:
    return f"(greatest(0, {b}x2 - {b}x1) * greatest(0, {b}y2 - {b}y1))"


def _inter(a: str, b: str) -> str:
    return f"(greatest(0, least({a}x2, {b}x2) - greatest({a}x1, {b}x1)) * greatest(0, least({a}y2, {b}y2) - greatest({a}y1, {b}y1)))"


def _iou(a: str, b: str) -> str:
    union = f"({_area(a)} + {_area(b)} - {_inter(a, b)})"
    return f"(case when {union} <= 0 then 0.0::double else {_inter(a, b)}::double / {union} end)"


_BOXES = f"{fx.SQL_TRUTHS}, {fx.SQL_PREDICTIONS}"
_KEPT = f"""ranked as (select *, row_number() over (partition by image_id order by score desc, pred_idx) as k from predictions),
st as (
  select image_id, 0::bigint as k, []::struct(x1 double, y1 double, x2 double, y2 double, i int, s double)[] as kept from (select distinct image_id from predictions)
  union all
  select st.image_id, st.k + 1,
         case when exists (select 1 from (select unnest(st.kept) as e) a where {_iou("a.e.", "n.")} > {NMS_IOU}::double) then st.kept
              else list_append(st.kept, {{'x1': n.x1, 'y1': n.y1, 'x2': n.x2, 'y2': n.y2, 'i': n.pred_idx, 's': n.score}}) end
  from st join ranked n on n.image_id = st.image_id and n.k = st.k + 1),
kept as (select image_id, unnest(arg_max(kept, k)) as e from st group by image_id)"""


def _matched(source: str) -> str:
    """Recursive matching over ``source`` (predictions) and ``truths``; gives ``hits(image_id, pred_idx, score, gt_idx)``."""
    return f"""
order_m as (select *, row_number() over (partition by image_id order by score desc, pred_idx) as k from {source}),
cand as (
  select p.image_id, p.k, any_value(p.pred_idx) as pred_idx, any_value(p.score) as score,
         list(g.gt_idx order by v desc, g.gt_idx) filter (v >= {MATCH_IOU}) as cs
  from (select p.*, g.gt_idx as gg, case when g.gt_idx is null then null else {_iou("p.", "g.")} end as v from order_m p left join truths g on g.image_id = p.image_id) p
  left join truths g on g.image_id = p.image_id and g.gt_idx = p.gg
  group by p.image_id, p.k),
mt as (
  select image_id, 0::bigint as k, []::int[] as used, null::int as got from (select distinct image_id from {source})
  union all
  select mt.image_id, c.k, case when w is null then mt.used else list_append(mt.used, w) end, w
  from mt join (select * from cand) c on c.image_id = mt.image_id and c.k = mt.k + 1,
       lateral (select list_filter(coalesce(c.cs, []::int[]), lambda e: not list_contains(mt.used, e))[1] as w) z),
hits as (select c.image_id, c.pred_idx, c.score, mt.got as gt_idx from mt join cand c on c.image_id = mt.image_id and c.k = mt.k where mt.k > 0)"""


_COUNTS = """counts as (select (select count(gt_idx) from hits) as tp, (select count(*) - count(gt_idx) from hits) as fp, (select count(*) from truths) - (select count(gt_idx) from hits) as fn),
rated as (select tp, fp, fn, coalesce(tp / nullif(tp + fp, 0)::double, 0) as precision, coalesce(tp / nullif(tp + fn, 0)::double, 0) as recall from counts)"""
_F1 = "coalesce(2 * precision * recall / nullif(precision + recall, 0), 0)"
_AP = """steps as (
  select gt_idx, row_number() over w as n, count(gt_idx) over w as k from hits window w as (order by score desc, image_id, pred_idx rows unbounded preceding)),
tops as (select max(k / n::double) over (order by n rows between current row and unbounded following) as best from steps where gt_idx is not null),
ap as (select coalesce(sum(best), 0) / greatest(1, (select count(*) from truths)) as average_precision from tops)"""


def _order(key: str, seed: str = "42") -> str:
    return f"md5({seed} || ':' || {key}), {key}"


_RANDOM = f"""ranked as (select file_name, row_number() over (order by {_order("file_name")}) as r, count(*) over () as n from (select distinct file_name from groups)),
splits as (select file_name, case when r <= trunc(0.6::double * n) then 'train' when r <= trunc(0.6::double * n) + trunc(0.2::double * n) then 'val' else 'test' end as split from ranked)"""
_GROUPED = f"""ids as (select group_id, row_number() over (order by {_order("group_id")}) as r, count(*) over () as n from (select distinct group_id from groups)),
sized as (select *, greatest(1, trunc(0.6::double * n)) as a, trunc(0.2::double * n) as b0 from ids),
placed as (select *, case when a + b0 >= n then greatest(0, n - a - 1) else b0 end as b from sized),
splits as (select g.file_name, case when r <= a then 'train' when r <= a + b then 'val' else 'test' end as split from groups g join placed using (group_id))"""
_SUMMARY = """sizes as (select group_id, count(*) as size from groups group by group_id),
summary as (select coalesce(sum(size), 0)::bigint as total_images, count(*) as num_groups, count(*) filter (size = 1) as num_singleton_groups, coalesce(max(size), 0) as largest_group_size,
       coalesce(100.0::double * sum(case when size > 1 then size else 0 end) / nullif(sum(size), 0), 0) as pct_in_multi_image_groups from sizes)"""
_PLACED_BOXES = "boxes as (select s.split, a.category_id from annotations a join images i using (image_id) join splits s using (file_name))"
_PAIRS = "pairs as (select a.file_name as left_name, b.file_name as right_name, bit_count(xor(a.hash, b.hash))::int as distance from encodings a join encodings b on a.file_name < b.file_name)"


def _components(limit: int) -> str:
    return f"""linked as (select left_name as n, right_name as m from pairs where distance <= {limit} union all select right_name, left_name from pairs where distance <= {limit}),
cc as (select file_name as n, file_name as m from encodings union select cc.n, b.m from cc join linked b on b.n = cc.m),
rooted as (select n as file_name, min(m) as root from cc group by n)"""


def _sweep(encodings: str) -> str:
    return f"""{encodings}, {_PAIRS}, ts as (select unnest({THRESHOLDS}) as t),
linked as (select t, left_name as n, right_name as m from pairs, ts where distance <= t union all select t, right_name, left_name from pairs, ts where distance <= t),
cc as (select t, file_name as n, file_name as m from encodings, ts union select cc.t, cc.n, b.m from cc join linked b on b.t = cc.t and b.n = cc.m),
rooted as (select t, n, min(m) as root from cc group by t, n),
sizes as (select t, root, count(*) as size from rooted group by t, root),
sweep as (
  select t::int as threshold, (select count(*) from pairs where distance <= t) as num_duplicate_pairs, sum(size)::bigint as total_images, count(*) as num_groups,
         count(*) filter (size = 1) as num_singleton_groups, max(size) as largest_group_size,
         100.0::double * sum(case when size > 1 then size else 0 end) / sum(size) as pct_in_multi_image_groups,
         count(*) filter (size > 1) as num_multi_image_groups, count(*) filter (size between 2 and 5) as groups_size_2_5,
         count(*) filter (size between 6 and 10) as groups_size_6_10, count(*) filter (size between 11 and 20) as groups_size_11_20,
         count(*) filter (size > 20) as groups_size_over_20, count(*) filter (size > 50) as groups_size_over_50, max(size) <= 50 as passes_cluster_size_check
  from sizes group by t),
judged as (
  select *, (largest_group_size > 50)::int + (pct_in_multi_image_groups < 10)::int + (pct_in_multi_image_groups > 50)::int + (num_multi_image_groups < 1)::int as n_violations from sweep),
scored as (
  select *, n_violations = 0 as passes_production_criteria,
         (case when n_violations = 0 then 0 else -1000 end)::double - largest_group_size * 10 - groups_size_over_20 * 50 - groups_size_over_50 * 500
         - abs(pct_in_multi_image_groups - 30) + num_multi_image_groups * 0.1::double as production_score
  from judged)"""


_SWEEP = _sweep(fx.sql_encodings(BITS))
_BEST = "select threshold, largest_group_size, pct_in_multi_image_groups, passes_cluster_size_check from sweep order by passes_cluster_size_check desc, abs(threshold - 10), pct_in_multi_image_groups desc, largest_group_size limit 1"
# merging in order: labels of all files in a list, one pair a step; a merge beyond the cap is passed over
_LABELS = f"""{fx.sql_encodings(BITS)}, {_PAIRS},
ids as (select file_name, row_number() over (order by file_name) as i from encodings),
op as (select row_number() over (order by distance, left_name, right_name) as k, distance, a.i as a, b.i as b from pairs join ids a on a.file_name = left_name join ids b on b.file_name = right_name where distance <= 2)"""


def _capped(settings: str) -> str:
    return f"""{_LABELS}, settings as ({settings}),
st as (
  select threshold, cap, 0::bigint as k, (select list(i order by i) from ids) as l from settings
  union all
  select st.threshold, st.cap, st.k + 1,
         case when l[op.a] <> l[op.b] and len(list_filter(l, lambda x: x = l[op.a] or x = l[op.b])) <= st.cap
              then list_transform(l, lambda x: case when x = l[op.b] then l[op.a] else x end) else l end
  from st join op on op.k = st.k + 1 and op.distance <= st.threshold),
ended as (select threshold, cap, arg_max(l, k) as l from st group by all),
labelled as (select threshold, cap, file_name, l[i] as label from ended, ids),
rooted as (select *, min(file_name) over (partition by threshold, cap, label) as root from labelled)"""


_GRID = f"""{_capped("select t::int as threshold, c::int as cap from (select unnest([1, 2]) as t) a, (select unnest([10, 50]) as c) b")},
sizes as (select threshold, cap, root, count(*) as size from rooted group by all),
grid as (
  select threshold, cap, count(*) as num_groups, max(size) as largest_group_size, count(*) filter (size > 1) as num_multi_image_groups,
         100.0::double * sum(case when size > 1 then size else 0 end) / sum(size) as pct, count(*) filter (size > 20) as over_20, count(*) filter (size > 50) as over_50
  from sizes group by all),
judged as (
  select *, concat_ws('; ', case when largest_group_size > 50 then printf('largest_group_size=%d > 50', largest_group_size) end, case when pct < 10 then printf('pct_multi=%.1f < 10.0', pct) end,
                      case when pct > 50 then printf('pct_multi=%.1f > 50.0', pct) end, case when num_multi_image_groups < 1 then 'no multi-image groups' end) as violations from grid)"""
_CROPS = f"""{fx.SQL_TRUTHS}, {fx.SQL_IMAGES},
owned as (select image_id, any_value(width) as width, any_value(height) as height, list({{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}) as g from truths join images using (image_id) group by image_id),
slots as (select *, unnest(range(0, 3 * len(g))) as slot from owned)"""


def _tries(name: str, source: str, low: int, high: int) -> str:
    """The first of some tries of each slot that fits."""
    digits = lambda n: f"('0x' || substr(h, {1 + 7 * n}, 7))::bigint"
    return f"""{name}_h as (select *, md5('42:' || image_id || ':' || slot || ':' || t) as h from (select *, unnest(range({low}, {high + 1})) as t from {source})),
{name}_s as (select *, [64, 128, 256][{digits(0)} % 3 + 1]::bigint as side from {name}_h),
{name}_c as (select *, ({digits(1)} % greatest(1, width - side))::double as x1, ({digits(2)} % greatest(1, height - side))::double as y1 from {name}_s where side < width and side < height),
{name}_b as (select *, x1 + side as x2, y1 + side as y2 from {name}_c),
{name} as (
  select image_id, slot, arg_min({{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}, t) as c from {name}_b n
  where not exists (select 1 from (select unnest(n.g) as e) b where {_iou("b.e.", "n.")} >= 0.2::double) group by all)"""


_NEGATIVE = f"""{_CROPS}, {_tries("early", "slots", 1, 6)}, unfilled as (select * from slots anti join early using (image_id, slot)), {_tries("late", "unfilled", 7, 100)},
negative as (select image_id, 0 as label, c.x1 as x1, c.y1 as y1, c.x2 as x2, c.y2 as y2 from (select * from early union all select * from late))"""
_LINE = "gt_idx, printf('0 %.6f %.6f %.6f %.6f', cx, cy, nw, nh) as line"

_EVAL = f"with recursive {_BOXES}, {fx.SQL_IMAGES}, {_KEPT}, kept_rows as (select image_id, e.i as pred_idx, e.s as score, e.x1 as x1, e.y1 as y1, e.x2 as x2, e.y2 as y2 from kept), {_matched('kept_rows')}, {_COUNTS}, {_AP}"


def _mean_iou(source: str) -> str:
    return f"(select coalesce(avg(b), 0) from (select coalesce(max({_iou('p.', 'g.')}), 0) as b from truths g left join {source} p on p.image_id = g.image_id group by g.image_id, g.gt_idx))"


def _r(name: str, sql: str | None = None) -> str:
    return f"round({sql or name}, {DIGITS}) as {name}"


_UNIT = "least(greatest({0}, 0.0::double), 1.0::double)"
_WINDOWS = " union all ".join(
    f"select image_id, {s} as size, x.x::int as x1, y.y::int as y1, (x.x + {s})::int as x2, (y.y + {s})::int as y2 from images, "
    f"lateral (select unnest(range(0, width - {s} + 1, {max(1, int(s * (1 - WINDOW_OVERLAP)))})) as x) x, lateral (select unnest(range(0, height - {s} + 1, {max(1, int(s * (1 - WINDOW_OVERLAP)))})) as y) y"
    for s in WINDOW_SIZES
)

_LABEL_TEXTS = f"""with {fx.SQL_ANNOTATIONS}, {fx.SQL_IMAGES},
        boxes as (select image_id, gt_idx, {_UNIT.format('(x + w / 2) / width')} as cx, {_UNIT.format('(y + h / 2) / height')} as cy, {_UNIT.format('w / width')} as nw, {_UNIT.format('h / height')} as nh from annotations join images using (image_id)),
        texts as (select image_id, string_agg(line || chr(10), '' order by gt_idx) as text from (select image_id, {_LINE} from boxes) group by image_id)
        select {{}}, coalesce(text, '') as text from images left join texts using (image_id)"""

ORACLES = {
    "iou_pairs": f"with {_BOXES} select p.image_id, pred_idx, gt_idx, {_iou('p.', 'g.')} as iou from predictions p join truths g on g.image_id = p.image_id",
    "max_iou_per_pred": f"with {_BOXES} select p.image_id, pred_idx, coalesce(max({_iou('p.', 'g.')}), 0) as max_iou from predictions p left join truths g on g.image_id = p.image_id group by p.image_id, pred_idx",
    "mean_iou": f"with {_BOXES} select {_r('mean_iou', _mean_iou('predictions'))}",
    "yolo_norm_boxes": f"with {fx.SQL_ANNOTATIONS}, {fx.SQL_IMAGES} select a.image_id, gt_idx, {_UNIT.format('(x + w / 2) / width')} as cx, {_UNIT.format('(y + h / 2) / height')} as cy, {_UNIT.format('w / width')} as nw, {_UNIT.format('h / height')} as nh from annotations a join images i using (image_id)",
    "crop_boxes": f"with {fx.SQL_IMAGES} select image_id, " + ", ".join(f"round_even({side} * {share}::double, 0)::int as {c}" for c, side, share in (("x1", "width", CROP["left"]), ("y1", "height", CROP["top"]), ("x2", "width", 1 - CROP["right"]), ("y2", "height", 1 - CROP["bottom"]))) + " from images",
    "window_grid": f"with {fx.SQL_IMAGES} {_WINDOWS}",
    "samples_left_join": f"with {fx.SQL_TRUTHS}, {fx.SQL_IMAGES} select i.image_id, file_name, width, height, count(gt_idx)::int as n_boxes, coalesce(sum(x2), 0) as sum_x2 from images i left join truths t on t.image_id = i.image_id group by all",
    "available_images_semi": f"with {fx.SQL_IMAGES} select image_id, file_name, '/data/images/' || file_name as image_path from images where image_id::bigint % 7 <> 0",
    "orphan_annotations_anti": f"with {fx.SQL_ANNOTATIONS}, {fx.SQL_IMAGES} select image_id, gt_idx, category_id from annotations where image_id not in (select image_id from images where image_id::bigint % 11 <> 0)",
    "coco_filter": f"with {fx.SQL_ANNOTATIONS}, {fx.SQL_IMAGES} select image_id, gt_idx, category_id from annotations where image_id in (select image_id from images where image_id::bigint % 3 = 0)",
    "multi_class_map": f"with {fx.SQL_CATEGORIES} select id as category_id, name, (row_number() over (order by id) - 1)::int as class_index from categories",
    "hamming_pairs": f"with {fx.sql_encodings(BITS)}, {_PAIRS} select * from pairs where distance <= 2",
    "hamming_pairs_64": f"with {fx.sql_encodings(64)}, {_PAIRS} select * from pairs where distance <= 16",
    "components_uncapped": f"with recursive {fx.sql_encodings(BITS)}, {_PAIRS}, {_components(1)} select * from rooted",
    "group_manifest": f"with recursive {fx.sql_encodings(BITS)}, {_PAIRS}, {_components(2)} select file_name, printf('group_%06d', dense_rank() over (order by root)) as group_id from rooted",
    "group_summary": f"with {fx.SQL_GROUPS}, {_SUMMARY} select * replace ({_r('pct_in_multi_image_groups')}) from summary",
    "group_size_distribution": f"with {fx.SQL_GROUPS}, {_SUMMARY} select count(*) filter (size between 2 and 5) as groups_size_2_5, count(*) filter (size between 6 and 10) as groups_size_6_10, count(*) filter (size between 11 and 20) as groups_size_11_20, count(*) filter (size > 20) as groups_size_over_20, count(*) filter (size > 50) as groups_size_over_50 from sizes",
    "top_groups": f"with {fx.SQL_GROUPS}, {_SUMMARY}, top as (select *, row_number() over (order by size desc, group_id)::int as position from sizes where size > 1 qualify position <= 10), files as (select *, row_number() over (partition by group_id order by file_name) as k from groups join top using (group_id)) select position, group_id, size, string_agg(file_name, ',' order by file_name) as files from files where k <= 6 group by all",
    "top_groups_per_split": f"""with {fx.SQL_GROUPS}, {_RANDOM}, own as (select split, group_id, file_name from groups join splits using (file_name)),
        top as (select split, group_id, count(*) as size, row_number() over (partition by split order by count(*) desc, group_id)::int as position from own group by split, group_id having count(*) > 1 qualify position <= 5),
        files as (select *, row_number() over (partition by split, group_id order by file_name) as k from own join top using (split, group_id))
        select split, position, group_id, size, string_agg(file_name, ',' order by file_name) as files from files where k <= 4 group by all""",
    "group_split": f"with {fx.SQL_GROUPS}, {_GROUPED} select * from splits",
    "random_split": f"with {fx.SQL_GROUPS}, {_RANDOM} select * from splits",
    "class_distribution": f"with {fx.SQL_GROUPS}, {_GROUPED}, {fx.SQL_ANNOTATIONS}, {fx.SQL_IMAGES}, {_PLACED_BOXES} select split, category_id::varchar as category, count(*) as annotations from boxes group by all",
    "per_split": f"with {fx.SQL_GROUPS}, {_GROUPED}, {fx.SQL_ANNOTATIONS}, {fx.SQL_IMAGES}, {_PLACED_BOXES} select split, count(*) as images, (select count(*) from boxes b where b.split = s.split) as annotations, count(distinct group_id) as groups from splits s join groups using (file_name) group by split",
    "split_statistics": f"with {fx.SQL_GROUPS}, {_RANDOM}, {fx.SQL_ANNOTATIONS}, {fx.SQL_IMAGES}, {_PLACED_BOXES}, {_SUMMARY} select * replace ({_r('pct_in_multi_image_groups')}), "
    + ", ".join(f"(select count(*) from splits where split = '{s}') as images_{s}, (select count(*) from boxes where split = '{s}') as annotations_{s}, (select count(distinct group_id) from splits join groups using (file_name) where split = '{s}') as groups_{s}" for s in splits.SPLITS)
    + ", not exists (select 1 from splits join groups using (file_name) group by group_id having count(distinct split) > 1) as leakage_check_passed from summary",
    "leaking_groups": f"with {fx.SQL_GROUPS}, {_RANDOM} select group_id, string_agg(distinct split, ',' order by split) as splits from splits join groups using (file_name) group by group_id having count(distinct split) > 1",
    "naive_leakage_trials": f"""with {fx.SQL_GROUPS}, trials as (select 42 + range as trial from range(3)), n as (select count(*) as n, count(distinct group_id) as g from groups),
        ranked as (select trial, group_id, row_number() over (partition by trial order by md5(trial || ':' || file_name), file_name) as r from groups, trials),
        placed as (select trial, group_id, case when r <= trunc(0.6::double * n) then 'train' when r <= trunc(0.6::double * n) + trunc(0.2::double * n) then 'val' else 'test' end as split from ranked, n),
        torn as (select trial, group_id from placed group by all having count(distinct split) > 1)
        select trial, count(*) as leaking_groups, round(100.0::double * count(*) / (select g from n), {DIGITS}) as leaking_pct from torn group by trial""",
    "downsample_train": f"with {fx.SQL_GROUPS}, {_GROUPED}, k as (select s.*, row_number() over (partition by group_id order by {_order('file_name')}) as k from splits s join groups using (file_name) where split = 'train') select file_name, split from splits where split <> 'train' union all select file_name, split from k where k <= 2",
    "coverage_check": f"with {fx.SQL_GROUPS}, {_RANDOM} select file_name from ranked where r > 1000",
    "sample_k": f"with {fx.SQL_IMAGES} select file_name from images order by {_order('file_name')} limit 800",
    "sample_per_split": f"with {fx.SQL_GROUPS}, {_GROUPED} select split, file_name from splits qualify row_number() over (partition by split order by {_order('file_name')}) <= 30",
    "threshold_sweep": f"with recursive {_SWEEP} select {', '.join(SWEEP_COLUMNS)} from (select * replace ({_r('pct_in_multi_image_groups')}) from sweep)",
    "production_score": f"with recursive {_SWEEP} select threshold, passes_production_criteria, n_violations, {_r('production_score')} from scored",
    "recommend_threshold": f"with recursive {_SWEEP} select threshold, largest_group_size from sweep order by passes_cluster_size_check desc, abs(threshold - 10), pct_in_multi_image_groups desc, largest_group_size limit 1",
    "recommend_production": f"with recursive {_SWEEP} select threshold, passes_production_criteria from scored order by passes_production_criteria desc, production_score desc, threshold limit 1",
    "nms": f"with recursive {_BOXES}, {_KEPT} select image_id, e.i as pred_idx from kept",
    "greedy_match": f"with recursive {_BOXES}, {_matched('predictions')} select image_id, pred_idx, gt_idx from hits",
    "prf": f"with recursive {_BOXES}, {_matched('predictions')}, {_COUNTS} select tp, fp, fn, {_r('precision')}, {_r('recall')}, {_r('f1', _F1)} from rated",
    "average_precision": f"with recursive {_BOXES}, {_matched('predictions')}, {_AP} select {_r('average_precision')} from ap",
    "evaluate_summary": f"{_EVAL} select tp, fp, fn, {_r('precision')}, {_r('recall')}, {_r('f1', _F1)}, {_r('mean_iou', _mean_iou('kept_rows'))}, (select {_r('average_precision')} from ap) as average_precision, round((select count(*) from predictions) / (select count(*) from images)::double, {DIGITS}) as avg_boxes_before_nms, round((select count(*) from kept_rows) / (select count(*) from images)::double, {DIGITS}) as avg_boxes_after_nms, (select count(*) from images) as images from rated",
    "capped_groups": f"with recursive {_capped('select 2 as threshold, 10 as cap')} select file_name, root from rooted",
    "production_grid": f"with recursive {_GRID} select threshold, cap, num_groups, largest_group_size, num_multi_image_groups, {_r('pct_in_multi_image_groups', 'pct')}, violations = '' as passes_production_criteria, violations, "
    + _r("production_score", "(case when violations = '' then 0 else -1000 end)::double - largest_group_size * 10 - over_20 * 50 - over_50 * 500 - abs(pct - 30) + num_multi_image_groups * 0.1::double")
    + " from judged",
    "negative_windows": f"with {_NEGATIVE} select * from negative",
    "training_crops": f"with {_NEGATIVE} select image_id, label, count(*) as crops, sum(x1 + y1 + x2 + y2) as corners from (select image_id, 1 as label, x1, y1, x2, y2 from truths union all select * from negative) group by image_id, label",
    "fill_singletons": f"""with {fx.SQL_GROUPS}, given as (select * from groups where not ends_with(file_name, '7.jpg')), largest as (select max(regexp_extract(group_id, '([0-9]+)$', 1)::bigint) as n from given)
        select * from given union all select file_name, printf('group_%06d', (select n from largest) + row_number() over (order by file_name)) from groups where ends_with(file_name, '7.jpg')""",
    "group_members": f"with {fx.SQL_GROUPS} select group_id, string_agg(file_name, ',' order by file_name) as files from groups group by group_id",
    "files_by_split": f"with {fx.SQL_GROUPS}, {_GROUPED} select split, row_number() over (partition by split order by file_name) as position, file_name from splits",
    "naive_leakage_examples": f"with {fx.SQL_GROUPS}, {_RANDOM} select group_id, string_agg(distinct split, ',' order by split) as splits from splits join groups using (file_name) group by group_id having count(distinct split) > 1 order by group_id limit 5",
    "samples_for_split": f"with {fx.SQL_GROUPS}, {_GROUPED}, {fx.SQL_IMAGES} select image_id, file_name from images join splits using (file_name) where split = 'val'",
    "split_filter": f"with {fx.SQL_GROUPS}, {_GROUPED}, {fx.SQL_IMAGES}, {fx.SQL_ANNOTATIONS} select image_id, gt_idx, category_id from annotations join images using (image_id) join splits using (file_name) where split = 'test'",
    "file_stems": f"with {fx.SQL_IMAGES} select image_id, 'img.' || image_id || '.jpg' as name, 'img.' || image_id as stem from images",
    "yolo_label_folder": _LABEL_TEXTS.format("replace(file_name, '.jpg', '') as stem") + " where text <> ''",
    "yolo_label_files": _LABEL_TEXTS.format("image_id, file_name"),
    "label_classes": f"with {fx.SQL_ANNOTATIONS} select image_id, gt_idx, category_id::int as label from annotations",
    "crop_quality": f"with {fx.SQL_ANNOTATIONS}, {fx.SQL_PREDICTIONS}, scored as (select pred_idx % 2 as label, (score * 1000 - 500) / 125 as logit from predictions) select count(*) as crops, {_r('accuracy', 'avg(((logit >= 0)::int = label)::int)')}, {_r('loss', 'avg(greatest(logit, 0) - logit * label + ln(1 + exp(-abs(logit))))')} from scored",
    "window_scores": f"""with {fx.SQL_IMAGES}, windows as ({_WINDOWS}), scored as (select *, 1 / (1 + exp(-((x1 * 7 + y1 * 13 + size) % 17 - 8)::double)) as score from windows),
        found as (select *, (row_number() over (partition by image_id order by size, x1, y1) - 1)::int as pred_idx from scored where score >= 0.7)
        select image_id, pred_idx, x1::double as x1, y1::double as y1, x2::double as x2, y2::double as y2, {_r('score')} from found""",
    "compare_crops": f"""select variant, threshold, largest_group_size, {_r('pct_in_multi_image_groups')} from (
        select 'with_crop' as variant, * from (with recursive {_SWEEP} {_BEST}) union all
        select 'no_crop', * from (with recursive {_sweep(fx.sql_encodings(BITS).replace('encodings as', 'whole as', 1) + ', encodings as (select file_name, (hash >> 2) << 2 as hash from whole)')} {_BEST}))
        order by passes_cluster_size_check desc, largest_group_size, pct_in_multi_image_groups desc, variant desc limit 1""",
    "coco_document": f"with {fx.SQL_ANNOTATIONS} select image_id, gt_idx as ann_idx, x, y, w, h, category_id from annotations",
    "coco_sample_order": f"with {fx.SQL_IMAGES}, {fx.SQL_CATEGORIES} select *, (select count(*) from categories) as categories from images",
    "coco_split_documents": f"with {fx.SQL_GROUPS}, {_GROUPED}, {fx.SQL_IMAGES}, {fx.SQL_ANNOTATIONS} select split, image_id, gt_idx as ann_idx, category_id from annotations join images using (image_id) join splits using (file_name)",
    "group_manifest_file": f"with {fx.SQL_GROUPS} select * from groups",
    "split_manifest_file": f"with {fx.SQL_GROUPS}, {_GROUPED} select * from splits",
    "encodings_file": f"with {fx.sql_encodings(64)} select file_name, lpad(lower(printf('%x', hash::uhugeint)), 16, '0') as hash_hex from encodings",
    "pairs_file": f"with {fx.sql_encodings(BITS)}, {_PAIRS} select left_name as file_a, right_name as file_b from pairs where distance <= 2",
    "hash_config_file": f"with {fx.SQL_IMAGES} select round(avg((width = 640)::int) / 10, 6) as top_frac, round(avg((width = 2048)::int) / 10, 6) as bottom_frac, 0.05::double as left_frac, 0.0::double as right_frac, 'phash' as hash_backend, '1.0.0' as pipeline_version, true as stamped from images",
    "pipeline_config_file": f"with {fx.SQL_GROUPS}, {_SUMMARY} select num_groups::bigint as num_groups, largest_group_size::bigint as cap, true as first_stamp_kept, true as last_stamp_moved, 'pipeline_config' as artifacts from summary",
    "evaluation_file": f"with recursive {_BOXES}, {_matched('predictions')}, {_COUNTS} select tp, fp, fn, {_r('precision')}, {_r('recall')}, {_r('f1', _F1)}, true as stamped from rated",
    "metric_rows": f"""with {fx.SQL_GROUPS}, {_SUMMARY} select 'a' as run_id, 'num_groups' as key, num_groups::double as value_double, num_groups::varchar as value_string from summary
        union all select 'a', 'note', null, 'first' union all select 'a', 'passed', 1.0::double, 'True'
        union all select 'b', 'largest', largest_group_size::double, largest_group_size::varchar from summary""",
}
