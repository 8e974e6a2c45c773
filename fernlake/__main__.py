"""``python -m fernlake COMMAND``: the runs of ``fernlake.plans.runs`` from the command line."""

from __future__ import annotations

import argparse
import json
from dataclasses import asdict

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from fernlake.functions.hashes import from_hex
from fernlake.plans import config as configs
from fernlake.plans import runs
from fernlake.sources import artifacts


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="fernlake")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, *options: tuple) -> None:
        own = commands.add_parser(name)
        own.add_argument("--data-dir", required=True)
        for flag, kind, default in options:
            if kind is bool:
                own.add_argument(flag, action="store_true")
            elif kind is list:
                own.add_argument(flag, type=int, nargs="+", default=default)
            else:
                own.add_argument(flag, type=kind, default=default)

    crop = (("--top", float, 0.06), ("--bottom", float, 0.10), ("--left", float, 0.0), ("--right", float, 0.0))
    split = (("--seed", int, 42), ("--train", float, 0.6), ("--val", float, 0.2))
    command("sample", ("--output-dir", str, None), ("--size", int, 30), ("--seed", int, 42))
    command("group", ("--threshold", int, 10), ("--max-group-size", int, 50), ("--recompute", bool, False), *crop)
    command("split", *split, ("--export-coco", bool, False))
    command("report", ("--random-trials", int, 0), ("--seed", int, 42))
    command("tune", ("--thresholds", list, [4, 6, 8, 10, 12, 14]), ("--sample", int, 800), ("--skip-crop-comparison", bool, False), *crop)
    command("sweep", ("--thresholds", list, [3, 4, 5, 6]), ("--caps", list, [40, 50, 60]), *crop)
    command("preview", ("--output-dir", str, None), ("--samples-per-split", int, 30), ("--seed", int, 42), ("--copy", bool, False), ("--per-group", bool, False), ("--num-groups", int, 10))
    command("prepare", ("--output-dir", str, None), ("--config", str, None), ("--multi-class", bool, False), ("--copy-images", bool, False), ("--size", int, None), *split)
    command("evaluate", ("--predictions", str, None), ("--split", str, "test"), ("--iou", float, 0.5), ("--nms", float, None), ("--output", str, None), *split)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("fernlake").getOrCreate()
    meta = f"{a.data_dir}/metadata"

    def crop() -> artifacts.HashCrop:
        return artifacts.HashCrop(a.top, a.bottom, a.left, a.right)

    def hashed(of: artifacts.HashCrop | None = None):
        return runs.encode_images(spark, a.data_dir, meta, of or crop()).select("file_name", from_hex(F.col("hash_hex")).alias("hash"))

    def listed(swept) -> list[dict]:
        return [r.asDict() for r in swept.orderBy("seq").collect()]  # a row a setting

    def save(result: dict, name: str) -> dict:
        artifacts.save_json(spark, result, f"{meta}/{artifacts.FILES[name]}")
        return result

    if a.command == "sample":
        result = {"images": runs.sample_dataset(spark, a.data_dir, a.output_dir or f"{a.data_dir}-sample", a.size, a.seed)}
    elif a.command == "group":
        result = {"files": runs.build_duplicate_groups(spark, a.data_dir, meta, a.threshold, a.max_group_size or None, crop(), a.recompute).count()}
    elif a.command == "split":
        made = runs.split_by_groups(spark, a.data_dir, spark.read.parquet(f"{meta}/group_manifest"), meta, a.seed, a.train, a.val, a.export_coco)
        result = {r["split"]: r["count"] for r in made.groupBy("split").count().collect()}
    elif a.command == "report":
        result = runs.report_split(spark, a.data_dir, spark.read.parquet(f"{meta}/split_manifest"), spark.read.parquet(f"{meta}/group_manifest"), a.random_trials, a.seed)
    elif a.command == "tune":
        if a.skip_crop_comparison:
            swept, best = runs.tune_threshold(hashed(), a.thresholds, a.sample)
            result = {"results": listed(swept), "recommended": best.first().asDict()}
        else:
            crops = {"with_crop": crop(), "no_crop": artifacts.HashCrop(0.0, 0.0, 0.0, 0.0)}
            swept, best = runs.tune_crop({name: hashed(of) for name, of in crops.items()}, a.thresholds, a.sample)
            told, chosen = {name: listed(rows) for name, rows in swept.items()}, best.first().asDict()
            save({"variants": told, "recommended_variant": chosen["variant"], "hash_config": asdict(crops[chosen["variant"]])}, "crop_comparison")
            result = {"results": told[chosen["variant"]], "recommended": chosen}
        save(result, "threshold_sweep")
    elif a.command == "sweep":
        swept, best = runs.sweep_production(hashed(), a.thresholds, [c or None for c in a.caps])  # 0: no cap
        result = save({"results": listed(swept), "recommended": best.first().asDict()}, "threshold_sweep")
    elif a.command == "preview":
        made, manifest = (spark.read.parquet(f"{meta}/{name}") for name in ("split_manifest", "group_manifest"))
        result = runs.preview_splits(spark, a.data_dir, made, a.output_dir or f"{meta}/split_previews", a.samples_per_split, a.seed, a.copy, manifest if a.per_group else None, a.num_groups)
    elif a.command == "prepare":
        options = {"train": a.train, "val": a.val, "seed": a.seed, "size": a.size}
        if a.config:
            given = configs.load_config(a.config, a.data_dir)
            options = configs.split_options(given["data"], given.get("seed", a.seed))
        result = runs.prepare_training_folder(spark, a.data_dir, a.output_dir or f"{a.data_dir}-training", not a.multi_class, copy_images=a.copy_images, **options)
    else:
        found = runs.evaluate_run(spark, a.data_dir, spark.read.parquet(a.predictions), a.split, a.iou, a.nms, a.output, seed=a.seed, train=a.train, val=a.val)
        result = found.first().asDict()
    print(json.dumps(result, default=str))
    return result


if __name__ == "__main__":
    main()
