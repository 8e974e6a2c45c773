"""Sliding windows, scoring, suppression and negative crops.

Suppression goes through an image's boxes in score order, so images are the unit of
distribution. The boxes of most are folded inside one array; those of an image with more than
``FOLD_BOXES`` are never gathered but streamed in order from a sorted partition, and
what is held of them are the boxes that were kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from fernlake.functions.boxes import iou_sql
from fernlake.operators import box_arrays
from fernlake.runtime import materialize

#: Highest score first; of equal ones the lower index.
BY_SCORE = "(l, r) -> case when l.s > r.s then -1 when l.s < r.s then 1 else l.i - r.i end"
#: Boxes of an image up to which they are folded in an array.
FOLD_BOXES = 2000
#: Sides of negative crops.
NEGATIVE_SIZES = (64, 128, 256)


def boxes_of_image(predictions: DataFrame) -> DataFrame:
    """``image_id, preds``: an image's predictions as structs ``s, i, x1, y1, x2, y2`` in score order.

    Rows without image or score are left out.
    """
    rows = predictions.filter("image_id is not null and score is not null").select("image_id", F.struct(F.col("score").alias("s"), F.col("pred_idx").cast("int").alias("i"), "x1", "y1", "x2", "y2").alias("p"))
    return rows.groupBy("image_id").agg(F.collect_list("p").alias("p")).select("image_id", F.expr(f"array_sort(p, {BY_SCORE})").alias("preds"))


def counted(rows: DataFrame) -> DataFrame:
    """Rows with ``_n``, the number of their image's rows; what groups by image next needs no further exchange."""
    return rows.withColumn("_n", F.count("*").over(Window.partitionBy("image_id")))


def ious(box: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """``iou_sql`` of one box with each of ``boxes (n, 4)``."""
    wide = np.maximum(0.0, np.minimum(box[2], boxes[:, 2]) - np.maximum(box[0], boxes[:, 0]))
    high = np.maximum(0.0, np.minimum(box[3], boxes[:, 3]) - np.maximum(box[1], boxes[:, 1]))
    areas = np.maximum(0.0, boxes[:, 2] - boxes[:, 0]) * np.maximum(0.0, boxes[:, 3] - boxes[:, 1])
    union = max(0.0, box[2] - box[0]) * max(0.0, box[3] - box[1]) + areas - wide * high
    return np.where(union <= 0, 0.0, wide * high / np.where(union <= 0, 1.0, union))


class Grown:
    """Boxes in an array that doubles as it fills."""

    def __init__(self):
        self.n, self.held = 0, np.empty((64, 4))

    def add(self, box) -> None:
        if self.n == len(self.held):
            self.held = np.concatenate([self.held, np.empty_like(self.held)])
        self.held[self.n] = box
        self.n += 1

    @property
    def boxes(self) -> np.ndarray:
        return self.held[: self.n]


KEPT = "image_id string, pred_idx int, x1 double, y1 double, x2 double, y2 double, score double"


def _suppress_stream(iou_threshold: float):
    """Rows come sorted by image, then score and index."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, kept = None, Grown()
        for batch in batches:
            wanted = np.zeros(len(batch), bool)
            for i, (image, box) in enumerate(zip(batch["image_id"], batch[["x1", "y1", "x2", "y2"]].to_numpy(float))):
                if image != now:
                    now, kept = image, Grown()
                if not (ious(box, kept.boxes) > iou_threshold).any():
                    kept.add(box)
                    wanted[i] = True
            yield batch[wanted]

    return run


def suppress_sql(boxes: str, iou_threshold: float) -> str:
    """Those of an array of boxes in score order that greedy suppression keeps."""
    return f"aggregate({boxes}, filter({boxes}, z -> false), (kept, b) -> if(exists(kept, k -> {iou_sql('k', 'b')} > {float(iou_threshold)}D), kept, concat(kept, array(b))))"


def suppress(predictions: DataFrame, iou_threshold: float = 0.3) -> DataFrame:
    """The predictions that greedy suppression keeps: none overlaps a better kept one by more than the threshold."""
    rows = counted(predictions.filter("image_id is not null and score is not null").select(*[F.col(f.split()[0]).cast(f.split()[1]) for f in KEPT.split(", ")]))
    fold = suppress_sql("preds", iou_threshold)
    few = boxes_of_image(rows.filter(F.col("_n") <= FOLD_BOXES)).select("image_id", F.explode(F.expr(fold)).alias("p"))
    small = few.select("image_id", F.col("p.i").alias("pred_idx"), "p.x1", "p.y1", "p.x2", "p.y2", F.col("p.s").alias("score"))
    many = rows.filter(F.col("_n") > FOLD_BOXES).drop("_n").sortWithinPartitions("image_id", F.desc("score"), "pred_idx")
    return small.union(many.mapInPandas(_suppress_stream(iou_threshold), KEPT))


def window_grid(images: DataFrame, sizes: list[int], overlap: float) -> DataFrame:
    """``image_id, size, x1, y1, x2, y2`` of all windows, column by column; images smaller than a window have none.

    The stride is ``size * (1 - overlap)`` cut to a whole number, 1 at least.
    """
    steps = F.array(*[F.struct(F.lit(s).alias("size"), F.lit(max(1, int(s * (1 - overlap)))).alias("stride")) for s in sizes])
    sized = images.select("image_id", "width", "height", F.explode(steps).alias("w")).filter("width >= w.size and height >= w.size")
    across = sized.select("image_id", "height", "w", F.expr("explode(sequence(0, width - w.size, w.stride))").alias("x"))
    down = across.select("image_id", "w", "x", F.expr("explode(sequence(0, height - w.size, w.stride))").alias("y"))
    return down.selectExpr("image_id", "w.size as size", "x as x1", "y as y1", "x + w.size as x2", "y + w.size as y2")


def sigmoid(logit: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def detect_windows(windows: DataFrame, logits: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], threshold: float = 0.7) -> DataFrame:
    """Windows whose score reaches the threshold, as predictions numbered within their image.

    ``logits`` is the scorer: it maps batches of windows to the same with a column ``logit``. It
    runs once a batch in Arrow-fed Python; a model is loaded there, once a task.
    """
    schema = windows.select("image_id", "size", "x1", "y1", "x2", "y2").schema.add("logit", "double")
    scored = windows.select("image_id", "size", "x1", "y1", "x2", "y2").mapInPandas(logits, schema).withColumn("score", sigmoid(F.col("logit"))).filter(F.col("score") >= threshold)
    number = F.expr("row_number() over (partition by image_id order by size, x1, y1) - 1")
    return scored.select("image_id", number.alias("pred_idx"), *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")], "score")


def in_order(rows: DataFrame, *order: str) -> DataFrame:
    """Rows with ``_k``, their number in their image by ``order``, each image's together and in this order (for ``box_arrays.chunks``).

    The window brings an image's rows together, unless they are already, and leaves them sorted.
    """
    numbered = rows.withColumn("_k", F.expr(f"row_number() over (partition by image_id order by {', '.join(order)})"))
    return numbered.sortWithinPartitions("image_id", *[F.expr(o.removesuffix(" desc")).desc() if o.endswith(" desc") else F.col(o) for o in order])


def _best(most: int, names: list[str]):
    """Each box with its best IoU; without one where its image has more than ``most`` boxes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, larger in box_arrays.chunks(batches, most):
            asked = table.column("_asked").to_numpy()
            mine = np.flatnonzero(asked)
            if larger:
                found = pa.nulls(len(mine), pa.float64())
            else:
                image = np.cumsum(table.column("_k").to_numpy() == 1) - 1
                of = table.select(["_x1", "_y1", "_x2", "_y2"]).rename_columns(["x1", "y1", "x2", "y2"])
                boxes, truths = (box_arrays.Boxes.of(of, image, rows, int(image[-1]) + 1) for rows in (mine, np.flatnonzero(~asked)))
                found = pa.array(box_arrays.best(boxes, truths))
            rows = table.select(names).take(pa.array(mine)).append_column("max_iou", found)
            yield from rows.to_batches()

    return run


def max_iou_with(boxes: DataFrame, truths: DataFrame) -> DataFrame:
    """``boxes`` with ``max_iou``: the largest IoU with a true box of the image, 0 without any.

    One exchange brings both together. The boxes of an image with more than ``FOLD_BOXES`` are never gathered; they meet by tiles.
    """
    # boxes of no image have nothing to meet and are no group
    alone = boxes.filter("image_id is null").withColumn("max_iou", F.lit(0.0))
    named, kind = boxes.filter("image_id is not null"), boxes.schema["image_id"].dataType
    there = truths.filter("image_id is not null").withColumn("image_id", F.col("image_id").cast(kind))
    ends = [F.col(c).cast("double").alias(f"_{c}") for c in ("x1", "y1", "x2", "y2")]
    asked = named.select(F.lit(True).alias("_asked"), *ends, *boxes.columns)
    given = there.select(F.lit(False).alias("_asked"), *ends, *[F.col("image_id") if f.name == "image_id" else F.lit(None).cast(f.dataType).alias(f.name) for f in boxes.schema.fields])
    schema = StructType([*[StructField(f.name, f.dataType) for f in boxes.schema.fields], StructField("max_iou", DoubleType())])
    found, _ = materialize(in_order(asked.union(given), "_asked").mapInArrow(_best(FOLD_BOXES, boxes.columns), schema), "best")
    crowded = found.filter("max_iou is null").select("image_id").distinct()
    done = found.filter("max_iou is not null").union(alone)
    if crowded.isEmpty():
        return done
    corners, image = F.struct(*[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")]).alias("_box"), F.col("image_id").alias("_image")
    many = named.join(crowded, "image_id", "left_semi").select(image, F.struct(*boxes.columns).alias("_row"), corners)
    return done.union(best_by_tiles(many, there.join(crowded, "image_id", "left_semi").select(image, corners)).select("_row.*", "max_iou"))


def tiles(boxes: DataFrame, levels: DataFrame) -> DataFrame:
    """Rows of ``boxes`` (with ``_box`` and ``_level``) with each tile they touch, as ``level, tx, ty``, on their own level and on the image's coarser ones.

    A tile of level n has sides of 2^n. A box is no longer than a tile of its level, so it touches four of a level at most.
    """
    on = boxes.join(levels, "_image").withColumn("level", F.explode(F.filter("levels", lambda n: n >= F.col("_level"))))
    for axis in "xy":
        first, last = (F.floor(F.col(f"_box.{axis}{end}") / F.pow(F.lit(2.0), F.col("level"))) for end in (1, 2))
        on = on.withColumn(f"t{axis}", F.explode(F.sequence(first, last)))
    return on.drop("levels")


def tile_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """``_image, _l, _r`` of all boxes (``_image, _box`` and others, as structs) of an image that overlap, each pair once.

    Two boxes meet on the level of the larger, in the tile that holds the lower corner of their overlap.
    """
    sides = {}
    for name, frame in (("_l", left), ("_r", right)):
        side = F.greatest(F.col("_box.x2") - F.col("_box.x1"), F.col("_box.y2") - F.col("_box.y1"))
        real = frame.filter("_box.x2 > _box.x1 and _box.y2 > _box.y1").withColumn("_level", F.ceil(F.log2(side)).cast("int"))
        sides[name] = real.select("_image", "_box", "_level", F.struct(*frame.columns).alias(name))
    levels = sides["_l"].select("_image", "_level").union(sides["_r"].select("_image", "_level")).groupBy("_image").agg(F.collect_set("_level").alias("levels"))
    on = [tiles(s, levels).withColumnsRenamed({"_box": f"{n}box", "_level": f"{n}level"}) for n, s in sides.items()]
    met = on[0].join(on[1], ["_image", "level", "tx", "ty"]).filter("level = greatest(_llevel, _rlevel)")
    corner = [F.floor(F.greatest(F.col(f"_lbox.{axis}1"), F.col(f"_rbox.{axis}1")) / F.pow(F.lit(2.0), F.col("level"))) == F.col(f"t{axis}") for axis in "xy"]
    apart = "_lbox.x1 >= _rbox.x2 or _rbox.x1 >= _lbox.x2 or _lbox.y1 >= _rbox.y2 or _rbox.y1 >= _lbox.y2"
    return met.filter(corner[0] & corner[1]).filter(f"not ({apart})").select("_image", "_l", "_r")


def best_by_tiles(boxes: DataFrame, truths: DataFrame) -> DataFrame:
    """``_row, max_iou`` of ``boxes`` (``_image, _row, _box``): boxes of an image that do not overlap never meet."""
    best = tile_pairs(boxes.select("_image", "_box").distinct(), truths.select("_image", "_box").distinct())
    best = best.groupBy("_image", F.col("_l._box").alias("_box")).agg(F.max(F.expr(iou_sql("_l._box", "_r._box"))).alias("max_iou"))
    return boxes.join(best, ["_image", "_box"], "left").select("_row", F.coalesce("max_iou", F.lit(0.0)).alias("max_iou"))


def iou_pairs(predictions: DataFrame, truths: DataFrame) -> DataFrame:
    """``image_id, pred_idx, gt_idx, iou`` of every prediction with every true box of its image."""
    p = predictions.select("image_id", "pred_idx", F.struct("x1", "y1", "x2", "y2").alias("p"))
    g = truths.select("image_id", "gt_idx", F.struct("x1", "y1", "x2", "y2").alias("g"))
    return p.join(g, "image_id").select("image_id", "pred_idx", "gt_idx", F.expr(iou_sql("p", "g")).alias("iou"))


def drawn(hashes: list[bytes]) -> list[np.ndarray]:
    """Three numbers of 28 bits from the digits of each hash, as any engine can make them."""
    words = np.frombuffer(b"".join(hashes), ">u8").astype(np.uint64).reshape(-1, 2).T
    low = np.uint64((1 << 28) - 1)
    numbers = words[0] >> np.uint64(36), (words[0] >> np.uint64(8)) & low, ((words[0] & np.uint64(255)) << np.uint64(20)) | (words[1] >> np.uint64(44))
    return [n.astype(np.int64) for n in numbers]


def first_fits(names: list[str], slot: np.ndarray, width: np.ndarray, height: np.ndarray, n: np.ndarray, start: np.ndarray, truths: box_arrays.Boxes, seed: int, tries: int, max_iou: float) -> tuple[np.ndarray, np.ndarray]:
    """The slots that a try fills, and the boxes they get. Of each slot: its image's name, number and size, and the place of the image's true boxes."""
    left, at, boxes = np.arange(len(slot)), [], []
    for t in range(1, tries + 1):
        hashes = [hashlib.md5(f"{seed}:{names[i]}:{s}:{t}".encode()).digest() for i, s in zip(left.tolist(), slot[left].tolist())]
        size, x, y = drawn(hashes)
        side = np.array(NEGATIVE_SIZES)[size % len(NEGATIVE_SIZES)]
        inside = (side < width[left]) & (side < height[left])
        x, y = x % np.maximum(1, width[left] - side), y % np.maximum(1, height[left] - side)
        tried = box_arrays.Boxes([c.astype(float) for c in (x, y, x + side, y + side)], False, left, n[left])
        mine, b = box_arrays.each(n[left] * inside, start[left])
        over = ~(box_arrays.iou(tried, mine, truths, b) < max_iou)
        fits = inside & (np.bincount(mine[over], minlength=len(left)) == 0)
        at.append(left[fits])
        boxes.append(np.stack([tried.x1, tried.y1, tried.x2, tried.y2], 1)[fits])
        left = left[~fits]
        if not len(left):
            break
    return np.concatenate(at), np.concatenate(boxes)


def _background(seed: int, per_truth: int, tries: int, max_iou: float, most: int):
    """Background boxes of images (``kind`` 0, before their true boxes); of a larger image the true boxes are held."""

    def crops(table: pa.Table) -> Iterator[pa.RecordBatch]:
        kind, image = table.column("kind").to_numpy(), np.cumsum(table.column("_k").to_numpy() == 1) - 1
        truths = box_arrays.Boxes.of(table, image, np.flatnonzero(kind == 1), int(image[-1]) + 1)
        listed = np.flatnonzero(kind == 0)
        n, start = truths.n[image[listed]], truths.start[image[listed]]
        sizes = [table.column(c).fill_null(0).to_numpy()[listed] for c in ("width", "height")]
        names = table.column("name").take(pa.array(listed)).to_pylist()
        ids = table.column("image_id").combine_chunks()
        of, slot = box_arrays.each(per_truth * n, np.zeros_like(n))
        for part in box_arrays.parts(n[of]):
            own = of[part]
            at, boxes = first_fits([names[i] for i in own.tolist()], slot[part], sizes[0][own], sizes[1][own], n[own], start[own], truths, seed, tries, max_iou)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(listed[own[at]])), *map(pa.array, boxes.T.copy())], ["image_id", "x1", "y1", "x2", "y2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: list[pa.Table] = []
        for table, larger in box_arrays.chunks(batches, most):
            if pieces and not (larger and table.column("_k")[0].as_py() > 1):
                yield from crops(pa.concat_tables(pieces))
                pieces = []
            if larger:
                pieces.append(table)
            else:
                yield from crops(table)
        if pieces:
            yield from crops(pa.concat_tables(pieces))

    return run


def training_crops(images: DataFrame, truths: DataFrame, seed: int = 42, per_truth: int = 3, tries: int = 100, max_iou: float = 0.2) -> DataFrame:
    """``image_id, label, x1, y1, x2, y2``: every true box as 1, and up to three times as many background boxes as 0.

    Each background slot has ``tries`` hashed candidates; the first that fits the image and overlaps no
    true box by ``max_iou`` is taken. Candidates come from a hash of seed, image, slot and try, so the
    crops are reproducible in any order of execution. Slots all of whose tries fail give none.
    """
    ends, kind = ("x1", "y1", "x2", "y2"), images.schema["image_id"].dataType
    # images are the fewer: where true boxes lie by image already, images alone are sent
    listed = images.select("image_id", F.lit(0).alias("kind"), F.col("width").cast("long"), F.col("height").cast("long"), *[F.lit(None).cast("double").alias(c) for c in ends]).repartition("image_id")
    given = truths.select(F.col("image_id").cast(kind), F.lit(1).alias("kind"), *[F.lit(None).cast("long").alias(c) for c in ("width", "height")], *[F.col(c).cast("double").alias(c) for c in ends])
    both = in_order(listed.union(given).filter("image_id is not null"), "kind").withColumn("name", F.col("image_id").cast("string"))
    schema = StructType([images.schema["image_id"], *[StructField(c, DoubleType()) for c in ends]])
    taken = both.mapInArrow(_background(seed, per_truth, tries, max_iou, FOLD_BOXES), schema)
    positive = truths.select("image_id", F.lit(1).alias("label"), "x1", "y1", "x2", "y2")
    return positive.unionByName(taken.select("image_id", F.lit(0).alias("label"), *ends))
