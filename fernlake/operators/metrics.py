"""Matching predictions to true boxes, and what follows from it.

Matching is greedy in score order and touches one image only: tasks match many images at once, from arrays
(images of many boxes as a stream). Average precision needs one order over all images: running counts and suffix
maxima over range partitions, with carries from a table of one row a partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernlake.operators import box_arrays
from fernlake.operators.detection import FOLD_BOXES, Grown, in_order, ious, max_iou_with, suppress
from fernlake.operators.ranking import PART, ordered_parts
from fernlake.runtime import Scratch, drop_path, materialize

ROWS = "image_id string, pred_idx int, score double, gt_idx int"
_ROWS = pa.schema([("image_id", pa.string()), ("pred_idx", pa.int32()), ("score", pa.float64()), ("gt_idx", pa.int32())])


ORDER = ("kind", "score desc", "idx")


class Streamed:
    """Matching of one image piece by piece, its true boxes (``kind`` 0) first; only they are held."""

    def __init__(self, iou_threshold: float):
        self.threshold, self.truths, self.names, self.free = iou_threshold, Grown(), [], None

    def piece(self, table: pa.Table) -> list[tuple]:
        out = []
        for kind, image, index, score, *box in table.to_pandas()[["kind", "image_id", "idx", "score", "x1", "y1", "x2", "y2"]].itertuples(index=False):
            if kind == 0:
                self.truths.add(box)
                self.names.append(index)
                continue
            self.free = np.ones(self.truths.n, bool) if self.free is None else self.free
            over = np.where(self.free, ious(np.array(box), self.truths.boxes), -1.0)
            at = int(over.argmax()) if self.truths.n else -1
            hit = at >= 0 and over[at] >= self.threshold
            if hit:
                self.free[at] = False
            out.append((image, index, score, self.names[at] if hit else None))
        return out


class Images:
    """A table's whole images, in ``ORDER``: their predictions and true boxes as arrays."""

    def __init__(self, table: pa.Table):
        self.table, self.kind = table, table.column("kind").to_numpy()
        self.image = np.cumsum(table.column("_k").to_numpy() == 1) - 1
        self.n = int(self.image[-1]) + 1 if len(table) else 0
        self.preds, self.truths = (box_arrays.Boxes.of(table, self.image, np.flatnonzero(self.kind == k), self.n) for k in (1, 0))

    def matched(self, preds: box_arrays.Boxes, iou_threshold: float) -> pa.Table:
        """``image_id, pred_idx, score, gt_idx`` of ``preds``."""
        index = self.table.column("idx").combine_chunks()
        at = box_arrays.matches(preds, self.truths, index.take(pa.array(self.truths.rows)).fill_null(0).to_numpy(), iou_threshold)
        hit = np.full(len(at), -1)
        hit[at >= 0] = self.truths.rows[at[at >= 0]]
        own = self.table.select(["image_id", "idx", "score"]).take(pa.array(preds.rows)).rename_columns(["image_id", "pred_idx", "score"])
        return own.append_column("gt_idx", index.take(pa.array(hit, mask=hit < 0)))


def _match(iou_threshold: float, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = None
        for table, larger in box_arrays.chunks(batches, most):
            if larger:
                stream = Streamed(iou_threshold) if table.column("_k")[0].as_py() == 1 else stream
                rows = stream.piece(table)
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(_ROWS.types)], schema=_ROWS)
            else:
                images = Images(table)
                yield from images.matched(images.preds, iou_threshold).cast(_ROWS).to_batches()

    return run


def _both(predictions: DataFrame, truths: DataFrame) -> DataFrame:
    """Predictions (``kind`` 1) and true boxes (0) of an image as rows of one table."""
    ends = [F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")]
    asked = predictions.filter("image_id is not null and score is not null").select(F.lit(1).alias("kind"), F.col("image_id").cast("string"), F.col("pred_idx").cast("int").alias("idx"), F.col("score").cast("double"), *ends)
    given = truths.filter("image_id is not null").select(F.lit(0).alias("kind"), F.col("image_id").cast("string"), F.col("gt_idx").cast("int").alias("idx"), F.lit(None).cast("double").alias("score"), *ends)
    return asked.union(given)


def matched(predictions: DataFrame, truths: DataFrame, iou_threshold: float = 0.5) -> DataFrame:
    """``image_id, pred_idx, score, gt_idx`` of every prediction.

    In score order a prediction takes the unmatched true box of its image with the largest IoU (of equal ones
    the lowest index) and is a hit if that reaches the threshold; ``gt_idx`` is null otherwise. The threshold is
    positive: at zero a prediction that overlaps nothing would count as a hit. Images with more than
    ``FOLD_BOXES`` boxes of both kinds are streamed; of them only the true boxes are held.
    """
    if iou_threshold <= 0:
        raise ValueError("the IoU threshold is positive")
    return in_order(_both(predictions, truths), *ORDER).mapInArrow(_match(iou_threshold, FOLD_BOXES), ROWS)


def image_counts(rows: DataFrame, truths: DataFrame) -> DataFrame:
    """``image_id, tp, fp, fn`` of each image that has predictions (matched ``rows``) or true boxes."""
    got = rows.groupBy("image_id").agg(F.count("gt_idx").alias("tp"), F.count("*").alias("n"))
    have = truths.filter("image_id is not null").groupBy(F.col("image_id").cast("string").alias("image_id")).agg(F.count("*").alias("g"))
    tp, n, g = (F.coalesce(c, F.lit(0)) for c in ("tp", "n", "g"))
    return got.join(have, "image_id", "full").select("image_id", tp.alias("tp"), (n - tp).alias("fp"), (g - tp).alias("fn"))


def ratio(a: Column, b: Column) -> Column:
    """0 where the denominator is."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def precision_recall_f1(counts: DataFrame) -> DataFrame:
    """One row: summed counts, precision, recall and their harmonic mean."""
    summed = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("tp", "fp", "fn")])
    rated = summed.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return rated.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def mean_iou(predictions: DataFrame, truths: DataFrame) -> DataFrame:
    """One row ``mean_iou``: the mean over true boxes of their best IoU with any prediction (0 without one)."""
    return max_iou_with(truths.select("image_id", "x1", "y1", "x2", "y2"), predictions).agg(F.coalesce(F.avg("max_iou"), F.lit(0.0)).alias("mean_iou"))


def average_precision(rows: DataFrame, n_truths: int) -> DataFrame:
    """One row ``average_precision`` from matched rows: each hit's gain in recall times the best precision from there on.

    Order is by score, then image, then prediction. 0 without true boxes or predictions.
    """
    order = [F.desc("score"), F.col("image_id"), F.col("pred_idx")]
    # a range exchange reads its rows twice, for the bounds and to send them: they are written once before
    own, path = materialize(rows.select("score", "image_id", "pred_idx", F.col("gt_idx").isNotNull().cast("int").alias("tp")), "matched")
    cut = ordered_parts(own, order)
    drop_path(rows.sparkSession, path)
    by_part = Window.orderBy(PART)
    carry = cut.groupBy(PART).agg(F.count("*").alias("n"), F.sum("tp").alias("k"))
    before = by_part.rowsBetween(Window.unboundedPreceding, -1)
    carry = carry.select(PART, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("k").over(before), F.lit(0)).alias("k0"))
    inside = Window.partitionBy(PART).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    ranked = cut.withColumn("n", F.row_number().over(inside)).withColumn("k", F.sum("tp").over(upto)).join(F.broadcast(carry), PART)
    hits = ranked.filter("tp = 1").withColumn("precision", (F.col("k") + F.col("k0")) / (F.col("n") + F.col("n0")))
    after = by_part.rowsBetween(1, Window.unboundedFollowing)
    tops = hits.groupBy(PART).agg(F.max("precision").alias("top")).select(PART, F.max("top").over(after).alias("later"))
    # a suffix as a prefix of the reverse order: a frame that ends at the partition's end is computed anew for each row
    onward = Window.partitionBy(PART).orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    best = hits.withColumn("best", F.max("precision").over(onward)).join(F.broadcast(tops), PART, "left").select(F.greatest("best", "later").alias("best"))
    return best.agg((F.coalesce(F.sum("best"), F.lit(0.0)) / max(1, n_truths)).alias("average_precision"))


JUDGED = "image_id string, n long, raw long, kept long, given long, best double, hits array<struct<s:double,i:int,gt_idx:int>>"
_HIT = pa.struct([("s", pa.float64()), ("i", pa.int32()), ("gt_idx", pa.int32())])
_JUDGED = pa.schema([("image_id", pa.string()), ("n", pa.int64()), ("raw", pa.int64()), ("kept", pa.int64()), ("given", pa.int64()), ("best", pa.float64()), ("hits", pa.list_(_HIT))])


def _judge(iou_threshold: float, nms_threshold: float | None, most: int):
    """Images that are listed (``kind`` 2), counted and matched; larger ones counted alone, their pieces carried on."""

    def whole(table: pa.Table) -> pa.RecordBatch:
        images = Images(table)
        preds = images.preds if nms_threshold is None else images.preds.where(box_arrays.kept(images.preds, nms_threshold), images.image)
        found = images.matched(preds, iou_threshold)
        best = np.bincount(images.image[images.truths.rows], weights=box_arrays.best(images.truths, preds), minlength=images.n)
        hits = pa.StructArray.from_arrays([found.column(c).combine_chunks().cast(t) for c, t in (("score", pa.float64()), ("pred_idx", pa.int32()), ("gt_idx", pa.int32()))], fields=list(_HIT))
        lists = pa.ListArray.from_arrays(pa.array(np.append(preds.start, len(preds.rows)), pa.int32()), hits)
        first = np.flatnonzero(np.diff(images.image, prepend=-1))
        counts = [np.bincount(images.image, minlength=images.n), images.preds.n, preds.n, images.truths.n]
        made = pa.RecordBatch.from_arrays([table.column("image_id").combine_chunks().take(pa.array(first)).cast(pa.string()), *map(pa.array, counts), pa.array(best), lists], schema=_JUDGED)
        return made.filter(pa.array(np.bincount(images.image[images.kind == 2], minlength=images.n) > 0))

    def large(image: str, seen: np.ndarray) -> pa.RecordBatch:
        row = {"image_id": image, "n": int(seen.sum()), "raw": int(seen[1]), "kept": 0, "given": int(seen[0]), "best": 0.0, "hits": []}
        return pa.RecordBatch.from_pylist([row] if seen[2] else [], schema=_JUDGED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen = None, np.zeros(3, int)
        for table, larger in box_arrays.chunks(batches, most):
            if now is not None and not (larger and table.column("_k")[0].as_py() > 1):
                yield large(now, seen)
                now, seen = None, np.zeros(3, int)
            if larger:
                now = table.column("image_id")[0].as_py()
                seen = seen + np.bincount(table.column("kind").to_numpy(), minlength=3)
            else:
                yield whole(table)
        if now is not None:
            yield large(now, seen)

    return run


def judged_images(images: DataFrame, predictions: DataFrame, truths: DataFrame, iou_threshold: float = 0.5, nms_threshold: float | None = None) -> DataFrame:
    """``image_id, n, raw, kept, given, best, hits`` of each of ``images``: its boxes of all kinds, predictions before and after
    suppression, true boxes, their best IoUs added up, and the matched predictions. One exchange serves all of it.

    An image with more than ``FOLD_BOXES`` boxes has its counts ``n, raw, given`` alone.
    """
    if iou_threshold <= 0:
        raise ValueError("the IoU threshold is positive")
    corners = ["x1", "y1", "x2", "y2"]
    listed = images.filter("image_id is not null").select(F.lit(2).alias("kind"), F.col("image_id").cast("string"), *[F.lit(None).cast(t).alias(c) for c, t in (("idx", "int"), ("score", "double"), *((c, "double") for c in corners))])
    rows = in_order(_both(predictions, truths).union(listed), *ORDER)
    return rows.mapInArrow(_judge(iou_threshold, nms_threshold, FOLD_BOXES), JUDGED)


def evaluate(images: DataFrame, predictions: DataFrame, truths: DataFrame, iou_threshold: float = 0.5, nms_threshold: float | None = None) -> DataFrame:
    """One row of detection quality over all ``images``, those without boxes included.

    With ``nms_threshold`` predictions are suppressed first. Predictions and true boxes of other images, and
    predictions without a score, do not count.
    """
    spark, scratch = images.sparkSession, Scratch(images.sparkSession)
    judged = scratch.keep(judged_images(images, predictions, truths, iou_threshold, nms_threshold), "judged")
    hits = judged.select("image_id", F.explode("hits").alias("h")).select("image_id", F.col("h.i").alias("pred_idx"), F.col("h.s").alias("score"), "h.gt_idx")
    sums = ("raw", "kept", "given", "best")
    told = judged.agg(F.count("*").alias("images"), F.max("n").alias("most"), F.sum(F.expr("size(filter(hits, h -> h.gt_idx is not null))")).alias("tp"), *[F.sum(c).alias(c) for c in sums]).first().asDict()
    told = {k: v or 0 for k, v in told.items()}
    if told["most"] > FOLD_BOXES:  # images with more boxes are streamed and tiled by themselves
        crowded = judged.filter(F.col("n") > FOLD_BOXES).select("image_id")
        asked, given = (df.withColumn("image_id", F.col("image_id").cast("string")).join(crowded, "image_id") for df in (predictions.filter("score is not null"), truths))
        kept = scratch.keep(suppress(asked, nms_threshold), "kept") if nms_threshold is not None else asked
        found = scratch.keep(matched(kept, given, iou_threshold), "found")
        tp, n = found.agg(F.count("gt_idx"), F.count("*")).first()
        best = max_iou_with(given.select("image_id", "x1", "y1", "x2", "y2"), kept).agg(F.sum("max_iou")).first()[0] or 0.0
        told |= {"tp": told["tp"] + tp, "kept": told["kept"] + n, "best": told["best"] + best}
        hits = hits.union(found.select("image_id", "pred_idx", "score", "gt_idx"))
    counts = spark.createDataFrame([(told["tp"], told["kept"] - told["tp"], told["given"] - told["tp"])], "tp long, fp long, fn long")
    precision = average_precision(hits, told["given"]).first()[0]
    scratch.drop()
    per_image = lambda n: F.lit(float(n) / max(1, told["images"]))
    return precision_recall_f1(counts).withColumns(
        {
            "mean_iou": F.lit(float(told["best"]) / max(1, told["given"])),
            "average_precision": F.lit(float(precision)),
            "avg_boxes_before_nms": per_image(told["raw"]),
            "avg_boxes_after_nms": per_image(told["kept"]),
            "images": F.lit(max(1, told["images"])).cast("long"),
        }
    )


def crop_quality(scored: DataFrame) -> DataFrame:
    """One row ``crops, accuracy, loss`` of scored crops (``label, logit``): shares of right signs and mean binary cross entropy."""
    right = ((F.col("logit") >= 0).cast("int") == F.col("label")).cast("double")
    loss = F.greatest(F.col("logit"), F.lit(0.0)) - F.col("logit") * F.col("label") + F.log1p(F.exp(-F.abs("logit")))
    return scored.agg(F.count("*").alias("crops"), F.coalesce(F.avg(right), F.lit(0.0)).alias("accuracy"), F.coalesce(F.avg(loss), F.lit(0.0)).alias("loss"))
