"""Boxes as arrays: the arithmetic is SQL's on odd boxes too, and plans bring an image's rows together once."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from fernlake import fixtures as fx
from fernlake.functions.boxes import iou_sql
from fernlake.operators import detection, metrics

C = ("x1", "y1", "x2", "y2")
ODD = [(0.0, 0.0, 4.0, 4.0), (2.0, 2.0, 6.0, 6.0), (5.0, 5.0, 1.0, 1.0), (3.0, 3.0, 3.0, 3.0), (None, 0.0, 4.0, 4.0), (0.0, 0.0, None, 4.0), (None, None, None, None), (math.nan, 0.0, 4.0, 4.0), (0.0, 0.0, math.nan, 4.0)]
P = "image_id string, pred_idx int, x1 double, y1 double, x2 double, y2 double, score double"
G = "image_id string, gt_idx int, x1 double, y1 double, x2 double, y2 double"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ious_of_odd_boxes_are_those_of_sql(spark):
    pairs = list(enumerate(itertools.product(ODD, ODD)))
    preds = spark.createDataFrame([(f"i{n}", 0, *a, 0.5) for n, (a, _) in pairs], P)
    truths = spark.createDataFrame([(f"i{n}", 0, *b) for n, (_, b) in pairs], G)
    got = {r["image_id"]: r["max_iou"] for r in detection.max_iou_with(preds, truths).collect()}
    boxes = preds.select("image_id", F.struct(*C).alias("a")).join(truths.select("image_id", F.struct(*C).alias("b")), "image_id")
    want = {r["image_id"]: r["v"] for r in boxes.select("image_id", F.expr(iou_sql("a", "b")).alias("v")).collect()}
    assert got.keys() == want.keys()
    for n, v in want.items():
        assert got[n] == v or (math.isnan(got[n]) and math.isnan(v)), pairs[int(n[1:])]


@pytest.mark.parametrize("most", [2000, 3, 0])
def test_evaluation_is_the_same_for_images_of_any_size(spark, data, monkeypatch, most):
    def found():
        return metrics.evaluate(fx.images(spark, data).filter("image_id % 3 > 0"), fx.predictions(spark, data), fx.truths(spark, data), 0.5, 0.3).first()

    want = found()
    for module in (detection, metrics):
        monkeypatch.setattr(module, "FOLD_BOXES", most)
    assert found() == pytest.approx(want)


@pytest.mark.parametrize("most", [2000, 3, 0])
def test_crops_of_images_of_any_size(spark, data, monkeypatch, most):
    def found():
        return sorted(map(tuple, detection.training_crops(fx.images(spark, data), fx.truths(spark, data)).filter("image_id % 20 = 1").collect()))

    want = found()
    monkeypatch.setattr(detection, "FOLD_BOXES", most)
    assert found() == want


def test_matching_brings_an_image_together_once_and_interprets_nothing(spark, data):
    text = plan(metrics.matched(fx.predictions(spark, data), fx.truths(spark, data)))
    assert text.count("Exchange hashpartitioning") == 2  # predictions and true boxes, each by image
    assert "lambda" not in text


def test_background_boxes_come_without_interpreted_lambdas(spark, data):
    assert "lambda" not in plan(detection.training_crops(fx.images(spark, data), fx.truths(spark, data)))
