import random

import pytest

from fernlake.operators import detection, metrics
from tests import loops

P = "image_id string, pred_idx int, x1 double, y1 double, x2 double, y2 double, score double"
G = "image_id string, gt_idx int, x1 double, y1 double, x2 double, y2 double"


def made(seed, images=40):
    rng = random.Random(seed)
    preds, truths = [], []

    def box():
        x, y = rng.randint(0, 40), rng.randint(0, 40)
        return float(x), float(y), float(x + rng.randint(0, 30)), float(y + rng.randint(0, 30))

    for i in range(images):
        for g in range(rng.randint(0, 5)):
            truths.append((f"i{i:02d}", g, *box()))
        for p in range(rng.randint(0, 9)):
            near = rng.random() < 0.5 and [t for t in truths if t[0] == f"i{i:02d}"]
            b = tuple(v + rng.randint(-3, 3) for v in rng.choice(near)[2:]) if near else box()
            preds.append((f"i{i:02d}", p, *b, rng.randint(0, 4) / 4))
    return preds, truths


def by_image(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("seed,fold_boxes", [(1, 2000), (2, 2000), (1, 4), (2, 0)])
def test_folds_and_streams_equal_the_loops(spark, monkeypatch, seed, fold_boxes):
    for module in (detection, metrics):
        monkeypatch.setattr(module, "FOLD_BOXES", fold_boxes)
    preds, truths = made(seed)
    pf, gf = spark.createDataFrame(preds, P), spark.createDataFrame(truths, G)
    pi, gi = by_image(preds), by_image(truths)
    kept = {(r["image_id"], r["pred_idx"]) for r in detection.suppress(pf, 0.3).collect()}
    assert kept == {(i, k) for i, rows in pi.items() for k in loops.suppress([r[2:6] for r in rows], [r[6] for r in rows], 0.3)}
    found = metrics.matched(pf, gf, 0.5)
    got = {(r["image_id"], r["pred_idx"]): r["gt_idx"] for r in found.collect()}
    want = {(i, k): g for i, rows in pi.items() for k, g in loops.match([r[2:6] for r in rows], [r[6] for r in rows], [t[2:] for t in gi.get(i, [])], 0.5).items()}
    assert got == want
    ap = metrics.average_precision(found, len(truths)).first()[0]
    rows = [(r[6], r[0], r[1], want[r[0], r[1]] is not None) for r in preds]
    assert ap == pytest.approx(loops.average_precision(rows, len(truths)))
    mean = metrics.mean_iou(pf, gf).first()[0]
    assert mean == pytest.approx(sum(max([loops.iou(p[2:6], t[2:]) for p in pi.get(t[0], [])], default=0.0) for t in truths) / len(truths))


def test_published_arithmetic(spark):
    for tp, fp, fn, p, r, f in ((1629, 77, 306, 0.9549, 0.8419, 0.8948), (1833, 38, 119, 0.9797, 0.9390, 0.9589)):
        row = metrics.precision_recall_f1(spark.createDataFrame([(tp, fp, fn)], "tp long, fp long, fn long")).first()
        assert (round(row["precision"], 4), round(row["recall"], 4), round(row["f1"], 4)) == (p, r, f)


def test_empty_tables(spark):
    preds, truths = made(3, 4)
    pf, gf, images = spark.createDataFrame(preds, P), spark.createDataFrame(truths, G), spark.createDataFrame([("i00",), ("none",)], "image_id string")
    for p, g in ((pf, gf.limit(0)), (pf.limit(0), gf), (pf.limit(0), gf.limit(0))):
        row = metrics.evaluate(images, p, g).first()
        assert row["average_precision"] == row["f1"] == row["mean_iou"] == 0 and row["images"] == 2
    with pytest.raises(ValueError):
        metrics.matched(pf, gf, 0.0)


def test_suppression_chain_and_threshold(spark):
    rows = [("i", 0, 0.0, 0.0, 10.0, 10.0, 0.9), ("i", 1, 5.0, 0.0, 15.0, 10.0, 0.8), ("i", 2, 10.0, 0.0, 20.0, 10.0, 0.7)]
    kept = {r["pred_idx"] for r in detection.suppress(spark.createDataFrame(rows, P), 0.3).collect()}
    assert kept == {0, 2}
    assert {r["pred_idx"] for r in detection.suppress(spark.createDataFrame(rows, P), 1 / 3).collect()} == {0, 1, 2}


def test_windows_and_crops(spark):
    images = spark.createDataFrame([("a", 100, 60), ("b", 9, 9)], "image_id string, width int, height int")
    grid = [tuple(r)[2:] for r in detection.window_grid(images, [40], 0.5).collect()]
    assert grid == [(x, y, x + 40, y + 40) for x in range(0, 61, 20) for y in range(0, 21, 20)]
    tiny = detection.window_grid(spark.createDataFrame([("c", 12, 11)], "image_id string, width int, height int"), [10], 0.9)
    assert tiny.count() == 3 * 2  # the stride is 1
    big = spark.createDataFrame([("a", 640, 480)], "image_id string, width int, height int")
    truth = spark.createDataFrame([("a", 0, 10.0, 10.0, 60.0, 60.0)], G)
    crops = detection.training_crops(big, truth)
    assert sorted(r["label"] for r in crops.collect()) == [0, 0, 0, 1]
    assert {tuple(r) for r in crops.collect()} == {tuple(r) for r in crops.collect()}
    assert all(loops.iou(tuple(r)[2:], (10, 10, 60, 60)) < 0.2 for r in crops.filter("label = 0").collect())


def test_scorer_plug_in(spark):
    def constant(batches):
        for b in batches:
            yield b.assign(logit=[2.0 if x == 0 else -2.0 for x in b["x1"]])

    images = spark.createDataFrame([("a", 80, 40)], "image_id string, width int, height int")
    found = detection.detect_windows(detection.window_grid(images, [40], 0.5), constant).collect()
    assert [(r["pred_idx"], r["x1"]) for r in found] == [(0, 0.0)]


@pytest.mark.parametrize("fold", [0, 12, 2000])
def test_best_iou_by_tiles_equals_every_comparison(spark, monkeypatch, fold):
    """Boxes of all sizes, some inverted or empty, at negative places too, in images that are folded or tiled."""
    monkeypatch.setattr(detection, "FOLD_BOXES", fold)
    rng = random.Random(5)

    def box():
        x, y, w, h = rng.uniform(-300, 300), rng.uniform(-300, 300), 2 ** rng.uniform(-3, 9), 2 ** rng.uniform(-3, 9)
        return rng.choice([(x, y, x + w, y + h)] * 9 + [(x, y, x, y + h), (x + w, y, x, y + h), (0.0, 0.0, 64.0, 64.0)])

    def iou(a, b):
        inter = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
        area = lambda c: max(0, c[2] - c[0]) * max(0, c[3] - c[1])
        return inter / (area(a) + area(b) - inter) if area(a) + area(b) - inter > 0 else 0.0

    asked = [(rng.choice(["a", "b", "c", None]), i, *box()) for i in range(160)]
    given = [(rng.choice(["a", "b", "d", None]), *box()) for _ in range(120)]
    got = detection.max_iou_with(spark.createDataFrame(asked, "image_id string, i int, x1 double, y1 double, x2 double, y2 double"), spark.createDataFrame(given, "image_id string, x1 double, y1 double, x2 double, y2 double"))
    assert got.columns == ["image_id", "i", "x1", "y1", "x2", "y2", "max_iou"]
    want = {a[1]: max([iou(a[2:], g[1:]) for g in given if g[0] == a[0] and a[0]], default=0.0) for a in asked}
    assert {r["i"]: pytest.approx(r["max_iou"], abs=1e-12) for r in got.collect()} == want
    pairs = detection.tile_pairs(*(spark.createDataFrame([(r[0], r[-4:]) for r in rows if r[0]], "_image string, _box struct<x1:double,y1:double,x2:double,y2:double>") for rows in (asked, given)))
    overlapping = sum(iou(a[2:], g[1:]) > 0 for a in asked for g in given if a[0] and a[0] == g[0])
    assert pairs.count() == overlapping  # none that do not overlap, none twice


def test_crowded_images_are_evaluated_alike(spark, monkeypatch):
    rng = random.Random(8)
    boxes = [(rng.choice("abc"), i, *(x := rng.randrange(60), y := rng.randrange(60), x + 20, y + 20), rng.randrange(10) / 10) for i in range(90)]
    rows = [(a, i, *map(float, b), s) for a, i, *b, s in boxes]
    predictions = spark.createDataFrame(rows, "image_id string, pred_idx int, x1 double, y1 double, x2 double, y2 double, score double")
    truths = predictions.filter("pred_idx % 3 = 0").selectExpr("image_id", "pred_idx as gt_idx", "x1 + 2 as x1", "y1", "x2 + 2 as x2", "y2")
    images = spark.createDataFrame([("a",), ("b",), ("none",)], "image_id string")
    rows = []
    for fold in (2000, 0, 45):
        for module in (detection, metrics):
            monkeypatch.setattr(module, "FOLD_BOXES", fold)
        rows.append([round(float(v), 9) for v in metrics.evaluate(images, predictions, truths, 0.5, 0.4).first()])
    assert rows[0] == rows[1] == rows[2] and rows[0][0] > 0
