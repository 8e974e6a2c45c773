import pytest
from pyspark.sql import functions as F

from fernlake.functions import boxes, hashes, names
from tests import loops

CASES = [
    ((0, 0, 10, 10), (0, 0, 10, 10), 1.0),
    ((0, 0, 10, 10), (20, 20, 30, 30), 0.0),
    ((0, 0, 10, 10), (10, 0, 20, 10), 0.0),
    ((0, 0, 0, 10), (0, 0, 10, 10), 0.0),
    ((10, 10, 0, 0), (0, 0, 10, 10), 0.0),
    ((5, 5, 5, 5), (5, 5, 5, 5), 0.0),
    ((0, 0, 10, 10), (5, 0, 15, 10), 1 / 3),
]
BOX = "struct<x1:double,y1:double,x2:double,y2:double>"


def test_iou_cases(spark):
    df = spark.createDataFrame([(tuple(map(float, a)), tuple(map(float, b)), w) for a, b, w in CASES], f"a {BOX}, b {BOX}, want double")
    for r in df.withColumn("got", boxes.iou("a", "b")).collect():
        assert r["got"] == pytest.approx(r["want"])
        assert r["got"] == pytest.approx(loops.iou(tuple(r["a"]), tuple(r["b"])))


def test_crop_rounds_half_to_even_and_refuses_nothing_left(spark):
    row = spark.range(1).select(boxes.crop_box(F.lit(25), F.lit(25), 0.1, 0.1, 0.1, 0.1).alias("b")).first()["b"]
    assert (row["x1"], row["y1"], row["x2"], row["y2"]) == (2, 2, 22, 22)
    for bad in ((-0.1, 0, 0, 0), (1.0, 0, 0, 0), (0.6, 0.4, 0, 0)):
        with pytest.raises(ValueError):
            boxes.check_crop(*bad)
    with pytest.raises(Exception, match="nothing"):
        spark.range(1).select(boxes.crop_box(F.lit(0), F.lit(5))).collect()


def test_names(spark):
    df = spark.createDataFrame([("a/b/img.1.jpg",), (".hidden",), ("plain",)], "f string")
    got = [tuple(r) for r in df.select(names.basename(F.col("f")), names.stem(F.col("f"))).collect()]
    assert got == [("img.1.jpg", "img.1"), (".hidden", ".hidden"), ("plain", "plain")]
    labels = [r[0] for r in spark.createDataFrame([(1,), (1234567,)], "n long").select(names.group_label(F.col("n"))).collect()]
    assert labels == ["group_000001", "group_1234567"]


def test_hex_and_distance(spark):
    df = spark.createDataFrame([("0000000000000000",), ("ffffffffffffffff",), ("8000000000000000",)], "h string").select("h", hashes.from_hex(F.col("h")).alias("v"))
    rows = df.select("h", "v", hashes.to_hex(F.col("v")).alias("back"), hashes.hamming(F.col("v"), F.lit(0)).alias("d")).collect()
    assert [(r["v"], r["d"]) for r in rows] == [(0, 0), (-1, 64), (-(2**63), 1)]
    assert all(r["h"] == r["back"] for r in rows)


def test_picture_hash_is_stable():
    import numpy as np

    rng = np.random.default_rng(0)
    picture = np.kron(rng.integers(0, 256, (12, 20)), np.ones((10, 10))).astype(np.uint8)
    first = hashes.phash(picture)
    assert first == hashes.phash(picture.copy())
    assert bin(first ^ hashes.phash(picture // 2)).count("1") <= 4  # darker
    assert bin(first ^ hashes.phash(np.kron(picture, np.ones((2, 2), np.uint8)))).count("1") <= 4  # larger
    assert bin(first ^ hashes.phash(rng.integers(0, 256, (120, 200)).astype(np.uint8))).count("1") > 10


def test_resampling():
    import numpy as np

    from fernlake.functions import pictures

    rng = np.random.default_rng(1)
    plane = rng.integers(0, 256, (37, 53)).astype(np.uint8)
    for kernel in (pictures.BILINEAR, pictures.LANCZOS):
        assert (pictures.resized(plane, 37, 53, kernel) == plane).all()
        assert (pictures.resized(np.full((9, 70), 200, np.uint8), 32, 32, kernel) == 200).all()
        small = pictures.resized(plane, 8, 11, kernel).astype(int)
        assert (pictures.resized(plane[::-1, ::-1], 8, 11, kernel) == small[::-1, ::-1]).all()
    assert pictures.resized(np.array([[0, 255]], np.uint8), 1, 4).tolist() == [[0, 64, 191, 255]]
    assert pictures.resized(np.array([[0, 100, 200, 40]], np.uint8), 1, 2).tolist() == [[71, 117]]  # weights 3, 3, 1 and 1, 3, 3 of 7
    steps = np.repeat([[0], [255]], 8, 0).astype(np.uint8)
    assert pictures.resized(steps, 4, 1, pictures.LANCZOS)[:, 0].tolist()[::3] == [0, 255]
    # each pass against its definition, one value at a time
    for n, size in ((53, 11), (7, 32)):
        for of, reach in (pictures.BILINEAR, pictures.LANCZOS):
            line, factor = rng.integers(0, 256, n), n / size
            wide = max(1.0, factor)
            for i in range(size):
                centre = (i + 0.5) * factor
                low, high = max(0, int(centre - reach * wide + 0.5)), min(n, int(centre + reach * wide + 0.5))
                w = [float(of(np.array((x - centre + 0.5) / wide))) for x in range(low, high)]
                whole = [int(v / sum(w) * 2**22 + (0.5 if v >= 0 else -0.5)) for v in w]
                want = min(255, max(0, (sum(int(p) * k for p, k in zip(line[low:high], whole)) + 2**21) >> 22))
                assert pictures.resized(line[None].astype(np.uint8), 1, size, (of, reach))[0, i] == want
    made = pictures.scorer_input(np.full((5, 9, 3), 255, np.uint8), 16)
    assert made.shape == (3, 16, 16) and made[0, 0, 0] == pytest.approx((1 - 0.485) / 0.229) and made[2].max() == pytest.approx((1 - 0.406) / 0.225)
