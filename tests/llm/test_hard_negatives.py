"""Norm-bucketed search against all pairs, with norms that differ, ties, and odd rows."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fernlake.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int, id string, norm2 int"
NAMES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def _slow(rows, every, k=5):
    kept = {(i, tuple(math.floor(256 * x) for x in v), label) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, v, label in kept:
        if i % every:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), j, other == label) for j, w, other in kept if j != i]
        for ps, p in sorted((s, j) for s, j, same in scored if same)[:k]:
            window = sorted((s, j) for s, j, same in scored if not same and 80 * -ps <= 100 * -s <= 100 * -ps)[:k]
            out += [(i, p, r, j, -ps, -s) for r, (s, j) in enumerate(window, 1)]
    return sorted(out)


def _found(spark, rows, every, **options):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    got = hn.hard_negatives(frame, F.col("vec_id") % every == 0, **options)
    assert got.columns == NAMES
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("spread", [0.0, 1.5])
@pytest.mark.parametrize("bucket_rows", [40, 1 << 16])
def test_equals_all_pairs(spark, spread, bucket_rows):
    draw = np.random.default_rng(3)
    base = draw.normal(size=(12, 6))
    x = base[draw.integers(0, 12, 300)] + 0.3 * draw.normal(size=(300, 6))
    x *= np.exp(spread * draw.normal(size=(300, 1)))
    rows = [(i, v.tolist(), int(draw.integers(0, 3))) for i, v in enumerate(x)]
    assert _found(spark, rows, 10, bucket_rows=bucket_rows) == _slow(rows, 10)


def test_ties_repeats_and_odd_rows(spark):
    rows = [(i, [0.5, 0.25], i % 2) for i in range(60)]  # all alike: only ids order them
    rows += [(100 + i, [0.0, 0.0], i % 2) for i in range(8)] + [(200 + i, [-1.0, 0.5, 0.125 * i], 1) for i in range(6)]
    rows += [(0, [0.5, 0.25], 0), (10, [1.0], 0), (10, [0.25, 1.0], 1), (None, [9.0, 9.0], 0), (20, [2.0, 2.0], None), (30, None, 1)]
    rows += [(40, [float("nan"), 1.0], 1), (50, [float("inf"), 1.0], 1), (300, [None, 3.0], 0), (310, [], 0), (-10, [0.75, 0.75], 0), (301, [1e200, 0.0], 0)]
    plain = [r for r in rows if r[0] != 301]  # too long for a long: takes no part
    for size in (7, 1 << 16):
        assert _found(spark, rows, 10, bucket_rows=size) == _slow(plain, 10)


def test_large_components_are_exact(spark):
    rows = [(i, [1e6 + i, -2e6 + 3 * i, 5e5 - i, 3e6], i % 3) for i in range(80)]
    assert _found(spark, rows, 20) == _slow(rows, 20)


def test_empty(spark):
    assert _found(spark, [], 10) == []
    assert _found(spark, [(1, [1.0], 1)], 10) == []


def test_sql_agrees(spark, data):
    sql = duckdb.connect()
    sql.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{data}/embeddings.parquet')")
    got = hn.query(spark, data).select(NAMES).collect()
    assert sorted(map(tuple, got)) == sorted(sql.execute(f"SELECT {', '.join(NAMES)} FROM ({hn.SQL})").fetchall())
    assert len(got) > 20


def test_long_norms_alone_are_met():
    """Blocks whose bound lies below the limit are never opened."""
    import pyarrow as pa

    anchors = pa.table({"key": [1], "id": [1], "label": [0], "norm2": [100], "v": pa.array([[10, 0]], pa.list_(pa.int64())), "windows": pa.array([[{"w": 0, "lo": 60, "hi": 10**9}]], pa.list_(pa.struct([("w", pa.int32()), ("lo", pa.int64()), ("hi", pa.int64())])))})
    closed = {"n": 1, "top": 35, "ids": b"", "labels": b"", "width": 2, "vectors": b"broken"}
    opened = {"n": 2, "top": 49, "ids": np.array([5, 4]).tobytes(), "labels": np.array([0, 0]).tobytes(), "width": 2, "vectors": np.array([[7, 0], [6, 1]], "<i2").tobytes()}
    got = hn._meet(anchors, pa.Table.from_pylist([closed, opened]), 2, True, 5)
    assert [x.tolist() for x in got] == [[1, 1], [0, 0], [5, 4], [70, 60]]
