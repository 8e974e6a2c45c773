import numpy as np
import pytest
from pyspark.sql import functions as F

from fernlake.llm import ann_search
from tests.llm.test_models import brute


def skewed(kind, rng, n=4000, d=16):
    x = rng.normal(size=(n, d))
    if kind == "heavy lengths":
        x *= np.exp(2 * rng.normal(size=(n, 1)))
    elif kind == "one far cluster":
        x[rng.choice(n, 400, replace=False)] = 30 * rng.normal(size=d) + 0.001 * rng.normal(size=(400, d))
    elif kind == "one wide axis":
        x[:, 0] *= 1000
    return x


@pytest.mark.parametrize("kind", ["none", "heavy lengths", "one far cluster", "one wide axis"])
def test_nothing_is_missed_on_rows_that_cells_and_codes_do_not_fit(spark, monkeypatch, kind):
    monkeypatch.setattr(ann_search, "BLOCK", 200)
    monkeypatch.setattr(ann_search, "RERANK", 20)
    monkeypatch.setattr(ann_search, "SAMPLE", 300)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(skewed(kind, np.random.default_rng(3)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(8)
    got = {}
    for r in ann_search.nearest(df, F.col("vec_id") % 40 == 0, 20).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = brute([(i, np.array(v)) for i, v in rows], lambda i: i % 40 == 0, 20)
    assert got == {q: {i for i, _ in v} for q, v in want.items()}


def test_an_id_of_many_vectors_hides_no_other(spark):
    rows = [(7, [10.0 + i, 0.0]) for i in range(30)] + [(0, [1.0, 0.0])] + [(i, [1.0 + i / 100, 1.0]) for i in range(20, 30)]
    got = ann_search.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, 5).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [7, 29, 28, 27, 26]
