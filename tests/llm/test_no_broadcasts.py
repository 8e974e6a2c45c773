"""Tables that grow with the input never become hash tables in the driver, however small their files are."""

from fernlake.llm import simhash
from fernlake.operators.components import _large_star, _small_star


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_fingerprints_and_components_are_joined_by_exchanges(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert "BroadcastHashJoin" not in plan(simhash.near_duplicates(docs))
    assert "BroadcastHashJoin" not in plan(simhash.similar_rows(docs))
    edges = spark.createDataFrame([(2, 1), (3, 1)], "u long, v long")
    for step in (_large_star, _small_star):
        assert "BroadcastHashJoin" not in plan(step(edges).select("u"))
    fps = spark.createDataFrame([(5,), (7,)], "fp long")
    assert "BroadcastHashJoin" not in plan(simhash.close_pairs(fps))
