import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_rows_that_share_an_id_stand_for_themselves(spark, data):
    passage = spark.read.parquet(f"{data}/benchmark.parquet").first()["text"]
    texts = ["one clean text of its own here", "another clean text that has nothing to do with it", passage]
    docs = spark.createDataFrame([(5, t, "en", "s", 1) for t in texts + texts[:1]], SCHEMA)
    alone = corpus_pipeline.drop_near_duplicates(spark, docs, data)
    assert sorted(r["text"] for r in alone.collect()) == sorted(texts)
    clean = corpus_pipeline.drop_contaminated(spark, alone, data)
    assert sorted(r["text"] for r in clean.collect()) == sorted(texts[:2])
