import corpus_pipeline
from fernlake.llm import simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_near_duplicates_go_through_the_fingerprints(spark, data, monkeypatch):
    """Texts whose fingerprints link are one group also where their shingle sets are not 0.8 alike, and across such a link."""
    texts = {1: "a first text about rivers and lakes", 2: "some other words on hills and roads", 3: "some other words on hills and roads", 4: "nothing of the kind at all here today"}
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts.items()], SCHEMA)
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, data).collect()) == [1, 2, 4]
    near = {"a first": 0b11, "some ot": 0b10, "nothing": 0b11111 << 40}
    marks = {t: f for t in texts.values() for p, f in near.items() if t.startswith(p)}

    def planted(frame, shingle_words, id_col, text_col):
        made = spark.createDataFrame(list(marks.items()), "t string, fp long")
        return frame.join(made, frame[text_col] == made["t"]).selectExpr(f"{id_col} as doc_id", "fp")

    monkeypatch.setattr(simhash, "fingerprints", planted)
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, data).collect()) == [1, 4]
