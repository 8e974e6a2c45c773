import corpus_pipeline
from fernlake.llm import secret_scan
from tests.llm.test_near_duplicates import similar_groups
from tests.llm.test_tokens import RANKS

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_are_named_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "encoding"]


def test_each_stage_on_its_input(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["toxicity"](spark, docs, data)
    assert kept.columns == COLUMNS and 0 < kept.count() <= docs.count()
    alone = stages["near_duplicates"](spark, docs, data)
    group = similar_groups({r["doc_id"]: r["text"] for r in docs.collect()})
    assert sorted(r["doc_id"] for r in alone.collect()) == sorted(d for d, g in group.items() if d == g)
    clean = stages["decontamination"](spark, docs, data)
    texts = {r["text"] for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()}
    assert {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in clean.collect()} >= {r["doc_id"] for r in docs.collect() if any(t in r["text"] for t in texts)}
    safe = stages["secrets"](spark, docs, data).collect()
    guesser = secret_scan.Guesser(secret_scan.ranked_words(docs))
    assert [r["text"] for r in sorted(safe)] == [secret_scan.redact(r["text"], guesser) for r in sorted(docs.collect())]
    assert all(r["n_chars"] == len(r["text"]) for r in safe)


def test_the_run_encodes_what_is_kept(spark, data):
    from fernlake.llm import byte_bpe
    import public_tokenizers

    out = corpus_pipeline.run(spark, data)
    assert out.columns == ["doc_id", "n_tokens", "ids"]
    bpe = byte_bpe.codec(RANKS, public_tokenizers.PATTERN)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in out.collect():
        assert r["n_tokens"] == len(r["ids"]) and bpe.decode(r["ids"]).decode() == secret_scan.redact(texts[r["doc_id"]])


def test_nulls_repeats_and_nothing(spark, data):
    rows = [(None, "one lonely text", None, None, None), (None, None, None, None, None), (7, "copy of a text here", "en", "s", 5), (7, "copy of a text here", "en", "s", 5), (9, "Copy of a  text here", "en", "s", 5)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, data).collect()), key=repr)
    assert got == sorted([(7, "copy of a text here"), (None, "one lonely text"), (None, None)], key=repr)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), data).count() == 0, name
        assert stage(spark, docs, data).count() >= 1, name
