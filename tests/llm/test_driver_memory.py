"""What Python holds: in the driver while tables of a fixed size are made, in workers while texts are encoded."""

import tracemalloc

import numpy as np
import pyarrow as pa

import corpus_pipeline
from fernlake.llm import byte_bpe, shingle_ranks, toxicity


def peak_mb(run):
    tracemalloc.start()
    try:
        out = run()
        return out, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_ranks_are_made_a_chunk_at_a_time(spark):
    """64 MB of counters several times over made the pipeline's driver too large."""
    rng = np.random.default_rng(5)
    lists = [" ".join(map(str, [*rng.integers(0, 1 << 40, 300), *range(40)])) for _ in range(400)]
    hashes = lambda text: np.array([int(x) for x in text.split()], np.uint64)
    got, most = peak_mb(lambda: shingle_ranks.shingle_ranks(spark.createDataFrame([(t,) for t in lists], "text string").repartition(3), hashes, "text"))
    assert most < 40
    counts = np.zeros(shingle_ranks.SLOTS)
    for t in lists:
        np.add.at(counts, (hashes(t) & np.uint64(shingle_ranks.SLOTS - 1)).astype(np.int64), 1)
    usual = np.median(counts)
    excess = counts - (usual + 4 * np.sqrt(usual) + 1)
    want = np.where(excess >= 1, np.minimum(8 * np.log2(np.maximum(excess, 1)) + 1, 255), 0).astype(np.uint8)
    assert np.array_equal(got, want) and (want[:40] > 60).all()


def test_the_median_of_counters_is_that_of_all():
    rng = np.random.default_rng(6)
    chunks = [rng.poisson(m, shingle_ranks.CHUNK).astype(np.uint64) for m in rng.uniform(0, 9, 70)]
    packed = [(8, shingle_ranks._packed(0, 0, c + np.uint64(300)).column(3)[0].as_py()) for c in chunks]
    whole = np.concatenate([*(c + np.uint64(300) for c in chunks), np.zeros(shingle_ranks.SLOTS - 70 * shingle_ranks.CHUNK, np.uint64)])
    assert shingle_ranks._median(packed) == np.median(whole)


def test_a_toxicity_model_is_read_out_in_parts():
    learner = toxicity.FTRL(l1=0.5)
    rng = np.random.default_rng(7)
    for i in range(300):
        learner.learn(np.unique(rng.integers(0, learner.bias, 200)), i % 2)
    (weights, bias), most = peak_mb(learner.model)
    assert most < 20
    whole = learner.weights(np.arange(learner.bias + 1))
    assert np.array_equal(weights, whole[:-1].astype(np.float32)) and bias == whole[-1]


def test_ids_are_made_of_few_texts_at_once():
    """The chunks and ids of 2,000 texts at a time, beside what a worker remembers, made the pipeline's executors too large."""
    rng = np.random.default_rng(8)
    alphabet = np.array(list("abcdefghijklmnop"))
    texts = [" ".join("".join(w) for w in alphabet[rng.integers(0, 16, (60, 4))]) for _ in range(2000)]
    bpe = byte_bpe.PrefixBPE({bytes([i]): i for i in range(256)}, r" ?\S+|\s+", remember=100)
    total, most = peak_mb(lambda: sum(len(ids) for ids in bpe.column_ids(pa.array(texts))))
    assert total == sum(map(len, texts))
    assert most < 8


def test_the_pipeline_encodes_batches_of_bounded_size(spark, tmp_path, monkeypatch):
    """Spark's 10,000 texts in a batch are in an executor's JVM and again in its worker; a session's smaller batches stay."""
    before = spark.conf.get(corpus_pipeline.BATCH_CONF)
    docs = spark.range(0, 5000, 1, 1).selectExpr("id as doc_id", "concat('text ', id) as text")
    seen = tmp_path / "rows"

    def ids(docs, ranks_path, pattern):
        def run(batches):
            for batch in batches:
                with open(seen, "a") as out:
                    out.write(f"{batch.num_rows}\n")
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[1]] * batch.num_rows, pa.list_(pa.int32()))], ["doc_id", "ids"])

        return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")

    monkeypatch.setattr(byte_bpe, "encode_documents", ids)
    try:
        for given, most in (("10000", 2000), ("0", 2000), ("700", 700)):
            spark.conf.set(corpus_pipeline.BATCH_CONF, given)
            seen.write_text("")
            corpus_pipeline.encode(spark, docs, "").collect()
            rows = [int(n) for n in seen.read_text().split()]
            assert max(rows) == most and sum(rows) == 5000
    finally:
        spark.conf.set(corpus_pipeline.BATCH_CONF, before)
