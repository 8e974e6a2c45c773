"""A corpus from raw documents to token ids in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept. The first
four return the columns of ``documents``; the last returns token ids. ``run`` writes every
stage's rows to the shared folder as Parquet and reads them again, so a lost executor costs
the stage at hand only.

Rows are told apart by ``doc_id`` and text: rows with the same of both are one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernlake.llm import byte_bpe, decontaminate, secret_scan, simhash, toxicity
from fernlake.operators.components import connected_components
from fernlake.runtime import Scratch, drop_path, exchanged, materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
KEY, TEXT_HASH = "_document", "_text"
#: Texts in one Arrow batch of the encoder, which an executor's JVM and a worker hold beside its memories; Spark's usual 10,000 are some 30 MB in each.
BATCH_TEXTS, BATCH_CONF = 2000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def _keyed(docs: DataFrame) -> DataFrame:
    """Documents without an id get one far above all others, made from their text."""
    made = F.lit(1 << 62) + F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(1 << 61))
    return docs.select(*COLUMNS).withColumn(KEY, F.coalesce("doc_id", made)).withColumn(TEXT_HASH, F.xxhash64("text"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores below one half."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.select(*COLUMNS).filter(toxicity.scorer(spark, model)(F.col("text")) < 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts that SimHash fingerprints or similar sets of five-word shingles link the document with the smallest id.

    Fingerprints within two bits link as in ``op4_simhash``; the exact comparison after it adds the links that fingerprints do not show.
    """
    keyed, scratch = _keyed(docs), Scratch(spark)
    marked = scratch.keep(simhash.near_duplicates(keyed, id_col=TEXT_HASH).select(F.col("doc_id").alias("text_hash"), F.col("component_id").alias("mark")).distinct(), "marked")
    rows = simhash.similar_rows(keyed, id_col=KEY).groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    rows = scratch.keep(rows, "alike")
    # groups of the one kind that share one of the other are one
    shared = scratch.keep(rows.select("root", "text_hash").distinct().join(exchanged(marked), "text_hash").select("root", "mark").distinct(), "shared")
    first = shared.groupBy("mark").agg(F.min("root").alias("first"), F.count("*").alias("roots")).filter("roots > 1").select("mark", "first")
    joined = connected_components(shared.join(exchanged(first), "mark").select("root", "first"), "root", "first")
    tops = joined.select(F.col("node").alias("root"), F.col("component").alias("top"))
    rows = scratch.keep(rows.join(exchanged(tops), "root", "left").withColumn("root", F.coalesce("top", "root")).drop("top"), "rows")
    least = rows.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("least"))
    judged = rows.join(exchanged(least), "root").select(F.col("doc_id").alias(KEY), F.col("text_hash").alias(TEXT_HASH), "n", (F.struct("doc_id", "text_hash") == F.col("least")).alias("stays"))
    told, _ = materialize(judged.filter("not stays or n > 1").select(KEY, TEXT_HASH, "stays"), "told")
    scratch.drop()
    # rows that are alone in their group are known by a bitmap and stay where they are; the others are looked up
    place = F.xxhash64(KEY, TEXT_HASH)
    looked_up = simhash.maybe_among(told.select(place.alias("h")))(place)
    alone, others = keyed.filter(~looked_up), keyed.filter(looked_up).dropDuplicates([KEY, TEXT_HASH])
    return alone.select(*COLUMNS).union(others.join(exchanged(told), [KEY, TEXT_HASH], "left").filter("stays is null or stays").select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    keyed = docs.select(*COLUMNS).withColumn(KEY, F.xxhash64("doc_id", "text"))
    found = decontaminate.contaminated(keyed, table(spark, sf_dir, "benchmark"), id_col=KEY)
    hit, _ = materialize(found.select(F.col("doc_id").alias(KEY)).distinct(), "contaminated")
    return keyed.join(hit, KEY, "left_anti").select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark; guesses are ranked by the words of all of them."""
    redacted = secret_scan.redactor(spark, secret_scan.ranked_words(docs))
    clean = docs.select("doc_id", redacted(F.col("text")).alias("text"), "lang", "source", "n_chars")
    return clean.withColumn("n_chars", F.length("text").cast("long"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` of every document; sets the session's Arrow batches to ``BATCH_TEXTS`` rows where they are larger."""
    import public_tokenizers

    if not 0 < int(spark.conf.get(BATCH_CONF)) <= BATCH_TEXTS:
        spark.conf.set(BATCH_CONF, BATCH_TEXTS)
    ids = byte_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, path = materialize(stage(spark, docs, sf_dir), name)
        if before:
            drop_path(spark, before)
        before = path
    return docs


#: Models, hashes and merges are beyond SQL; tests compare with brute force.
ORACLE_SQL = None
