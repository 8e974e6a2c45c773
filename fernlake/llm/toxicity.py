"""Toxicity by FTRL-proximal logistic regression over hashed word features.

Features are the distinct words, word pairs and skip-grams (one word left out) of a whole text,
hashed to ``2**BITS`` coordinates. FTRL-proximal keeps a learning rate for each coordinate and
an L1 pull that leaves most weights at exactly zero, so the model is a short list of
coordinates and weights, whatever the corpus holds; it is broadcast to the scorers.

Training takes a bounded sample of the labelled rows: at most ``SAMPLE`` of each label, those
with the smallest hash of their id. Scoring is one narrow pass over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, log
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fernlake.llm.chunks import slices

BITS = 20
#: Most labelled documents of each label that training reads.
SAMPLE = 4000
#: L1 is ``L1_SHARE`` of the number of training rows, ``L1_LEAST`` at least.
EPOCHS, ALPHA, BETA, L1_SHARE, L1_LEAST, L2 = 5, 0.3, 1.0, 0.005, 6.0, 1.0
PAIR, SKIP = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)
#: ASCII bytes that are not letters or digits end a word.
BREAK = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def word_hashes(text: str | None) -> np.ndarray:
    words = (text or "").lower().encode("utf-8", "surrogatepass").translate(BREAK).split()
    return np.array(list(map(crc32, words)), np.uint32)


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """Distinct coordinates of a text, ascending; none for a text without words."""
    one = word_hashes(text)
    two = one[:-1] * PAIR + one[1:]
    gap = (one[:-2] * SKIP + one[2:]) ^ SKIP
    return np.unique(np.concatenate([one, two, gap]) >> np.uint32(32 - bits))


class FTRL:
    """FTRL-proximal for sparse binary features; coordinate ``2**bits`` is the bias, free of L1."""

    def __init__(self, bits: int = BITS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1_LEAST, l2: float = L2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(2**bits + 1), np.zeros(2**bits + 1)
        self.bias = 2**bits

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == self.bias, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: int, weight: float = 1.0) -> None:
        at = np.append(at.astype(np.int64), self.bias)
        w = self.weights(at)
        g = weight * (1 / (1 + exp(-max(-35.0, min(35.0, float(w.sum()))))) - label)
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g

    def model(self) -> tuple[np.ndarray, float]:
        w = np.zeros(self.bias, np.float32)
        for low in range(0, self.bias, 65_536):  # a part at a time: all of it as doubles several times over is much for a driver
            w[low : low + 65_536] = self.weights(np.arange(low, min(low + 65_536, self.bias)))
        return w, float(self.weights(np.array([self.bias]))[0])


def train(rows: list[tuple[np.ndarray, int]], epochs: int = EPOCHS, seed: int = 0, **options) -> tuple[np.ndarray, float]:
    """Dense weights and bias; each label weighs the same in total.

    Without rows of both labels there are no weights, and the bias is the smoothed log odds of the label, below zero without any rows.
    """
    learner = FTRL(**{"l1": max(L1_LEAST, L1_SHARE * len(rows))} | options)
    share = np.bincount([y for _, y in rows], minlength=2) if rows else np.zeros(2)
    if share.min() > 0:
        order = np.random.default_rng(seed)
        for _ in range(epochs):
            for i in order.permutation(len(rows)):
                learner.learn(rows[i][0], rows[i][1], len(rows) / (2 * share[rows[i][1]]))
        return learner.model()
    return np.zeros(learner.bias, np.float32), log((share[1] + 0.5) / (share[0] + 1.5))


def score(at: np.ndarray, weights: np.ndarray, bias: float) -> float:
    return 1 / (1 + exp(-max(-35.0, min(35.0, float(weights[at].sum(dtype=np.float64)) + bias))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[np.ndarray, float]:
    """Learn from labelled rows that are not held out.

    Rows without id or label are left out, an id labelled more than once counts as toxic if any
    of its labels does, an id with several texts is learnt from the smallest. At most
    ``2 * sample`` rows' features reach the driver.
    """
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col))).groupBy(F.col(id_col).cast("long").alias("k")).agg(F.max(label_col).cast("int").alias("y"))
    ranked = [known.filter(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(sample) for y in (0, 1)]
    chosen = F.broadcast(ranked[0].union(ranked[1]))
    texts = docs.select(F.col(id_col).cast("long").alias("k"), F.coalesce(text_col, F.lit("")).alias("t")).join(chosen, "k").groupBy("k").agg(F.min(F.struct("t", "y")).alias("r")).select("k", "r.t", "r.y")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"k": batch["k"], "y": batch["y"], "f": [features(t).astype("<u4").tobytes() for t in batch["t"]]})

    got = sorted(texts.mapInPandas(run, "k long, y int, f binary").collect())
    return train([(np.frombuffer(r["f"], "<u4"), r["y"]) for r in got])


def scorer(spark: SparkSession, model: tuple[np.ndarray, float]):
    """A column function from texts to scores; null and empty texts score by the bias alone."""
    weights, bias = model
    at = np.flatnonzero(weights)
    sent = spark.sparkContext.broadcast((at.astype(np.int32), weights[at], bias))

    @F.arrow_udf("double")
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        places, values, b = sent.value
        dense = np.zeros(2**BITS, np.float32)
        dense[places] = values
        for texts in batches:
            got = [score(features(t), dense, b) for part in slices(texts, 500) for t in part.to_pylist()]
            yield pa.array(got, pa.float64())

    return scores


def apply(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of every row; null ids and repeated rows stay, other columns are ignored."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), scorer(docs.sparkSession, model)(F.col(text_col)).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fernlake.runtime import table

    docs = table(spark, sf_dir, "documents")
    scored = apply(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
