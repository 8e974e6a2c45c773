"""How common shingles are in all texts, from a table of counters of a fixed size.

Every distinct shingle of every text adds one to the counter that its hash falls on. Tasks count into
tables of their own, which are compressed, added up in two shuffles (the first by a salt, so that no task
adds up those of all tasks) and brought to one byte a counter. What a counter holds beyond what chance
puts on each tells common shingles; rare ones all have rank zero.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Counters, counters that are added up together, and parts of the first shuffle.
SLOTS, CHUNK, SALTS = 1 << 23, 1 << 16, 16
SCHEMA = "chunk int, salt int, width int, counts binary"


def _packed(chunk: int, salt: int, counts: np.ndarray) -> pa.RecordBatch:
    width = 1 if counts.max() < 256 else 8
    raw = pa.compress(counts.astype(f"<u{width}").tobytes(), codec="zstd", asbytes=True)
    return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([salt], pa.int32()), pa.array([width], pa.int32()), pa.array([raw], pa.binary())], ["chunk", "salt", "width", "counts"])


def _unpacked(width: int, raw: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw, decompressed_size=CHUNK * width, codec="zstd", asbytes=True), f"<u{width}")


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows of one chunk and salt as one row."""
    at, held = None, None
    for batch in batches:
        for chunk, salt, width, raw in zip(*(c.to_pylist() for c in batch.columns)):
            if (chunk, salt) != at:
                if at:
                    yield _packed(*at, held)
                at, held = (chunk, salt), np.zeros(CHUNK, np.uint64)
            held += _unpacked(width, raw)
    if at:
        yield _packed(*at, held)


def shingle_ranks(docs: DataFrame, hashes: Callable[[str | None], np.ndarray], text_col: str) -> np.ndarray:
    """One byte for each counter: 0 for what chance alone explains, else one more than eight times the base-two logarithm of the excess, at most 255."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt, counts = TaskContext.get().partitionId() % SALTS, np.zeros(SLOTS, np.uint32)
        for batch in batches:
            for text in batch.column(0):
                np.add.at(counts, (hashes(text.as_py()) & np.uint64(SLOTS - 1)).astype(np.int64), 1)
        for chunk, part in enumerate(counts.reshape(-1, CHUNK)):
            if part.any():
                yield _packed(chunk, salt, part)

    own = docs.select(F.col(text_col).alias("t")).mapInArrow(run, SCHEMA)
    for salt in (F.col("salt"), F.lit(0)):
        own = own.withColumn("salt", salt).repartition("chunk", "salt").sortWithinPartitions("chunk", "salt").mapInArrow(_added, SCHEMA)
    # SLOTS counters, however many texts there are; they stay compressed, and the driver unpacks one chunk at a time
    rows = [(r["chunk"], r["width"], r["counts"]) for r in own.toArrow().to_pylist()]
    usual, ranks = _median([(width, raw) for _, width, raw in rows]), np.zeros(SLOTS, np.uint8)
    for chunk, width, raw in rows:
        ranks[chunk * CHUNK : (chunk + 1) * CHUNK] = ranks_of(_unpacked(width, raw), usual)
    return ranks


def _median(chunks: list[tuple[int, bytes]]) -> float:
    """The median of all counters; chunks that are not there hold zeros."""
    times = Counter({0: SLOTS - CHUNK * len(chunks)})
    for width, raw in chunks:
        times.update(dict(zip(*(x.tolist() for x in np.unique(_unpacked(width, raw), return_counts=True)))))
    values = sorted(v for v in times if times[v])
    ends = np.cumsum([times[v] for v in values])
    return sum(values[int(np.searchsorted(ends, at, "right"))] for at in (SLOTS // 2 - 1, SLOTS // 2)) / 2


def ranks_of(counts: np.ndarray, usual: float) -> np.ndarray:
    # half of the counters hold no more than the median, which a few very common shingles do not move
    excess = counts - (usual + 4 * np.sqrt(usual) + 1)
    return np.where(excess >= 1, np.minimum(8 * np.log2(np.maximum(excess, 1)) + 1, 255), 0).astype(np.uint8)


def rank_of_count(excess: float) -> int:
    """The rank that so many texts above chance have."""
    return int(min(8 * np.log2(excess) + 1, 255))


def looked_up(hashes: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    return ranks[(hashes & np.uint64(len(ranks) - 1)).astype(np.int64)]
