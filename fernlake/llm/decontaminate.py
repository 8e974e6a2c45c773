"""Benchmark passages in documents, found by spaced seeds and verified with substitutions.

A mask keeps some of a few neighbouring words and ignores the others, so a seed still matches
where an ignored word was replaced. Every place of every benchmark item and of every document is
hashed under each mask; equal hashes are joined. A hit fixes how item and document are
aligned, and around it the longest stretch is sought in which at least ``SIMILARITY`` of the words
agree. A document is contaminated by an item if that stretch has ``LEAST_WORDS`` words
(or, of a shorter item, all of it).

Before the join documents drop the hashes that no benchmark item has. The bitmap for that
has a fixed size; where the benchmark has more seeds than ``BITMAP_SEEDS``, all hashes go to the
join instead. What is verified carries a document's words only under the item, so a passage that
a document repeats many times costs as many rows of its own length.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernlake.runtime import materialize

#: Kept (1) and ignored (0) words. Of any mask of weight five one place matches unless a kept word differs.
MASKS = ("111011", "110111", "1101101", "10111001", "11111")
#: Items of 10 and 11 words need one more for two substitutions (words 3 and 5, 4 and 5 or 4 and 6, from 0).
BRIEF_MASK, BRIEF_WORDS = "11000111", range(8, 12)
SIMILARITY, LEAST_WORDS = 0.8, 13
#: Items of fewer words than the longest mask are matched verbatim, those of fewer than this never.
SHORT_LEAST = 5
SPAN = max(map(len, MASKS))
#: Words of a document kept on either side of a hit.
CONTEXT = 160
BITMAP_SEEDS, BITMAP_BITS = 4_000_000, 27
BREAK = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Documents that a worker hashes together.
TOGETHER = 500
REGION = pa.schema([("region", pa.int64()), ("doc_id", pa.int64()), ("offset", pa.int64()), ("tokens", pa.list_(pa.int32())), ("hits", pa.list_(pa.struct([("h", pa.int64()), ("place", pa.int32())])))])


def words(text: str | None) -> np.ndarray:
    """32-bit hashes of the lower-cased words; ASCII punctuation separates words."""
    cut = (text or "").lower().encode("utf-8", "surrogatepass").translate(BREAK).split()
    return np.array(list(map(crc32, cut)), np.uint32)


def seeds(tokens: np.ndarray, kept: tuple[int, ...], tag: int) -> np.ndarray:
    """One 64-bit hash for each place at which all kept words lie inside ``tokens``."""
    places = len(tokens) - kept[-1]
    if places <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(places, tag + 1, np.uint64)
    for k in kept:
        h = (h ^ tokens[k : k + places]) * MIX
        h ^= h >> np.uint64(29)
    return h


def kept_of(mask: str) -> tuple[int, ...]:
    return tuple(i for i, c in enumerate(mask) if c == "1")


def patterns(short_lengths: list[int], brief: bool = False) -> list[tuple[tuple[int, ...], int]]:
    """Masks with their tags, then one of all ones for each length of a short item."""
    masks = [*MASKS, BRIEF_MASK] if brief else MASKS
    return [(kept_of(m), t) for t, m in enumerate(masks)] + [(tuple(range(n)), 100 + n) for n in short_lengths]


def item_seeds(tokens: np.ndarray) -> list[tuple[int, int]]:
    """``(hash, place)`` of an item: under every mask, or verbatim if it is short."""
    if len(tokens) < SHORT_LEAST:
        return []
    use = patterns([], len(tokens) in BRIEF_WORDS) if len(tokens) >= SPAN else patterns([len(tokens)])[len(MASKS) :]
    return [(int(h), at) for kept, tag in use for at, h in enumerate(seeds(tokens, kept, tag).view(np.int64))]


def longest_alike(same: np.ndarray, similarity: float = SIMILARITY) -> tuple[int, int]:
    """The longest ``[a, b)`` with at least ``similarity`` of its entries true, the leftmost of such."""
    gain = np.concatenate([[0.0], np.cumsum(np.where(same, 1 - similarity, -similarity))])
    low = np.minimum.accumulate(gain)
    high = np.maximum.accumulate(gain[::-1])[::-1]
    best = at = a = b = 0
    while b < len(gain):  # a moves over prefix minima, b over suffix maxima
        if high[b] >= low[a] - 1e-9:
            if b - a > best:
                best, at = b - a, a
            b += 1
        else:
            a += 1
            b = max(b, a)
    return at, at + best


def verify(document: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int]:
    """Start in the document, length and agreeing words of the best stretch; item word i lies at ``shift + i``."""
    a, b = max(0, shift), min(len(document), shift + len(item))
    if b <= a:
        return 0, 0, 0
    same = document[a:b] == item[a - shift : b - shift]
    i, j = longest_alike(same)
    return a + i, j - i, int(same[i:j].sum())


def _bitmap(hashes: np.ndarray) -> np.ndarray:
    bits = min(BITMAP_BITS, max(16, int(32 * max(1, len(hashes))).bit_length()))
    full = np.zeros(1 << bits, bool)
    full[hashes >> np.uint64(64 - bits)] = True
    return full


def _regions(keys: list, texts: list[str | None], use: list, sieve: tuple[np.ndarray, np.ndarray] | None) -> Iterator[dict]:
    """Stretches of some documents around their hits; hits less than ``CONTEXT`` words apart share one."""
    each = [words(t) for t in texts]
    joined, ends = np.concatenate(each), np.cumsum([len(t) for t in each])
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for kept, tag in use:
        h = seeds(joined, kept, tag)
        at = np.arange(len(h))
        if sieve is not None:
            bitmap, known = sieve
            at = np.flatnonzero(bitmap[h >> np.uint64(64 - (len(bitmap).bit_length() - 1))])
            near = np.minimum(np.searchsorted(known, h[at]), len(known) - 1)
            at = at[known[near] == h[at]] if len(known) else at[:0]
        inside = np.searchsorted(ends, at, "right") == np.searchsorted(ends, at + kept[-1], "right")
        found.append((at[inside], h[at[inside]]))
    place = np.concatenate([f[0] for f in found])
    order = np.argsort(place, kind="stable")
    place, hashes = place[order], np.concatenate([f[1] for f in found]).view(np.int64)[order]
    owner = np.searchsorted(ends, place, "right")
    cuts = (np.flatnonzero((np.diff(owner) != 0) | (np.diff(place) > CONTEXT)) + 1).tolist()
    for lo, hi in zip([0, *cuts], [*cuts, len(place)]):
        if hi > lo:
            d = owner[lo]
            first = ends[d] - len(each[d])
            a, b = max(first, place[lo] - CONTEXT), min(ends[d], place[hi - 1] + SPAN + CONTEXT)
            hits = [{"h": h, "place": p} for h, p in zip(hashes[lo:hi].tolist(), (place[lo:hi] - a).tolist())]
            yield {"doc_id": keys[d], "offset": int(a - first), "tokens": joined[a:b].view(np.int32), "hits": hits}


def alignments(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, offset, tokens, item, shift``: each place of an item that a seed says, with the words under it.

    ``tokens`` begin at word ``offset`` of the document; word i of the item lies at ``shift + i`` of them.
    """
    spark = docs.sparkSession

    def of_items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            tokens = [words(t) for t in batch["t"]]
            yield pd.DataFrame({"item_id": batch["k"], "item": [t.view(np.int32) for t in tokens], "seeds": [[{"h": h, "place": p} for h, p in item_seeds(t)] for t in tokens]})

    items, _ = materialize(
        benchmark.select(F.col(item_col).cast("long").alias("k"), F.col(item_text_col).alias("t")).mapInPandas(of_items, "item_id long, item array<int>, seeds array<struct<h:long,place:int>>").withColumn("row", F.monotonically_increasing_id()),
        "items",
    )
    sown = items.select("row", F.explode("seeds").alias("s")).select("row", "s.h", "s.place")
    lengths = [r[0] for r in items.select(F.size("item").alias("n")).filter((F.col("n") >= SHORT_LEAST) & (F.col("n") < BRIEF_WORDS.stop)).distinct().collect()]
    n_seeds = sown.count()
    known = np.array([r[0] for r in sown.select("h").distinct().collect()], np.int64).view(np.uint64) if n_seeds <= BITMAP_SEEDS else None
    sent = spark.sparkContext.broadcast(None if known is None else (_bitmap(known), np.sort(known)))
    use = patterns(sorted(n for n in lengths if n < SPAN), any(n in BRIEF_WORDS for n in lengths))

    def of_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, count = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            for low in range(0, batch.num_rows, TOGETHER):
                keys, texts = (c.slice(low, TOGETHER).to_pylist() for c in batch.columns)
                rows = [{"region": base + count + i, **row} for i, row in enumerate(_regions(keys, texts, use, sent.value))]
                count += len(rows)
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, REGION)

    regions, _ = materialize(
        docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t")).mapInArrow(of_documents, "region long, doc_id long, offset long, tokens array<int>, hits array<struct<h:long,place:int>>"),
        "regions",
    )
    hits = regions.select("region", F.explode("hits").alias("s")).select("region", "s.h", F.col("s.place").alias("there"))
    aligned = hits.join(sown, "h").select("region", "row", (F.col("there") - F.col("place")).alias("shift")).distinct()
    # of a region each alignment takes the words that lie under its item, no more, so rows add up to the overlaps themselves
    start = F.greatest("shift", F.lit(0))
    placed = aligned.join(items.select("row", F.size("item").alias("n")), "row").join(regions.select("region", "doc_id", "offset", "tokens"), "region")
    under = placed.select("row", "doc_id", (F.col("offset") + start).alias("offset"), (F.col("shift") - start).alias("shift"), F.slice("tokens", start + 1, F.col("shift") + F.col("n") - start).alias("tokens"))
    return under.join(items.select("row", "item_id", "item"), "row").select("doc_id", "item_id", "offset", "tokens", "item", "shift")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, at_word, overlap_words, same_words``: one row for each document and item that overlap.

    Null texts count as empty and have no overlap, nor have items of fewer than ``SHORT_LEAST``
    words. Rows that share a doc_id or item_id count as one (the longest overlap is told); a null id
    is an id like others. Clean documents have no row. Other columns are ignored.
    """

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [verify(np.asarray(t, np.int32), np.asarray(i, np.int32), s) for t, i, s in zip(batch["tokens"], batch["item"], batch["shift"])]
            frame = pd.DataFrame(got, columns=["start", "overlap_words", "same_words"])
            frame["at_word"] = frame.pop("start") + batch["offset"].to_numpy()
            frame.insert(0, "item_id", batch["item_id"].to_numpy())
            frame.insert(0, "doc_id", batch["doc_id"].to_numpy())
            need = np.minimum(LEAST_WORDS, batch["item"].map(len).to_numpy())
            yield frame[frame["overlap_words"].to_numpy() >= need]

    checked = alignments(docs, benchmark, id_col, text_col, item_col, item_text_col).mapInPandas(check, "doc_id long, item_id long, at_word long, overlap_words long, same_words long")
    best = F.max(F.struct("overlap_words", "same_words", (-F.col("at_word")).alias("back"))).alias("b")
    return checked.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", (-F.col("b.back")).alias("at_word"), "b.overlap_words", "b.same_words")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fernlake.runtime import table

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
