"""Hamming-distance self-join of 64-bit hashes.

Cut the bits into ``t + k`` bands: hashes within ``t`` bits agree in at least ``k`` of them, so an
equi-join on every choice of ``k`` bands finds all pairs, and the distance is then computed.
With one band to agree in (``k = 1``) keys are few and short; with more there are more keys of
more bits each. ``k`` follows the number of distinct hashes so that a key is not shared by
chance by more than a few of them. Hashes are joined once however many files share them.

Hashes of so few bits that it takes many keys to tell them apart have few others within ``t`` bits: these are
spelt out and looked up, so the rows of the join are those few for each hash.

A threshold so large that keys have but a few bits lets bands tell next to nothing apart. Then blocks of hashes are
compared with one another, every two blocks once, as arrays: a comparison costs a few nanoseconds, and a task holds two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, comb, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernlake.runtime import exchanged, materialize

#: Most keys of a hash.
MOST_KEYS = 120
#: Of all pairs the share that may meet by keys; a row of a join costs some thirty comparisons of arrays.
MOST_MET = 1 / 30
#: Hashes of a block, at least, and most blocks.
BLOCK, BLOCKS = 8192, 256
#: Names of files with one hash that are kept as one array.
NAMES = 1000


def bands_to_agree(n: int, threshold: int, bits: int = 64) -> int:
    """The fewest bands whose bits tell ``n`` hashes apart, within the number of keys allowed."""
    k = 1
    while k * bits / (threshold + k) < log2(max(2, n)) and comb(threshold + k + 1, k + 1) <= MOST_KEYS and threshold + k + 1 <= bits:
        k += 1
    return k


def keys_sql(hash_col: str, threshold: int, agree: int, bits: int = 64) -> str:
    """An array of (choice, value) structs, one for each choice of ``agree`` of the bands; value holds their bits."""
    count = min(threshold + agree, bits)
    edges = [bits * i // count for i in range(count + 1)]
    made = []
    for i, chosen in enumerate(combinations(range(count), min(agree, count))):
        mask = sum(((1 << (edges[b + 1] - edges[b])) - 1) << edges[b] for b in chosen)
        made.append(f"named_struct('choice', {i}, 'value', {hash_col} & {mask - (1 << 64) if mask >= 1 << 63 else mask}L)")
    return f"array({', '.join(made)})"


def compared_blocks(own: DataFrame, n: int, threshold: int) -> DataFrame:
    """``a, b, distance`` of the hashes of ``own`` (``hash``, ``n`` of them), each with each."""
    count = min(BLOCKS, max(1, ceil(n / BLOCK)))
    blocks = own.groupBy(F.pmod(F.xxhash64("hash"), F.lit(count)).alias("block")).agg(F.collect_list("hash").alias("all"))
    left = blocks.select(F.col("block").alias("i"), F.explode(F.sequence("block", F.lit(count - 1).cast("long"))).alias("j"), F.col("all").alias("x"))
    right = blocks.select(F.explode(F.sequence(F.lit(0).cast("long"), "block")).alias("i"), F.col("block").alias("j"), F.col("all").alias("y"))
    # as many partitions as there are pairs of blocks to deal, so that none has many
    tasks = max(1, min(count * (count + 1) // 2, 4 * int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                i, j = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                x, y = (batch.column(c)[row].values.to_numpy().view(np.uint64) for c in (2, 3))
                for low in range(0, len(x), 64):
                    part = x[low : low + 64]
                    apart = np.bitwise_count(part[:, None] ^ y)
                    p, q = np.nonzero(apart <= threshold)
                    u, v, d = part[p].view(np.int64), y[q].view(np.int64), apart[p, q]
                    if i == j:
                        u, v, d = (z[u < v] for z in (u, v, d))
                    if len(u):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v)), pa.array(d.astype(np.int32))], ["a", "b", "distance"])

    met = left.repartition(tasks, "i", "j").join(exchanged(right.repartition(tasks, "i", "j")), ["i", "j"])
    return met.select("i", "j", "x", "y").mapInArrow(run, "a long, b long, distance int")


def looked_up_neighbours(own: DataFrame, threshold: int, bits: int) -> DataFrame:
    """``a, b, distance`` of the hashes of ``own``, of ``bits`` bits: all numbers within ``threshold`` bits of each, met with the hashes."""
    masks = [sum(1 << b for b in chosen) for i in range(1, threshold + 1) for chosen in combinations(range(bits), i)]
    masks = F.lit([m - (1 << 64) if m >> 63 else m for m in masks]).cast("array<long>")
    # few hashes are a small file and few tasks; their neighbours need more
    tasks = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = own.repartition(tasks, "hash").select(F.col("hash").alias("a"), F.explode(masks).alias("mask"))
    near = near.select("a", F.col("a").bitwiseXOR(F.col("mask")).alias("b")).filter("a < b")
    return near.join(exchanged(own.select(F.col("hash").alias("b"))), "b").select("a", "b", F.expr("bit_count(a ^ b)").alias("distance"))


def distinct_pairs(hashes: DataFrame, threshold: int, bits: int = 64) -> DataFrame:
    """``a, b, distance`` for distinct hashes (column ``hash``) with ``a < b`` and ``0 < distance <= threshold``."""
    if threshold < 0:
        raise ValueError("the threshold is not negative")
    own = hashes.select("hash").filter("hash is not null").distinct()
    if threshold >= bits:
        raise ValueError("the threshold is below the number of bits")
    n = own.count()
    agree = bands_to_agree(n, threshold, bits)
    bands = min(threshold + agree, bits)
    # both sides' keys are exchanged, and what they meet by chance too; of the neighbours one side's half
    if sum(comb(bits, i) for i in range(1, threshold + 1)) <= 4 * comb(bands, min(agree, bands)):
        return looked_up_neighbours(own, threshold, bits)
    if comb(bands, min(agree, bands)) * 2.0 ** -(bits // bands * min(agree, bands)) > MOST_MET:
        return compared_blocks(own, n, threshold)
    keyed = own.select(F.expr(f"inline({keys_sql('hash', threshold, agree, bits)})"), "hash")
    joined = keyed.withColumnRenamed("hash", "a").join(exchanged(keyed.withColumnRenamed("hash", "b")), ["choice", "value"])
    return joined.filter(f"a < b and bit_count(a ^ b) <= {threshold}").select("a", "b").distinct().withColumn("distance", F.expr("bit_count(a ^ b)"))


def similar_pairs(encodings: DataFrame, threshold: int, bits: int = 64) -> DataFrame:
    """``left_name, right_name, distance`` with ``left_name < right_name``, for rows ``file_name, hash``.

    Files without a name or hash have no pair. Repeated rows count once. This spells out all pairs, as a
    list of duplicates must; grouping works on distinct hashes instead.
    """
    rows = encodings.select("file_name", "hash").filter("hash is not null and file_name is not null")
    seen = rows.groupBy("file_name").agg(F.min("hash").alias("hash"), F.max("hash").alias("most"))
    seen, _ = materialize(seen, "seen")
    one = seen.filter("hash = most").select("file_name", "hash", F.lit(False).alias("several"))
    several = seen.filter("hash <> most").select("file_name")
    whole = several.isEmpty()
    files = one if whole else one.union(rows.join(exchanged(several), "file_name").distinct().select("file_name", "hash", F.lit(True)))
    close, _ = materialize(distinct_pairs(files, threshold, bits), "close")
    # names go with their hash in arrays of a bounded length, so pairs are spelt out last and never exchanged or sorted
    parts = files.groupBy("hash").agg(F.ceil(F.count("*") / NAMES).alias("parts"))
    dealt = files.join(exchanged(parts), "hash").withColumn("part", F.pmod(F.xxhash64("file_name"), F.col("parts")))
    held, _ = materialize(dealt.groupBy("hash", "part").agg(F.collect_list(F.struct("file_name", "several")).alias("files")), "names")
    sides = [held.select(F.col("hash").alias(h), F.col("files").alias(f)) for h, f in (("a", "ms"), ("b", "ns"))]
    far = close.join(exchanged(sides[0]), "a").join(exchanged(sides[1]), "b").select("ms", "ns", "distance")
    same = held.select("hash", F.col("part").alias("p"), F.col("files").alias("ms")).join(exchanged(held.select("hash", F.col("part").alias("q"), F.col("files").alias("ns"))), "hash").filter("p <= q")
    far = far.select(F.explode("ms").alias("m"), "ns", "distance").select("m", F.explode("ns").alias("n"), "distance").filter("m.file_name <> n.file_name")
    same = same.select("p", "q", F.explode("ms").alias("m"), "ns").select("p", "q", "m", F.explode("ns").alias("n")).filter("m.file_name < n.file_name or (p < q and m.file_name > n.file_name)")
    both = far.union(same.select("m", "n", F.lit(0).alias("distance"))).select(F.least("m.file_name", "n.file_name").alias("left_name"), F.greatest("m.file_name", "n.file_name").alias("right_name"), F.col("distance").cast("int").alias("distance"), (F.col("m.several") | F.col("n.several")).alias("several"))
    if whole:  # each pair comes up once
        return both.drop("several")
    again = both.filter("several").groupBy("left_name", "right_name").agg(F.min("distance").alias("distance"))
    return both.filter("not several").drop("several").union(again)
