"""Hard negatives by a norm-bucketed search for the largest inner products inside windows of scores.

Vectors become integers, so scores are exact. Candidates are sorted by norm, longest first, and cut into buckets
of blocks. By Cauchy-Schwarz no candidate of a block scores above ``|anchor| * (longest norm of the block)``. A
window of an anchor is a range of scores of which the first ``k`` are asked for; it is done with all blocks for which
that bound lies below its lower limit, or below its running k-th score once it has ``k``. Both are tested three
times: for groups of anchors and buckets before anything is exchanged, for each block before a product is formed,
and, between two rounds, with the k-th scores that the bucket of the longest norms has given.

Anchors are grouped by the norm that they need. A group of anchors meets a bucket in one task, whose size both
are bounded by; nothing else of either side is gathered. Where all norms are alike no bound can leave anything out,
and the work is that of all anchors times all rows, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fernlake.runtime import Scratch, materialize

K, SCALE, LEAST = 5, 256, 80
#: Rows of a bucket and of one of its blocks, anchors of a group and those whose scores are held at a time.
BUCKET, BLOCK, GROUP, TOGETHER = 65_536, 4096, 16_384, 256
#: Buckets and groups are made larger rather than more than this many: their limits pass through the driver.
PARTS = 4096
#: Ranges of needed norms that anchors are grouped by.
RANGES = 16
FAR = 1 << 62


def whole_rows(vectors: DataFrame, is_anchor: Column, id_col: str, label_col: str, vec_col: str, scale: int) -> DataFrame:
    """``id, label, v, norm2, asks`` of all rows that take part, each once; ``v`` are the integers ``floor(scale * x)``."""
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("x"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    finite = F.coalesce(F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    size = F.aggregate("x", F.lit(0.0), lambda s, x: s + (F.abs(x * scale) + 1) * (F.abs(x * scale) + 1))
    whole = F.when(finite & (size < float(FAR)), F.transform("x", lambda x: F.floor(x * scale)))
    kept = own.withColumn("v", whole).filter("id is not null and label is not null and v is not null").select("id", "label", "v", "asks").distinct()
    return kept.withColumn("norm2", F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x * x))


def _narrow(x: np.ndarray) -> np.ndarray:
    """The same integers in the fewest bytes."""
    most = int(max(abs(int(x.min())), abs(int(x.max())))) if x.size else 0
    return x.astype(next(t for t, limit in (("<i2", 1 << 15), ("<i4", 1 << 31), ("<i8", 1 << 63)) if most < limit))


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), dim)


def buckets(rows: DataFrame, dim: int, parts: int) -> DataFrame:
    """Blocks ``bucket, n, top, ids, labels, width, vectors`` of all rows, the longest norms in the lowest buckets."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held, size = TaskContext.get().partitionId(), [], 0

        def row(part: pa.Table) -> pa.RecordBatch:
            x = _narrow(_matrix(part.column("v").combine_chunks(), dim))
            ids, labels, norm2 = (part.column(c).to_numpy().astype("<i8") for c in ("id", "label", "norm2"))
            made = {"bucket": [bucket], "n": [len(ids)], "top": [int(norm2.max())], "ids": [ids.tobytes()], "labels": [labels.tobytes()], "width": [x.itemsize], "vectors": [x.tobytes()]}
            return pa.RecordBatch.from_pydict(made, pa.schema([("bucket", pa.int32()), ("n", pa.int32()), ("top", pa.int64()), ("ids", pa.binary()), ("labels", pa.binary()), ("width", pa.int32()), ("vectors", pa.binary())]))

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= BLOCK:
                table = pa.Table.from_batches(held)
                for low in range(0, size - size % BLOCK, BLOCK):
                    yield row(table.slice(low, BLOCK))
                rest = table.slice(size - size % BLOCK)
                held, size = rest.to_batches(), rest.num_rows
        if size:
            yield row(pa.Table.from_batches(held))

    order = [F.desc("norm2"), "id", "label"]
    padded = F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("v"))).alias("v")
    ranged = rows.select("id", "label", "norm2", padded).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return ranged.mapInArrow(pack, "bucket int, n int, top long, ids binary, labels binary, width int, vectors binary")


def grouped(anchors: DataFrame) -> tuple[DataFrame, list[float]]:
    """``anchors`` (with ``windows``) and ``group``, and for each group, ascending, the least norm that one of its anchors needs."""
    low = F.array_min(F.transform("windows", lambda w: w["lo"]))
    need = F.when(low <= 0, 0.0).when(F.col("norm2") == 0, 1e300).otherwise(low / F.sqrt("norm2"))
    own = anchors.withColumn("need", need)
    cuts = sorted(set(own.approxQuantile("need", [i / RANGES for i in range(1, RANGES)], 0.01)))
    at = F.size(F.filter(F.lit(cuts).cast("array<double>"), lambda c: c < F.col("need"))) if cuts else F.lit(0)
    own = own.withColumn("range", at)
    sizes = sorted(own.groupBy("range").agg(F.count("*").alias("n"), F.min("need").alias("need")).collect())  # at most RANGES rows
    group = max(GROUP, -(-sum(r["n"] for r in sizes) // PARTS))
    first, needs = {}, []
    for r in sizes:  # one range may hold most anchors: it is split by a hash
        first[r["range"]] = (len(needs), -(-r["n"] // group))
        needs += [r["need"]] * first[r["range"]][1]
    start, parts = (F.create_map(*[F.lit(x) for k, pair in first.items() for x in (k, pair[i])])[F.col("range")] for i in (0, 1)) if first else (F.lit(0), F.lit(1))
    return own.withColumn("group", (start + F.pmod(F.xxhash64("key"), parts)).cast("int")).drop("need", "range"), needs


def best_of(scores: np.ndarray, k: int) -> np.ndarray:
    """Each row's k-th largest value; minus infinity's stand-in where it has fewer."""
    return np.partition(scores, scores.shape[1] - k, 1)[:, -k] if scores.shape[1] >= k else np.full(len(scores), -FAR)


def _meet(left: pa.Table, right: pa.Table, dim: int, same: bool, k: int) -> tuple[np.ndarray, ...]:
    """Of a group of anchors and a bucket: ``key, window, id, score`` of each window's first ``k``."""
    a, key, own, label, norm2 = _matrix(left.column("v").combine_chunks(), dim), *(left.column(c).to_numpy() for c in ("key", "id", "label", "norm2"))
    listed = left.column("windows").combine_chunks()
    of = np.repeat(np.arange(len(key)), np.diff(listed.offsets.to_numpy()))
    name, low, high = (listed.flatten().field(c).to_numpy() for c in ("w", "lo", "hi"))
    place = np.arange(len(of)) - np.searchsorted(of, of)  # a window's number among its anchor's
    blocks = sorted(right.select(["n", "top", "ids", "labels", "width", "vectors"]).to_pylist(), key=lambda b: -b["top"])
    least = low.copy()  # rises to the running k-th score
    found = [np.zeros(0, np.int64)] * 3  # window, score, id
    exact = 2.0**53
    for start in range(0, len(key), TOGETHER):
        inside = np.flatnonzero((of >= start) & (of < start + TOGETHER))
        kept = [np.zeros(0, np.int64)] * 3
        for block in blocks:
            bound = np.sqrt(norm2[of[inside]].astype(float) * block["top"]) * (1 + 1e-12)
            alive = inside[least[inside] <= bound]
            if not len(alive):
                break  # later blocks have shorter norms
            rows = np.unique(of[alive])
            c = np.frombuffer(block["vectors"], f"<i{block['width']}").reshape(-1, dim)
            ids, labels = np.frombuffer(block["ids"], "<i8"), np.frombuffer(block["labels"], "<i8")
            if float(norm2[rows].max()) * block["top"] < exact**2 * 0.99:  # no partial sum leaves what a double holds exactly
                score = (a[rows].astype(float) @ c.T.astype(float)).astype(np.int64)
            else:
                score = a[rows] @ c.T.astype(np.int64)
            score[((label[rows][:, None] == labels) != same) | (own[rows][:, None] == ids)] = -FAR
            for turn in range(int(place[alive].max()) + 1):
                windows = alive[place[alive] == turn]
                at = np.searchsorted(rows, of[windows])
                inner = np.where(score[at] <= high[windows][:, None], score[at], -FAR)
                least[windows] = np.maximum(least[windows], best_of(inner, k))
                w, j = np.nonzero(inner >= np.maximum(least[windows], 1 - FAR)[:, None])
                kept = [np.concatenate(x) for x in zip(kept, (windows[w], inner[w, j], ids[j]))]
            order = np.lexsort((kept[2], -kept[1], kept[0]))
            kept = [x[order] for x in kept]
            rank = np.arange(len(order)) - np.searchsorted(kept[0], kept[0])
            last = rank == k - 1
            least[kept[0][last]] = np.maximum(least[kept[0][last]], kept[1][last])
            kept = [x[rank < k] for x in kept]
        found = [np.concatenate(x) for x in zip(found, kept)]
    return key[of[found[0]]], name[found[0]], found[2], found[1]


def search(anchors: DataFrame, index: DataFrame, tops: list[float], dim: int, same: bool, k: int) -> DataFrame:
    """``key, w, rank, id, score``: of each window the first ``k`` rows of the anchor's own label (``same``) or of any other.

    ``anchors``: ``key, id, label, v, norm2, windows array<struct<w, lo, hi>>``, a written table; ``tops``: the longest norm of each bucket.
    """
    first = Window.partitionBy("key", "w").orderBy(F.desc("score"), "id")

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        got = _meet(left, right, dim, same, k) if left.num_rows and right.num_rows else [[]] * 4
        return pa.table(dict(zip(("key", "w", "id", "score"), (pa.array(x, t) for x, t in zip(got, (pa.int64(), pa.int32(), pa.int64(), pa.int64()))))))

    def round_(anchors: DataFrame, low: int, high: int) -> DataFrame:
        own, needs = grouped(anchors)
        reach = [n * (1 - 1e-9) for n in needs]
        met = F.size(F.filter(F.lit(reach).cast("array<double>"), lambda n: n <= F.sqrt(F.col("top").cast("double"))))
        right = index.filter(f"bucket >= {low} and bucket < {high}").withColumn("groups", met).filter("groups > 0")
        right = right.withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")
        ends = [max((b + 1 for b, top in enumerate(tops[:high]) if top >= n), default=0) for n in reach]  # tops descend
        last = F.element_at(F.lit(ends).cast("array<int>"), F.col("group") + 1)
        left = own.withColumn("last", last).filter(F.col("last") > low).withColumn("bucket", F.explode(F.sequence(F.lit(low), F.col("last") - 1))).drop("last")
        return left.groupBy("group", "bucket").cogroup(right.groupBy("group", "bucket")).applyInArrow(cell, "key long, w int, id long, score long")

    found, _ = materialize(ranked(round_(anchors, 0, 1)), "longest")
    if len(tops) > 1:
        reached = found.filter(F.col("rank") == k).select("key", F.struct("w", "score").alias("kth"))
        kth = reached.groupBy("key").agg(F.map_from_entries(F.collect_list("kth")).alias("kth"))  # as many as an anchor has windows
        raised = F.transform("windows", lambda w: F.struct(w["w"].alias("w"), F.greatest(w["lo"], F.coalesce(F.try_element_at("kth", w["w"]), w["lo"])).alias("lo"), w["hi"].alias("hi")))
        later, _ = materialize(anchors.join(kth, "key", "left").withColumn("windows", raised).drop("kth"), "limits")
        found = ranked(found.drop("rank").union(round_(later, 1, len(tops))))
    return found.select("key", "w", "rank", "id", "score")


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, k: int = K, positives: int = K, least: int = LEAST, scale: int = SCALE, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding", bucket_rows: int = BUCKET
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Of each anchor row and each of its ``positives`` best other rows of the same label: the first ``k`` rows of another
    label whose score is between ``least`` per cent of the positive's and the positive's. Higher scores come first,
    ties by smaller id.

    Rows take no part whose id, label or vector is null or whose vector holds null or non-finite components,
    nor those whose integer norm is 2^31 or more (their scores need not fit a long). Shorter vectors are as if filled with
    zeros; zero vectors take part. A repeated row counts once; rows of an anchor's own id are never its positives or negatives;
    rows that differ under one id are rows of their own. A label that a third of all rows have, or one vector under many
    ids, is spread like any other rows. Other columns are ignored; empty tables give no rows.
    """
    scratch = Scratch(vectors.sparkSession)
    rows = scratch.keep(whole_rows(vectors, is_anchor, id_col, label_col, vec_col, scale), "rows")
    n, dim = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    dim = max(dim, 1)
    parts = max(1, min(PARTS, -(-n // bucket_rows)))
    index = scratch.keep(buckets(rows, dim, parts), "buckets")
    known = dict(index.groupBy("bucket").agg(F.max(F.sqrt(F.col("top").cast("double")))).collect())
    tops = [known.get(b, 0.0) for b in range(max(known, default=0) + 1)]
    tops = np.maximum.accumulate(tops[::-1])[::-1].tolist()  # an empty bucket is none
    padded = F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("v"))).alias("v")
    window = F.array(F.struct(F.lit(0).alias("w"), F.lit(1 - FAR).alias("lo"), F.lit(FAR - 1).alias("hi")))
    anchors = scratch.keep(rows.filter("asks").select(F.monotonically_increasing_id().alias("key"), "id", "label", padded, "norm2", window.alias("windows")), "anchors")

    near, _ = materialize(search(anchors, index, tops, dim, True, positives).select("key", "rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # least * score / 100, rounded up, without leaving a long
    score = F.col("positive_score")
    low = F.expr("positive_score div 100") * least + F.expr(f"({least} * (positive_score % 100) + 99) div 100")
    listed = near.filter(score >= 0).groupBy("key").agg(F.collect_list(F.struct(F.col("rank").alias("w"), low.alias("lo"), score.alias("hi"))).alias("windows"))  # below zero the range is empty
    asking = scratch.keep(anchors.drop("windows").join(listed, "key").select("key", "id", "label", "v", "norm2", "windows"), "windows")
    hard = search(asking, index, tops, dim, False, k).select("key", F.col("w").alias("place"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = near.withColumnRenamed("rank", "place").join(anchors.select("key", F.col("id").alias("anchor_id")), "key")
    out, _ = materialize(hard.join(named, ["key", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "hard-negatives")
    scratch.drop()
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fernlake.runtime import table

    seventh = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", seventh), F.col("vec_id") % 100 == 0)


SQL = """
WITH whole AS (
    SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
           coalesce(list_sum(list_transform(list_zip(a.v, c.v), lambda p: coalesce(p[1] * p[2], 0))), 0)::BIGINT AS score
    FROM whole a JOIN whole c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0
), positive AS (
    SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), hard AS (
    SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
           row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS rank
    FROM positive p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM hard WHERE rank <= 5
"""
