"""SimHash near-duplicates through deletion-variant signatures.

Fingerprints of 64 bits within ``radius`` of each other are found as follows. Cut the bits
into two halves: in one of them the two differ by at most one bit. Index each half once for each
of its bits with that bit taken out (a one-wildcard variant): the two then share a variant. Equal
variants are joined and pairs verified.

Texts that are alike share their fingerprint, so all of this runs on distinct fingerprints.
A variant that more than ``PAIR_ROWS`` fingerprints share is not paired up: for radius 2
those fingerprints go through their balls instead. Two fingerprints are within 2 bits
exactly if their balls of radius 1 (65 values) meet, and all that share a value are within
2 bits of one another, so linking each to the smallest loses no link and emits no pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fernlake.llm.chunks import slices
from fernlake.llm.shingle_ranks import looked_up, shingle_ranks
from fernlake.llm.sieve import maybe_among
from fernlake.operators.components import connected_components
from fernlake.runtime import Scratch, exchanged, materialize

#: Only A-Z are lower-cased; words end at the six ASCII white-space bytes.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SEED = 42
#: Fingerprints that share a variant are paired up to this number; beyond it balls link them.
PAIR_ROWS = 32


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split()


def shingles(words: list[bytes], size: int) -> list[bytes]:
    """All runs of ``size`` words, repeats included; the whole where there are fewer."""
    if len(words) < size:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(size)))))


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    import xxhash

    got = shingles(words_of(text or ""), size)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, SEED) for s in got), np.uint64, len(got))


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is 1 if over half of the hashes have it; of none: zero."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for part in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[part : part + 65_536].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id long, fp long`` of every whole text (the fingerprint's bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got: list[int] = []
            for texts in slices(batch.column(1), 500):  # few texts at a time are Python objects
                got.extend(fingerprint(shingle_hashes(t, shingle_words)) for t in texts.to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(got, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t")).mapInArrow(run, "doc_id long, fp long")


def variants(fp: Column) -> list[Column]:
    """One key for each bit: its place, and the other bits of its half, in one long."""
    keys = []
    for bit in range(64):
        mask = 0xFFFFFFFF & ~(1 << bit % 32)
        keys.append(F.shiftrightunsigned(fp, 32 * (bit // 32)).bitwiseAND(F.lit(mask)).bitwiseOR(F.lit(bit << 32)))
    return keys


def close_pairs(distinct_fp: DataFrame, radius: int = 2, fp: str = "fp", scratch: Scratch | None = None) -> DataFrame:
    """Links ``(u, v)``, u > v, whose components are those of all pairs within ``radius`` (0 to 2) bits."""
    if not 0 <= radius <= 2:
        raise ValueError("radius is 0, 1 or 2: beyond that a full bucket has no exact way out")
    # fingerprints are small, and a file of them few tasks: their variants need more
    tasks = int(distinct_fp.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = distinct_fp.select(F.col(fp).alias("fp")).repartition(tasks, "fp")
    keyed = own.select(F.explode(F.array(*variants(F.col("fp")))).alias("key"), "fp")
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    kept = (scratch or Scratch(distinct_fp.sparkSession)).keep(keyed.join(exchanged(shared), "key"), "variants")

    near = f"bit_count(x ^ y) <= {radius}"
    bucket = kept.filter(F.col("n") <= PAIR_ROWS).groupBy("key").agg(F.collect_list("fp").alias("all"))
    paired = (
        bucket.select("all", F.explode("all").alias("x"))
        .select("x", F.explode(F.expr(f"filter(all, y -> y < x and {near})")).alias("y"))
        .select(F.col("x").alias("u"), F.col("y").alias("v"))
    )

    full = kept.filter(F.col("n") > PAIR_ROWS).select("fp").distinct()
    flips = [F.col("fp")] + ([F.col("fp").bitwiseXOR(F.lit((1 << b) - (1 << 64 if b == 63 else 0))) for b in range(64)] if radius else [])
    ball = full.select(F.explode(F.array(*flips)).alias("z"), "fp")
    least = ball.groupBy("z").agg(F.min("fp").alias("least"), F.count("*").alias("n")).filter("n > 1").select("z", "least")
    starred = ball.join(exchanged(least), "z").filter("fp > least").select(F.col("fp").alias("u"), F.col("least").alias("v"))
    if radius == 1:
        starred = starred.filter("bit_count(u ^ v) <= 1").union(full.alias("a").select(F.col("fp").alias("u"), F.explode(F.array(*flips[1:])).alias("v")).join(exchanged(full.select(F.col("fp").alias("v"))), "v").filter("u > v").select("u", "v"))
    return paired.union(starred).distinct()


def near_duplicates(docs: DataFrame, shingle_words: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp, component_id`` (smallest doc_id reachable over links) for every row.

    Null and empty texts have fingerprint zero and link like any other. Null ids take part but
    never name a component unless all its ids are null. Repeated rows stay; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    made, _ = materialize(fingerprints(docs, shingle_words, id_col, text_col), "fingerprints")
    reps = scratch.keep(made.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    parts = connected_components(close_pairs(reps, radius, scratch=scratch))
    linked, _ = materialize(reps.join(exchanged(parts.withColumnRenamed("node", "fp")), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("root")), "roots")
    scratch.drop()
    lowest = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    named = linked.join(exchanged(lowest), "root").select("fp", "component_id")
    return made.join(exchanged(named), "fp").select("doc_id", "fp", "component_id")


# near-duplicates by the similarity of their shingle sets

#: Five-word shingle sets at least this similar are near-duplicates.
SIMILARITY, SET_WORDS = 0.8, 5
#: 64-bit words of a set's parity bitmap.
PARITY = 8
#: Rows of a bucket that one task compares with the others.
BLOCK = 1024
#: Shared signatures before its own that a text's row in a bucket carries.
RECENT = 4


def shingle_set(text: str | None, words: int = SET_WORDS) -> np.ndarray:
    return np.unique(shingle_hashes(text, words))


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    edge = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(edge), pa.array(np.concatenate(arrays).view(np.int64), pa.int64()))


def prefix(hashes: np.ndarray, ranks: np.ndarray, similarity: float = SIMILARITY) -> tuple[np.ndarray, int]:
    """The first of a set's shingles, rarest first: sets that are similar enough share one of them. Also how many these are."""
    ordered = hashes[np.lexsort((hashes, looked_up(hashes, ranks)))]
    first = ordered[: len(hashes) - int(np.ceil(similarity * len(hashes) - 1e-9)) + 1]
    return first, len(first)


def parity(hashes: np.ndarray, words: int = PARITY) -> np.ndarray:
    """Bit b is 1 if an odd number of hashes fall on b: bitmaps differ in no more bits than sets in shingles. ``words`` is a power of two."""
    odd = np.bincount((hashes & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8")


def wide_parity(hashes: np.ndarray) -> np.ndarray:
    """A bitmap of two to four bits a shingle where ``PARITY`` words are fewer; else none."""
    bits = 1 << max(2 * len(hashes) - 1, 1).bit_length()
    return parity(hashes, bits // 64) if bits > 64 * PARITY else np.empty(0, np.int64)


BITS = [f"b{i}" for i in range(PARITY)]


def set_signatures(docs: DataFrame, words: int, sign: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, int]], id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text_hash, sig, size, weight, prefix, singles, wide, b0, b1, ...`` of every whole text.

    ``sig`` is a hash of all words, which texts that are alike share; ``prefix`` what ``sign`` makes of the set and
    of the ranks of all texts' shingles, the first ``singles`` of it shingles; ``weight`` how common its shingles are on average.
    """
    import xxhash

    sent = docs.sparkSession.sparkContext.broadcast(shingle_ranks(docs, lambda text: shingle_set(text, words), text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = 0
            for part in slices(batch.column(2), 500):
                texts = part.to_pylist()
                sigs = np.array([xxhash.xxh64_intdigest(b" ".join(words_of(t or "")), SEED) for t in texts], np.uint64)
                sets = [shingle_set(t, words) for t in texts]
                bits = np.array([parity(s) for s in sets])
                columns = [batch.column(c).slice(low, len(texts)) for c in (0, 1)]
                firsts = [sign(s, sent.value) for s in sets]
                weights = [float(looked_up(s, sent.value).mean()) if len(s) else 0.0 for s in sets]
                columns += [pa.array(sigs.view(np.int64)), pa.array([len(s) for s in sets], pa.int32()), pa.array(weights, pa.float32()), _lists([f for f, _ in firsts]), pa.array([n for _, n in firsts], pa.int32()), _lists([wide_parity(s) for s in sets])]
                columns += [pa.array(np.ascontiguousarray(bits[:, i])) for i in range(PARITY)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "sig", "size", "weight", "prefix", "singles", "wide", *BITS])
                low += len(texts)

    schema = ", ".join(["doc_id long, text_hash long, sig long, size int, weight float, prefix array<long>, singles int, wide array<long>", *(f"{b} long" for b in BITS)])
    return docs.select(F.col(id_col).cast("long").alias("k"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("t")).mapInArrow(run, schema)


def _possible(similarity: float, x: str, y: str) -> Column:
    """Whether sets whose first common shingle stands at these places can be similar enough."""
    need = F.ceil(F.lit(similarity / (1 + similarity)) * (F.col(f"{x}.size") + F.col(f"{y}.size")) - 1e-9)
    return F.least(F.col(f"{x}.size") - F.col(f"{x}.place"), F.col(f"{y}.size") - F.col(f"{y}.place")) >= need


def _near(similarity: float, x: str, y: str) -> Column:
    """Whether parity bitmaps differ in no more bits than similar sets can in shingles."""
    apart = sum((F.bit_count(F.col(f"{x}.{b}").bitwiseXOR(F.col(f"{y}.{b}"))) for b in BITS), F.lit(0))
    return apart <= F.lit((1 - similarity) / (1 + similarity)) * (F.col(f"{x}.size") + F.col(f"{y}.size")) + 1e-9


def _near_wide(similarity: float, x: str, y: str) -> Column:
    """The same by wide bitmaps, the wider one folded to the other's width; true where a side has none or is over twice as wide."""

    def folded(wide: Column, other: Column) -> Column:
        half = F.size(other)
        over = F.zip_with(F.slice(wide, 1, half), F.slice(wide, half + 1, half), lambda a, b: a.bitwiseXOR(b))
        return F.when(F.size(wide) == 2 * half, over).otherwise(wide)

    a, b = F.col(f"{x}.wide"), F.col(f"{y}.wide")
    told = (F.least(F.size(a), F.size(b)) > 0) & (F.greatest(F.size(a), F.size(b)) <= 2 * F.least(F.size(a), F.size(b)))
    apart = F.aggregate(F.zip_with(folded(a, b), folded(b, a), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, m: n + m)
    return F.when(told, apart <= F.lit((1 - similarity) / (1 + similarity)) * (F.col(f"{x}.size") + F.col(f"{y}.size")) + 1e-9).otherwise(F.lit(True))


def _met(x: str, y: str) -> Column:
    """Whether one of the shingles that two rows carry is the same: the two texts then have met in its bucket."""
    return F.coalesce(F.arrays_overlap(f"{x}.recent", f"{y}.recent"), F.lit(False))


def similar_pairs(docs: DataFrame, classes: DataFrame, pairs: DataFrame, similarity: float, words: int, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """Those of ``pairs`` (``u, v`` of ``sig``) whose shingle sets are similar, kept in ``scratch``."""
    own = Scratch(docs.sparkSession)
    # the texts of the candidates, one of each class, as sets
    asked = pairs.select(F.explode(F.array("u", "v")).alias("sig")).distinct()
    wanted = own.keep(classes.join(exchanged(asked), "sig").select("sig", F.col("first.doc_id").alias("wk"), F.col("first.text_hash").alias("h")), "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = 0
            for texts in slices(batch.column(1), 500):
                sets = [shingle_set(t, words) for t in texts.to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, len(sets)), _lists(sets)], ["sig", "shingles"])
                low += len(sets)

    # other texts stay where they are; a class's first text has one hash, so dropping repeats needs no other exchange than the join
    named = docs.select(F.col(id_col).cast("long").alias("k"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("t")).filter(maybe_among(wanted.select("h"))(F.col("h")))
    texts = named.join(exchanged(wanted), "h").filter(F.col("k").eqNullSafe(F.col("wk"))).dropDuplicates(["h", "sig"]).select("sig", "t")
    sets = own.keep(texts.mapInArrow(run, "sig long, shingles array<long>"), "sets")
    sides = [sets.select(F.col("sig").alias(s), F.col("shingles").alias(f"{s}_set")) for s in "uv"]
    both = F.size(F.array_intersect("u_set", "v_set"))
    alike = both >= F.lit(similarity) * (F.size("u_set") + F.size("v_set") - both) - 1e-9
    links = scratch.keep(pairs.join(exchanged(sides[0]), "u").join(exchanged(sides[1]), "v").filter(alike).select("u", "v"), "links")
    own.drop()
    return links


def similar_rows(
    docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", words: int = SET_WORDS, sign: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, int]] | None = None
) -> DataFrame:
    """``doc_id, text_hash, size, root, component_id`` of every row: texts have one root if links connect them.

    Sets of n shingles in one order, the same for all, that are similar enough share one of their first
    n - ceil(similarity * n) + 1; rare shingles (by their counts in all texts) come first, so few texts share them.
    ``sign`` may name other signatures, of which similar sets share one: first shingles in that order, then any in ascending order. All texts that share
    a signature are candidates, in two steps. First each is compared with one of its bucket, that whose
    shingles are commonest, as the head of a group of copies has them. Then all pairs that these links have not connected are compared;
    two that share many such shingles come up in few of their buckets, always in that of the first, where
    what their places allow is most. What rules
    out a pair before its sets are read (sizes, places, parity bitmaps) is a bound, never an estimate.
    """
    tasks, scratch, buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), Scratch(docs.sparkSession), Scratch(docs.sparkSession)
    sign = sign or (lambda hashes, ranks: prefix(hashes, ranks, similarity))
    made, _ = materialize(set_signatures(docs, words, sign, id_col, text_col), "signatures")
    named = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    classes = scratch.keep(made.groupBy("sig").agg(F.min(named).alias("first"), *[F.first(c).alias(c) for c in ("size", "weight", "prefix", "singles", "wide", *BITS)]), "classes")
    bits = classes.select("sig", "size", *BITS)
    maps = classes.select("sig", "size", "wide", *BITS)

    def near(pairs: DataFrame) -> DataFrame:
        both = pairs.join(exchanged(maps).alias("x"), F.col("u") == F.col("x.sig")).join(exchanged(maps).alias("y"), F.col("v") == F.col("y.sig"))
        return both.filter(_near(similarity, "x", "y") & _near_wide(similarity, "x", "y")).select("u", "v")

    # the aggregate reads all columns, so that it and the join with its result share one exchange
    # a shingle's place bounds what two sets can share; that of other signatures says nothing
    keyed = classes.select("sig", "size", "weight", "singles", F.posexplode("prefix").alias("turn", "token")).withColumn("place", F.when(F.col("turn") < F.col("singles"), F.col("turn")).otherwise(0)).drop("singles").repartition(tasks, "token")
    heads = keyed.groupBy("token").agg(F.max(F.struct("weight", "sig", "size", "place")).alias("top"), F.count("*").alias("n")).filter("n > 1")
    kept = buckets.keep(keyed.join(exchanged(heads.select("token", "top")), "token").select("token", "sig", "size", "weight", "turn", "place", "top"), "buckets")

    starred = kept.select(F.struct("sig", "size", "place").alias("x"), F.col("top").alias("y")).filter("x.sig <> y.sig").filter(_possible(similarity, "x", "y"))
    stars = starred.select(F.greatest("x.sig", "y.sig").alias("u"), F.least("x.sig", "y.sig").alias("v")).distinct()
    first = similar_pairs(docs, classes, scratch.keep(near(stars), "stars"), similarity, words, id_col, text_col, scratch)

    parts = connected_components(first).select(F.col("node").alias("sig"), "component")
    rooted = scratch.keep(kept.select("token", "sig", "turn", "place").join(exchanged(parts), "sig", "left").select("token", "sig", "turn", "place", F.coalesce("component", "sig").alias("root")), "rooted")
    roots = rooted.groupBy("token", "root").agg(F.count("*").alias("n"))
    split = roots.groupBy("token").agg(F.count("*").alias("roots"), F.max(F.struct("n", "root")).alias("main"), F.sum("n").alias("n")).filter("roots > 1")
    split = split.select("token", F.col("main.root").alias("main"), F.ceil((F.col("n") - F.col("main.n")) / BLOCK).alias("blocks"))
    del stars, starred, heads, keyed
    buckets.drop()
    # texts of different roots meet in the buckets of all shingles they share; a text's order is that of all
    before = Window.partitionBy("sig").orderBy("turn")
    recent = F.array(*[F.lag("token", i).over(before) for i in range(1, RECENT + 1)]).alias("recent")
    mixed = scratch.keep(rooted.join(exchanged(split), "token").join(exchanged(bits), "sig").select("*", recent), "mixed")
    some = mixed.filter("root <> main").withColumn("block", F.pmod(F.xxhash64("sig"), F.col("blocks")))
    all_ = mixed.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    once = (F.col("y.root") == F.col("y.main")) | (F.col("x.sig") > F.col("y.sig"))
    across = some.alias("x").join(exchanged(all_).alias("y"), ["token", "block"]).filter((F.col("x.root") != F.col("y.root")) & once & ~_met("x", "y") & _possible(similarity, "x", "y") & _near(similarity, "x", "y"))
    rest = scratch.keep(near(across.select(F.greatest("x.sig", "y.sig").alias("u"), F.least("x.sig", "y.sig").alias("v")).distinct()), "across")
    links = first.union(similar_pairs(docs, classes, rest, similarity, words, id_col, text_col, scratch)) if rest.take(1) else first

    parts = connected_components(links).select(F.col("node").alias("sig"), "component")
    linked, _ = materialize(classes.join(exchanged(parts), "sig", "left").select("sig", F.col("first.doc_id").alias("first"), F.coalesce("component", "sig").alias("root")), "roots")
    scratch.drop()
    least = linked.join(exchanged(linked.groupBy("root").agg(F.min("first").alias("component_id"))), "root").select("sig", "root", "component_id")
    return made.select("doc_id", "text_hash", "sig", "size").join(exchanged(least), "sig").select("doc_id", "text_hash", "size", "root", "component_id")


def similar_documents(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, component_id`` (smallest doc_id reachable) over links between texts whose five-word shingle sets are similar.

    Texts that differ in white space and A-Z case only are alike, null and empty ones too. Every pair that
    is similar is linked, whatever the size of its group. Null ids take part but never name a component
    unless all its ids are null; repeated rows stay.
    """
    return similar_rows(docs, similarity, id_col, text_col).select("doc_id", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fernlake.runtime import table

    got = near_duplicates(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
