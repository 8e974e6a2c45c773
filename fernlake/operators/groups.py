"""Groups of near-duplicate files: connected components, or size-capped merging.

Capped merging takes pairs in the order (distance, left, right) and merges two groups unless
together they exceed the cap. That order decides the result, yet most of it needs no sequence:

* Files of equal hash are merged first, among themselves: by name they fall into runs of ``cap``.
  Full runs can never grow, so each hash goes on as its last, partial run.
* Of two hashes only the pair of their partial runs' first names counts: if it merges, the
  others are done, and if it would exceed the cap, so would they later.
* A component of hashes that fits the cap whole is merged without looking at the order.

What is left are oversized components. Their pairs are streamed in order through a union-find that holds a size
for each node, no pairs; one component is one task's work, as each step depends on the last. So that no task gets
more than it must, components of over ``STREAMED`` pairs go level by level of distance: pairs of the least distance first, on nodes that are
what merged before. A level's components that fit the cap merge whole, all at once, and only the others are streamed.

Any number of settings (threshold and cap) are grouped in one run: nodes carry the setting's number. Names take part as
their number in name order, so that what is merged, joined and sorted are longs, whatever the names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernlake.functions.names import group_label
from fernlake.operators.components import connected_components
from fernlake.operators.pairs import distinct_pairs
from fernlake.operators.ranking import global_rank, rank_within
from fernlake.runtime import Scratch, exchanged, materialize

#: Pairs of a component up to which it is streamed as it is.
STREAMED = 1_000_000
#: The cap of settings without one.
UNCAPPED = 1 << 62
#: Bits of a node's name's number; those above hold the setting's.
NAME_BITS = 43


class CappedUnion:
    """Union-find over weighted names, or their numbers; the smaller root survives."""

    def __init__(self, cap: int):
        self.cap = cap
        self.parent: dict[int, int] = {}
        self.size: dict[int, int] = {}

    def root(self, name: int, weight: int = 1) -> int:
        if name not in self.parent:
            self.parent[name], self.size[name] = name, weight
        top = name
        while self.parent[top] != top:
            top = self.parent[top]
        while self.parent[name] != top:
            self.parent[name], name = top, self.parent[name]
        return top

    def merge(self, a: int, wa: int, b: int, wb: int) -> bool:
        ra, rb = sorted((self.root(a, wa), self.root(b, wb)))
        if ra == rb or self.size[ra] + self.size[rb] > self.cap:
            return False
        self.parent[rb] = ra
        self.size[ra] += self.size.pop(rb)
        return True


def _merge_in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs come sorted by setting and component and then by (distance, left, right); ``left_node`` and ``right_node`` are what the names have merged into."""
    union, now = None, None

    def done() -> pd.DataFrame:
        names = list(union.parent)
        return pd.DataFrame({"seq": now[0], "name": names, "root": [union.root(n) for n in names]})

    for batch in batches:
        for seq, component, cap, left, wl, right, wr in batch[["seq", "component", "cap", "left_node", "wl", "right_node", "wr"]].itertuples(index=False):
            if (seq, component) != now:
                if union is not None:
                    yield done()
                union, now = CappedUnion(cap), (seq, component)
            union.merge(left, wl, right, wr)
    if union is not None:
        yield done()


def _components(pairs: DataFrame, left: str, right: str, scratch: Scratch) -> DataFrame:
    """``seq, name, component`` of the nodes of each setting."""
    node = lambda name: F.shiftleft(F.col("seq").cast("long"), NAME_BITS).bitwiseOR(F.col(name))
    number = lambda node: F.col(node).bitwiseAND(F.lit((1 << NAME_BITS) - 1))
    parts = connected_components(pairs.select(node(left).alias("u"), node(right).alias("v")))
    return scratch.keep(parts.select(F.shiftright("node", NAME_BITS).cast("int").alias("seq"), number("node").alias("name"), number("component").alias("component")), "parts")


def _merged(pairs: DataFrame, runs: DataFrame, scratch: Scratch) -> DataFrame:
    """``seq, name, root`` of ``runs`` (``seq, cap, name, w``) that ``pairs`` (``seq, distance, cap, na, wa, nb, wb``) merge; runs that stay alone may lack."""
    parts = _components(pairs, "na", "nb", scratch)
    nodes = scratch.keep(runs.join(exchanged(parts), ["seq", "name"]), "nodes")
    totals = nodes.groupBy("seq", "component", "cap").agg(F.sum("w").alias("total"))
    small = nodes.join(totals.filter(F.col("total") <= F.col("cap")), ["seq", "component", "cap"]).select("seq", "name", F.col("component").alias("root"))
    large = scratch.keep(totals.filter(F.col("total") > F.col("cap")).select("seq", "component"), "large")
    if large.isEmpty():
        return small
    left = scratch.keep(pairs.join(exchanged(nodes.select("seq", F.col("name").alias("na"), "component")), ["seq", "na"]).join(large, ["seq", "component"]), "oversized")
    far = scratch.keep(left.groupBy("seq", "component").agg(F.count("*").alias("n")).filter(F.col("n") > STREAMED).select("seq", "component"), "far")
    if far.isEmpty():
        return small.unionByName(_streamed(left.withColumns({"ra": F.col("na"), "rb": F.col("nb")})))
    near = _streamed(left.join(far, ["seq", "component"], "left_anti").withColumns({"ra": F.col("na"), "rb": F.col("nb")}))
    left = left.join(far, ["seq", "component"], "left_semi")
    # what each run of such a component has merged into, and that node's weight
    state = scratch.keep(nodes.join(far, ["seq", "component"]).select("seq", "cap", "name", F.col("name").alias("root"), F.col("w").alias("weight")), "state")
    for distance in sorted(r[0] for r in left.select("distance").distinct().collect()):  # at most as many as a hash has bits
        state = _level(left.filter(F.col("distance") == distance).drop("component"), state, scratch)
    return small.unionByName(near).unionByName(state.select("seq", "name", "root"))


def _streamed(pairs: DataFrame) -> DataFrame:
    """``seq, name, root`` of the nodes ``ra, rb`` (of weights ``wa, wb``) that pairs ``na, nb`` of a component merge in order."""
    swap = F.col("na") > F.col("nb")
    sides = {"left": F.least("na", "nb"), "right": F.greatest("na", "nb"), "left_node": F.when(swap, F.col("rb")).otherwise(F.col("ra")), "right_node": F.when(swap, F.col("ra")).otherwise(F.col("rb"))}
    sides |= {"wl": F.when(swap, F.col("wb")).otherwise(F.col("wa")), "wr": F.when(swap, F.col("wa")).otherwise(F.col("wb"))}
    ordered = pairs.select("seq", "component", "cap", "distance", *[c.alias(n) for n, c in sides.items()]).repartition("seq", "component")
    return ordered.sortWithinPartitions("seq", "component", "distance", "left", "right").mapInPandas(_merge_in_order, "seq int, name long, root long")


def _level(pairs: DataFrame, state: DataFrame, scratch: Scratch) -> DataFrame:
    """``state`` (``seq, cap, name, root, weight``) after the pairs of one distance."""
    of = [state.select("seq", F.col("name").alias(n), F.col("root").alias(node), F.col("weight").alias(w)) for n, node, w in (("na", "ra", "wa"), ("nb", "rb", "wb"))]
    # pairs inside a node, and pairs that exceed the cap already, do nothing and connect nothing
    met = pairs.drop("wa", "wb").join(exchanged(of[0]), ["seq", "na"]).join(exchanged(of[1]), ["seq", "nb"]).filter("ra <> rb and wa + wb <= cap")
    met = scratch.keep(met, "met")
    parts = _components(met, "ra", "rb", scratch)
    roots = state.select("seq", "cap", "root", "weight").distinct().join(parts.withColumnRenamed("name", "root"), ["seq", "root"])
    totals = scratch.keep(roots.groupBy("seq", "component", "cap").agg(F.sum("weight").alias("total")), "totals")
    whole = parts.join(totals.filter(F.col("total") <= F.col("cap")).select("seq", "component"), ["seq", "component"]).select("seq", "name", F.col("component").alias("top"))
    oversized = met.join(parts.withColumnRenamed("name", "ra"), ["seq", "ra"]).join(totals.filter(F.col("total") > F.col("cap")).select("seq", "component"), ["seq", "component"])
    merged = whole.unionByName(_streamed(oversized).withColumnRenamed("root", "top"))
    moved = state.join(merged.withColumnRenamed("name", "root"), ["seq", "root"], "left").withColumn("top", F.coalesce("top", "root"))
    moved = scratch.keep(moved, "moved")
    sizes = moved.select("seq", "root", "top", "weight").distinct().groupBy("seq", "top").agg(F.sum("weight").alias("total"))
    return scratch.keep(moved.join(sizes, ["seq", "top"]).select("seq", "cap", "name", F.col("top").alias("root"), F.col("total").alias("weight")), "state")


def grouped_runs(hashed: DataFrame, settings: list[tuple[int, int | None]], close: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files as ``file_name, hash, rank`` (among those of their hash), and ``seq, cap, hash, run, weight, root`` of each setting's runs of equal hashes.

    ``close`` has the pairs ``a, b, distance`` of distinct hashes up to the largest threshold. Settings are few: each is a literal of the plan.
    """
    spark, scratch = hashed.sparkSession, Scratch(hashed.sparkSession)
    ranked, _ = materialize(rank_within(hashed, "hash", [F.col("file_name")]), "ranked")
    rows = spark.createDataFrame([(i, t, UNCAPPED if c is None else c) for i, (t, c) in enumerate(settings)], "seq int, threshold int, cap long")
    caps = rows.select("cap").distinct()
    made = ranked.join(F.broadcast(caps)).groupBy("cap", "hash", F.expr("(rank - 1) div cap").alias("run")).agg(F.min("file_name").alias("name"), F.count("*").alias("weight"))
    made = scratch.keep(made, "runs")
    open_runs = made.filter(F.col("weight") < F.col("cap"))  # a hash's last run, unless full
    numbers = scratch.keep(global_rank(open_runs.select("name").distinct(), [F.col("name")], "number"), "numbers")
    open_runs = scratch.keep(open_runs.join(exchanged(numbers), "name").select("cap", "hash", "number", "weight"), "open")
    sides = [open_runs.select("cap", F.col("hash").alias(h), F.col("number").alias(n), F.col("weight").alias(w)) for h, n, w in (("a", "na", "wa"), ("b", "nb", "wb"))]
    pairs = close.join(F.broadcast(rows), F.col("distance") <= F.col("threshold")).join(exchanged(sides[0]), ["cap", "a"]).join(exchanged(sides[1]), ["cap", "b"])
    pairs = scratch.keep(pairs.select("seq", "distance", "cap", "na", "wa", "nb", "wb"), "merges")
    runs = open_runs.join(F.broadcast(rows), "cap").select("seq", "cap", F.col("number").alias("name"), F.col("weight").alias("w"))
    merged = _merged(pairs, runs, scratch).select("seq", F.col("name").alias("number"), F.col("root").alias("top"))
    named = [numbers.select(F.col("number").alias(n), F.col("name").alias(c)) for n, c in (("number", "name"), ("top", "root"))]
    merged = merged.filter("number <> top").join(exchanged(named[0]), "number").join(exchanged(named[1]), "top").select("seq", "name", "root")
    tops = made.join(F.broadcast(rows), "cap").join(exchanged(merged), ["seq", "name"], "left").select("seq", "cap", "hash", "run", "weight", F.coalesce("root", "name").alias("root"))
    tops, _ = materialize(tops, "tops")
    scratch.drop()
    return ranked, tops


def build_groups(encodings: DataFrame, threshold: int, cap: int | None = None, bits: int = 64, close: DataFrame | None = None) -> DataFrame:
    """``file_name, root`` for every named file; root is its group's smallest name.

    Files without a hash are groups of their own. Repeated rows count once; a name with two hashes goes by the smaller.
    ``close`` may give the pairs of distinct hashes (``a, b, distance``) if they are known, as in a sweep.
    """
    if cap is not None and cap < 1:
        raise ValueError("the cap is at least 1")
    files = encodings.filter("file_name is not null").groupBy("file_name").agg(F.min("hash").alias("hash"))
    hashed = files.filter("hash is not null")
    alone = files.filter("hash is null").select("file_name", F.col("file_name").alias("root"))
    close = (distinct_pairs(hashed, threshold, bits) if close is None else close.filter(F.col("distance") <= threshold)).select("a", "b", "distance")

    if cap is None:
        named = hashed.groupBy("hash").agg(F.min("file_name").alias("first"))
        parts = connected_components(close, "a", "b").select(F.col("node").alias("hash"), "component")
        tied = named.join(exchanged(parts), "hash", "left").withColumn("component", F.coalesce("component", "hash"))
        roots = tied.groupBy("component").agg(F.min("first").alias("root"))
        return hashed.join(exchanged(tied.select("hash", "component")), "hash").join(exchanged(roots), "component").select("file_name", "root").union(alone)

    ranked, tops = grouped_runs(hashed, [(threshold, cap)], close)
    return ranked.withColumn("run", F.expr(f"(rank - 1) div {cap}")).join(exchanged(tops.select("hash", "run", "root")), ["hash", "run"]).select("file_name", "root").union(alone)


def group_manifest(rooted: DataFrame) -> DataFrame:
    """``file_name, group_id``: groups numbered from 1 in the order of their roots."""
    numbered = global_rank(rooted.select("root").distinct(), [F.col("root")], "n")
    return rooted.join(exchanged(numbered), "root").select("file_name", group_label(F.col("n")).alias("group_id"))


def fill_singletons(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Files without a group, by name, in groups of their own with the numbers after the largest."""
    last = manifest.agg(F.coalesce(F.max(F.regexp_extract("group_id", r"(\d+)$", 1).cast("long")), F.lit(0)).alias("last"))
    missing = files.select("file_name").filter("file_name is not null").distinct().join(manifest, "file_name", "left_anti")
    numbered = global_rank(missing, [F.col("file_name")], "n").join(F.broadcast(last))
    return manifest.select("file_name", "group_id").union(numbered.select("file_name", group_label(F.col("last") + F.col("n"))))


def members(manifest: DataFrame) -> DataFrame:
    """``group_id, files`` with sorted names; for groups whose size is bounded, as by a cap."""
    return manifest.groupBy("group_id").agg(F.sort_array(F.collect_list("file_name")).alias("files"))


def group_sizes(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("group_id").agg(F.count("*").alias("size"))


def summary_columns() -> list[Column]:
    """Images, groups, singletons, the largest and the share of images in groups of several, in percent, of sizes."""
    total = F.coalesce(F.sum("size"), F.lit(0))
    return [
        total.alias("total_images"),
        F.count("*").alias("num_groups"),
        F.count_if(F.col("size") == 1).alias("num_singleton_groups"),
        F.coalesce(F.max("size"), F.lit(0)).alias("largest_group_size"),
        F.coalesce(F.try_divide(F.lit(100.0) * F.sum(F.when(F.col("size") > 1, F.col("size")).otherwise(0)), total), F.lit(0.0)).alias("pct_in_multi_image_groups"),
    ]


def distribution_columns() -> list[Column]:
    """Counts by size; the last two overlap, as they are meant to."""
    n = F.col("size")
    return [
        F.count_if(n.between(2, 5)).alias("groups_size_2_5"),
        F.count_if(n.between(6, 10)).alias("groups_size_6_10"),
        F.count_if(n.between(11, 20)).alias("groups_size_11_20"),
        F.count_if(n > 20).alias("groups_size_over_20"),
        F.count_if(n > 50).alias("groups_size_over_50"),
    ]


def group_summary(manifest: DataFrame) -> DataFrame:
    """One row of ``summary_columns``."""
    return group_sizes(manifest).agg(*summary_columns())


def size_distribution(manifest: DataFrame) -> DataFrame:
    """One row of ``distribution_columns``."""
    return group_sizes(manifest).agg(*distribution_columns())


def top_groups(manifest: DataFrame, n: int = 10, max_images: int = 6) -> DataFrame:
    """``position, group_id, size, files``: the ``n`` largest groups of several images, the first names of each."""
    largest = group_sizes(manifest).filter("size > 1").orderBy(F.desc("size"), "group_id").limit(n)
    numbered = largest.select("*", F.expr("row_number() over (order by size desc, group_id)").alias("position"))
    first = manifest.join(F.broadcast(numbered), "group_id").withColumn("k", F.expr("row_number() over (partition by group_id order by file_name)")).filter(F.col("k") <= max_images)
    return first.groupBy("position", "group_id", "size").agg(F.sort_array(F.collect_list("file_name")).alias("files"))


def top_groups_per_split(manifest: DataFrame, splits: DataFrame, n: int = 10, max_images: int = 6) -> DataFrame:
    """``split, position, group_id, size, files``: of each split the ``n`` largest groups of several of its images, the first names of each."""
    own = manifest.join(splits, "file_name").select("split", "group_id", "file_name")
    sizes = own.groupBy("split", "group_id").agg(F.count("*").alias("size")).filter("size > 1")
    order = Window.partitionBy("split").orderBy(F.desc("size"), "group_id")
    largest = sizes.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= n)  # a few rows a split
    names = Window.partitionBy("split", "group_id").orderBy("file_name")
    first = own.join(F.broadcast(largest), ["split", "group_id"]).withColumn("k", F.row_number().over(names)).filter(F.col("k") <= max_images)
    return first.groupBy("split", "position", "group_id", "size").agg(F.sort_array(F.collect_list("file_name")).alias("files"))
