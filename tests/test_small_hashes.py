"""Hashes of few bits, of which there are many: their neighbours are looked up, and groups are merged on numbers of names."""

import random

from fernlake.operators import groups, pairs
from tests import loops


def sixteen_bits(spark, n, seed):
    rng = random.Random(seed)
    hashes = {f"vec_{rng.randrange(10**6)}.jpg": rng.choice([rng.randrange(1 << 16), rng.randrange(1 << 6)]) for _ in range(n)}
    return hashes, spark.createDataFrame(list(hashes.items()), "file_name string, hash long")


def test_neighbours_of_short_hashes_are_looked_up(spark):
    """Some thousand hashes of 16 bits were compared each with each, and from some ten thousand on made up to 120 keys each."""
    hashes, rows = sixteen_bits(spark, 12_000, 1)
    found = pairs.distinct_pairs(rows, 2, 16)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "choice" not in plan and "MapInArrow" not in plan
    own = set(hashes.values())
    near = [m for m in range(1, 1 << 16) if m.bit_count() <= 2]
    want = {(a, a ^ m, m.bit_count()) for a in own for m in near if a < a ^ m and a ^ m in own}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(want) and set(got) == want
    assert pairs.distinct_pairs(rows, 0, 16).count() == 0


def test_names_are_merged_by_their_numbers(spark, monkeypatch):
    hashes, rows = sixteen_bits(spark, 150, 2)
    seen = []

    def told(edges, left="u", right="v", _own=groups.connected_components):
        seen.append({kind for _, kind in edges.dtypes})
        return _own(edges, left, right)

    monkeypatch.setattr(groups, "connected_components", told)
    got = {r["file_name"]: r["root"] for r in groups.build_groups(rows, 2, 7, 16).collect()}
    assert seen and all(kinds == {"bigint"} for kinds in seen)
    assert got == loops.capped_groups(hashes, 2, 7)
