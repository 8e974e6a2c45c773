import random

import pytest
from pyspark.sql import functions as F

from fernlake.operators import components, groups, pairs, ranking, tuning
from tests import loops


def planted(seed, n=60, spread=4):
    rng = random.Random(seed)
    bases = [rng.getrandbits(64) for _ in range(6)]
    out = {}
    for i in range(n):
        h = rng.choice(bases)
        for _ in range(rng.randint(0, spread)):
            h ^= 1 << rng.randrange(64)
        out[f"f{i:03d}"] = h
    return out


def frame(spark, hashes):
    return spark.createDataFrame([(k, v - (1 << 64) if v >= 1 << 63 else v) for k, v in hashes.items()], "file_name string, hash long")


def test_pairs_equal_every_comparison(spark):
    h = planted(1)
    names = sorted(h)
    for t in (0, 3, 6, 10):
        want = {(a, b, d) for i, a in enumerate(names) for b in names[i + 1 :] if (d := bin(h[a] ^ h[b]).count("1")) <= t}
        assert {tuple(r) for r in pairs.similar_pairs(frame(spark, h), t).collect()} == want


def test_pairs_with_wider_keys(spark, monkeypatch):
    monkeypatch.setattr(pairs, "bands_to_agree", lambda *a, **k: 3)
    h = planted(2)
    names = sorted(h)
    want = {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if bin(h[a] ^ h[b]).count("1") <= 3}
    assert {(r[0], r[1]) for r in pairs.similar_pairs(frame(spark, h), 3).collect()} == want


@pytest.mark.parametrize("seed,threshold,cap", [(3, 3, None), (3, 3, 3), (4, 6, 10), (5, 4, 1), (6, 8, 5)])
def test_groups_equal_the_loop(spark, seed, threshold, cap):
    h = planted(seed)
    got = {r["file_name"]: r["root"] for r in groups.build_groups(frame(spark, h), threshold, cap).collect()}
    assert got == loops.capped_groups(h, threshold, cap)


@pytest.mark.parametrize("streamed", [0, 1_000_000])
def test_all_settings_in_one_run(spark, monkeypatch, streamed):
    """Chains whose components exceed the caps: streamed as they are, or level by level, contracted and met again."""
    monkeypatch.setattr(groups, "STREAMED", streamed)
    rng = random.Random(21)
    h, at = {}, rng.getrandbits(64)
    for _ in range(70):
        for _ in range(rng.randint(0, 3)):
            at ^= 1 << rng.randrange(64)
        h[f"f{rng.randrange(10**6):06d}"] = at
    settings = [(t, c) for t in (2, 4) for c in (2, 5, 13, None)]
    hashed = frame(spark, h)
    ranked, tops = groups.grouped_runs(hashed, settings, pairs.distinct_pairs(hashed, 4))
    rooted = ranked.join(tops, "hash").filter("run = (rank - 1) div cap").select("seq", "file_name", "root").collect()
    for i, (t, c) in enumerate(settings):
        assert {r["file_name"]: r["root"] for r in rooted if r["seq"] == i} == loops.capped_groups(h, t, c)


def test_groups_edge_cases(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", None), (None, 5), ("c", 1)], "file_name string, hash long")
    got = {r["file_name"]: r["root"] for r in groups.build_groups(df, 2, 5).collect()}
    assert got == {"a": "a", "b": "b", "c": "a"}
    assert groups.build_groups(df.limit(0), 2, 5).count() == 0
    assert groups.build_groups(df.limit(0), 2).count() == 0
    with pytest.raises(ValueError):
        groups.build_groups(df, 2, 0)
    assert groups.group_summary(groups.group_manifest(groups.build_groups(df.limit(0), 2))).first()["pct_in_multi_image_groups"] == 0


def test_many_copies_of_one_hash(spark):
    h = {f"f{i:04d}": 7 for i in range(500)} | {"g": 6, "h": 4}
    got = {r["file_name"]: r["root"] for r in groups.build_groups(frame(spark, h), 1, 50).collect()}
    assert got == loops.capped_groups(h, 1, 50)


def test_components_and_ranks(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 101), (7, 7), (None, 3)], "u long, v long")
    got = {r["node"]: r["component"] for r in components.connected_components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    ranked = ranking.rank_within(spark.createDataFrame([("x", 3), ("y", 1), ("x", 1), (None, 9)], "g string, v int"), "g", [F.col("v")])
    assert {(r["g"], r["v"], r["rank"]) for r in ranked.collect()} == {("x", 1, 1), ("x", 3, 2), ("y", 1, 1), (None, 9, 1)}


def test_singletons_and_sweep(spark):
    manifest = spark.createDataFrame([("b", "group_000002")], "file_name string, group_id string")
    files = spark.createDataFrame([("b",), ("c",), ("a",), (None,)], "file_name string")
    assert {tuple(r) for r in groups.fill_singletons(manifest, files).collect()} == {("b", "group_000002"), ("a", "group_000003"), ("c", "group_000004")}
    swept = tuning.sweep(frame(spark, planted(8)), [1, 4], [None, 5]).collect()
    assert [(r["threshold"], r["cap"]) for r in sorted(swept, key=lambda r: r["seq"])] == [(1, None), (1, 5), (4, None), (4, 5)]
    assert all(r["largest_group_size"] <= 5 for r in swept if r["cap"])


def test_far_hashes_are_compared_by_blocks_and_names_stay_in_bounded_arrays(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK", 16)
    monkeypatch.setattr(pairs, "NAMES", 3)
    rng = random.Random(3)
    bases = [rng.getrandbits(64) for _ in range(6)]
    hashes = {f"f{i:03d}": rng.choice(bases) ^ sum(1 << b for b in rng.sample(range(64), rng.choice([0, 0, 3, 9, 20]))) for i in range(120)}
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    rows = [(n, signed(h)) for n, h in hashes.items()] + [("f000", signed(hashes["f001"])), ("f000", signed(hashes["f000"])), (None, 1), ("none", None)]
    found = pairs.similar_pairs(spark.createDataFrame(rows, "file_name string, hash long"), 16)
    plan = pairs.distinct_pairs(spark.createDataFrame(rows, "file_name string, hash long"), 16)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "BroadcastHashJoin" not in plan
    want = {}
    for n, h in rows[:-2]:
        for m, g in rows[:-2]:
            apart = bin((h ^ g) & (2**64 - 1)).count("1")
            if n < m and apart <= 16:
                want[n, m] = min(apart, want.get((n, m), 64))
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(want) and {(a, b): d for a, b, d in got} == want
    close = pairs.distinct_pairs(spark.createDataFrame(rows, "file_name string, hash long"), 2, 64)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in close and "MapInArrow" not in close


def test_groups_of_many_files_are_joined_by_exchanges(spark):
    files = spark.createDataFrame([("a", 0), ("b", 1), ("c", 7)], "file_name string, hash long")
    grouped = groups.build_groups(files, 1, None, 16)
    for made in (grouped, groups.group_manifest(grouped), groups.build_groups(files, 1, 2, 16)):
        assert "BroadcastHashJoin [file_name" not in (text := made._jdf.queryExecution().executedPlan().toString()) and "BroadcastHashJoin [hash" not in text and "BroadcastHashJoin [root" not in text
