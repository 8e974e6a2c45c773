import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fernlake.llm import simhash

SCHEMA = "doc_id long, text string, fp string"


def plain_fingerprint(text, size=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    runs = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, radius=2):
    names = sorted(fps)
    group = {n: n for n in names}
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if bin(fps[a] ^ fps[b]).count("1") <= radius and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {n: low if g == high else g for n, g in group.items()}
    return group


def test_fingerprints_by_definition(spark):
    texts = ["", None, "One", "a b", "A b\tC\nd e", "x " * 5000, "É ß \u00a0 nbsp\u2003wide", "same same same same same"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], SCHEMA)
    got = {r["doc_id"]: r["fp"] & (2**64 - 1) for r in simhash.fingerprints(df).collect()}
    assert got == {i: plain_fingerprint(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("pair_rows", [0, 3, 32])
def test_components_equal_brute_force(spark, monkeypatch, pair_rows):
    monkeypatch.setattr(simhash, "PAIR_ROWS", pair_rows)
    rng = random.Random(5)
    bases = [rng.getrandbits(64) for _ in range(5)] + [0, 2**64 - 1]
    fps = {}
    for i in range(160):
        h = rng.choice(bases)
        for _ in range(rng.randint(0, 5)):
            h ^= 1 << rng.randrange(64)
        fps[i] = h
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in set(fps.values())], "fp long")
    for radius in (0, 1, 2):
        links = simhash.close_pairs(df, radius).collect()
        assert all(bin((r["u"] ^ r["v"]) & (2**64 - 1)).count("1") <= radius for r in links)
        own = {v: v for v in set(fps.values())}
        for r in links:
            a, b = sorted(own[x & (2**64 - 1)] for x in (r["u"], r["v"]))
            own = {k: a if g == b else g for k, g in own.items()}
        want = components({v: v for v in set(fps.values())}, radius)
        assert len(set(own.values())) == len(set(want.values()))
        assert {frozenset(k for k in own if own[k] == g) for g in own.values()} == {frozenset(k for k in want if want[k] == g) for g in want.values()}


def test_documents_end_to_end(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = simhash.near_duplicates(docs.withColumn("fp", F.lit("clash"))).collect()
    fps = {r["doc_id"]: plain_fingerprint(r["text"]) for r in docs.collect()}
    assert {r["doc_id"]: r["component_id"] for r in got} == components(fps)


def test_ties_nulls_and_nothing(spark):
    df = spark.createDataFrame([(3, "", "x"), (2, None, "x"), (2, None, "x"), (None, "only here", "x"), (None, None, "x")], SCHEMA)
    got = sorted((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df).filter("doc_id is not null").collect())
    assert got == [(2, 2), (2, 2), (3, 2)]
    assert simhash.near_duplicates(df).count() == 5
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        simhash.close_pairs(df.select(F.lit(1).alias("fp")), 3)


def word_set(text, size=5):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} or {tuple(words)}


def similar_groups(texts, similarity=0.8):
    sets = {d: word_set(t) for d, t in texts.items()}
    group = {d: d for d in texts}
    names = sorted(texts)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            both = len(sets[a] & sets[b])
            if group[a] != group[b] and both >= similarity * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((group[a], group[b]))
                group = {d: low if g == high else g for d, g in group.items()}
    return group


@pytest.mark.parametrize("block, recent", [(2, 4), (1024, 1)])
def test_similar_documents(spark, monkeypatch, block, recent):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "RECENT", recent)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts, at = {}, 0
    for _ in range(12):
        base = [word() for _ in range(rng.randint(60, 300))]
        for copy in range(rng.randint(1, 12)):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                own[rng.randrange(len(own))] = word()
            texts[at] = " ".join(own).upper() if copy % 3 == 2 else "\n".join(own)
            at += 1
    for t in ("", None, "a b", "a b", "A  b c"):
        texts[at] = t
        at += 1
    want = similar_groups(texts)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(spark.createDataFrame([(k, v, "x") for k, v in texts.items()], SCHEMA)).collect()}
    assert got == want
    assert {d for d in got if not texts[d]} == {d for d in got if got[d] == got[at - 5]}


def test_similar_documents_of_nothing_and_ties(spark):
    df = spark.createDataFrame([(3, "same words here", "x"), (3, "same words here", "x"), (None, "same words here", "x"), (1, None, "x")], SCHEMA)
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.similar_documents(df).collect()), key=repr)
    assert got == [(1, 1), (3, 3), (3, 3), (None, 3)]
    assert simhash.similar_documents(df.limit(0)).count() == 0


def test_sieve_lets_all_that_are_there_through(spark):
    from fernlake.llm.sieve import maybe_among

    there = [0, -1, 1, 63, 64, 2**63 - 1, -(2**63), 12345678901234, -7]
    hashes = spark.createDataFrame([(h,) for h in there] + [(None,)], "h long")
    asked = spark.createDataFrame([(h,) for h in there + list(range(1000, 1400))] + [(None,)], "x long")
    for bits, most in ((1 << 20, 3), (64, 400)):
        got = {r["x"] for r in asked.filter(maybe_among(hashes, bits)(F.col("x"))).collect()}
        assert set(there) <= got and None not in got and len(got) <= len(there) + most
    assert asked.filter(maybe_among(hashes.limit(0), 1 << 10)(F.col("x"))).count() == 0


def test_wide_bitmaps_rule_out_no_similar_sets(spark):
    rng = np.random.default_rng(11)
    rows, told = [], []
    for size in (100, 257, 300, 511, 513, 1000, 1025, 5000):
        for share in (0.0, 0.3, 0.7, 0.8, 0.9, 1.0):
            for grown in (0, 0.2):
                x = rng.integers(0, 1 << 63, size, dtype=np.uint64)
                y = np.concatenate([x[: int(share * size)], rng.integers(0, 1 << 63, int((1 - share + grown) * size), dtype=np.uint64)])
                both = len(np.intersect1d(x, y))
                told.append(both >= 0.8 * (len(x) + len(y) - both) - 1e-9)
                rows.append((len(told) - 1, (len(x), simhash.wide_parity(x).tolist()), (len(y), simhash.wide_parity(y).tolist())))
    made = spark.createDataFrame(rows, "i int, x struct<size int, wide array<long>>, y struct<size int, wide array<long>>")
    kept = {r.i for r in made.filter(simhash._near_wide(0.8, "x", "y")).select("i").collect()}
    swapped = {r.i for r in made.filter(simhash._near_wide(0.8, "y", "x")).select("i").collect()}
    alike = {i for i, same in enumerate(told) if same}
    assert kept == swapped and alike <= kept
    # small sets have no wide bitmap and pass; larger ones without a common shingle do not
    assert 0 in kept and not any(i in kept for i in range(12, len(told)) if i % 12 < 2)
