"""All links at the threshold are found, in groups of any size."""

import random

import pytest

from fernlake.llm import simhash
from tests.llm.test_near_duplicates import similar_groups, word_set

SCHEMA = "doc_id long, text string"


def words(rng, n):
    return ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]


def alike(a, b):
    x, y = word_set(a), word_set(b)
    return len(x & y) / len(x | y)


def copy_of(rng, base, low, high):
    """A text whose similarity to the base lies between the two."""
    while True:
        own, at = list(base), rng.sample(range(len(base)), rng.randint(1, 1 + len(base) // 20))
        for i in at:
            own[i] = words(rng, 1)[0]
        if low <= alike(" ".join(base), " ".join(own)) < high:
            return " ".join(own)


def grouped(spark, texts):
    return {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(spark.createDataFrame(list(texts.items()), SCHEMA)).collect()}


def test_a_large_group_hangs_together_through_its_original(spark):
    rng = random.Random(11)
    base = words(rng, 200)
    texts = {i: copy_of(rng, base, 0.8, 0.84) for i in range(250)} | {1000: " ".join(base)}
    assert all(alike(texts[0], texts[i]) < 0.8 for i in range(1, 50))
    assert set(grouped(spark, texts).values()) == {0}


def test_small_groups_equal_an_exhaustive_comparison(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 1, raising=False)
    rng = random.Random(12)
    texts = {}
    for _ in range(30):
        base = words(rng, rng.randint(60, 250))
        texts |= {len(texts): " ".join(base)}
        chain = base
        for _ in range(rng.randint(3, 8)):
            chain = copy_of(rng, chain, 0.78, 0.86).split()
            texts |= {len(texts): " ".join(chain)}
    assert grouped(spark, texts) == similar_groups(texts)


def test_isolated_pairs_just_over_the_threshold_are_found(spark):
    rng = random.Random(13)
    texts = {}
    for i in range(150):
        base = words(rng, rng.choice([20, 60, 200, 400]))
        low = 0.8 if i % 3 else 0.7
        texts |= {2 * i: " ".join(base), 2 * i + 1: copy_of(rng, base, low, low + 0.1 if len(base) == 20 else low + 0.05)}
    want = similar_groups(texts)
    assert len(set(want.values())) == 200
    assert grouped(spark, texts) == want


@pytest.mark.parametrize("block, recent", [(1, 1), (1024, 3)])
def test_texts_that_share_most_shingles_without_being_alike(spark, monkeypatch, block, recent):
    """Parts in common, in several mixtures: most pairs have many common shingles, some of them enough."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "RECENT", recent)
    rng = random.Random(14)
    parts, texts = [words(rng, 30) for _ in range(12)], {}
    for i in range(120):
        chosen = rng.sample(parts, rng.randint(8, 11)) if i % 3 else [p for p in parts if rng.random() < 0.9]
        texts[i] = " ".join(sum(chosen, []) + words(rng, rng.randint(0, 40)))
    want = similar_groups(texts)
    assert 5 < len(set(want.values())) < 115
    assert grouped(spark, texts) == want
