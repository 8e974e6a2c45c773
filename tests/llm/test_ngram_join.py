"""Token-combination prefixes against exhaustive comparisons."""

import random

import numpy as np
import pytest

from fernlake.llm import ngram_join, shingle_ranks, simhash

SCHEMA = "doc_id long, text string, size int, token string"


def word_grams(text):
    words = (text or "").encode().translate(simhash.LOWER).split()
    return {tuple(words[i : i + 4]) for i in range(len(words) - 3)} if len(words) >= 4 else ({tuple(words)} if words else set())


def slow(texts, percent=85):
    """Component of every document by comparing all pairs."""
    sets = {k: word_grams(t) for k, t in texts.items()}
    root = {k: k for k in texts}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(texts)
    for i, x in enumerate(keys):
        for y in keys[:i]:
            if sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                a, b = sorted((find(x), find(y)))
                root[b] = a
    return {k: (len(sets[k]), find(k)) for k in texts}


def fast(spark, texts):
    got = ngram_join.joined(spark.createDataFrame([(k, t, 1, "x") for k, t in texts.items()], SCHEMA).repartition(3))
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()}


def corpus(rng, groups, words):
    texts = {}
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.randint(1, 160))]
        for _ in range(rng.randint(1, 7)):
            own = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 25)):
                own[rng.randrange(len(own))] = rng.choice(words)
            texts[len(texts)] = " ".join(own[: len(own) - rng.randint(0, len(own) // 12)])
    return texts


def test_equals_all_pairs(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(4000)]
    texts = corpus(rng, 60, words) | {900: "", 901: None, 902: " \t\n", 903: "One two", 904: "one  TWO", 905: "one two three", 906: "a " * 500, 907: "a " * 900, 908: "É a b c", 909: "é a b c"}
    assert fast(spark, texts) == slow(texts)


@pytest.mark.parametrize("pairs, triples", [(1, 256), (1, 1), (0, 256), (0, 0), (0, 3)])
def test_frequent_tokens_lose_no_pair(spark, monkeypatch, pairs, triples):
    """With classes so wide that most tokens, or all, are indexed by combinations."""
    plain = ngram_join.signatures
    monkeypatch.setattr(ngram_join, "signatures", lambda tokens, ranks, similarity: plain(tokens, ranks, similarity, pairs, triples))
    rng = random.Random(3)
    texts = corpus(rng, 40, ["ab", "cd", "ef", "gh", "ij", "kl", "mn"])
    assert fast(spark, texts) == slow(texts)


def test_similar_sets_share_a_signature():
    draw = np.random.default_rng(4)
    ranks = np.where(draw.random(1 << 10) < 0.4, 0, draw.integers(1, 120, 1 << 10)).astype(np.uint8)
    hot = np.flatnonzero(ranks >= 40)
    combined = False
    for turn in range(1500):
        n = int(np.exp(draw.uniform(0, 6.5))) + 1
        base = draw.integers(0, 1 << 62, n).astype(np.uint64)
        if turn % 3:  # nothing but frequent tokens
            base = base & ~np.uint64(1023) | draw.choice(hot, n).astype(np.uint64)
        base = np.unique(base)
        other = base[draw.random(len(base)) >= draw.uniform(0, 0.12)]
        if turn % 2:
            other = np.union1d(other, draw.integers(0, 1 << 62, draw.integers(0, 1 + len(base) // 12)).astype(np.uint64))
        both = len(np.intersect1d(base, other))
        if not len(other) or 100 * both < 85 * (len(base) + len(other) - both):
            continue
        (x, singles), (y, _) = (ngram_join.signatures(s, ranks, 0.85, 30, 80) for s in (base, other))
        combined |= singles < len(x)
        assert np.intersect1d(x, y).size, (turn, len(base), len(other))
    assert combined


def test_signatures_stay_few():
    """A long set of nothing but frequent tokens has a few signatures a token, not all its combinations."""
    draw = np.random.default_rng(5)
    tokens, ranks = np.unique(draw.integers(0, 1 << 62, 20_000).astype(np.uint64)), np.full(1 << 10, 200, np.uint8)
    for triples, most in ((256, 3), (1, 9)):
        assert len(ngram_join.signatures(tokens, ranks, 0.85, 1, triples)[0]) < most * len(tokens)


def test_a_large_group_about_one_text(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]
    base = words[:200]
    texts = {1000: " ".join(base)}
    for k in range(200):
        own = list(base)
        for at in rng.sample(range(len(own)), 3):
            own[at] = rng.choice(words)
        texts[k] = " ".join(own)
    texts |= {2000 + k: " ".join(rng.sample(words, 40) + base[:150]) for k in range(40)}  # share a passage and no more
    assert fast(spark, texts) == slow(texts)


def test_edges(spark):
    texts = [(None, "a b c d e", 1, "x"), (4, "a b c d e", 1, "x"), (4, "quite another text of some words", 1, "x"), (9, "A b C d  e", 1, "x"), (9, "A b C d  e", 1, "x"), (None, "", 1, "x"), (7, "w " * 30_000 + "end", 1, "x")]
    df = spark.createDataFrame(texts, SCHEMA)
    got = sorted(map(tuple, ngram_join.joined(df).collect()), key=repr)
    assert got == sorted([(None, 2, 4), (4, 2, 4), (4, 3, 4), (9, 2, 4), (9, 2, 4), (None, 0, None), (7, 2, 7)], key=repr)
    assert ngram_join.joined(df.limit(0)).count() == 0


def test_query_equals_all_pairs(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.query(spark, data).collect()}
    assert got == slow({r["doc_id"]: r["text"] for r in docs})


def test_ranks_tell_common_from_rare(spark):
    draw = np.random.default_rng(7)
    common = [f"{i} license terms apply here" for i in range(5)]
    rows = [(i, " ".join([*(str(x) for x in draw.integers(0, 1 << 40, 40)), common[i % 5]])) for i in range(600)]
    hashes = lambda text: simhash.shingle_set(text, 4)
    ranks = shingle_ranks.shingle_ranks(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), hashes, "text")
    told = shingle_ranks.looked_up(hashes("license terms apply here"), ranks)
    assert told.tolist() == [shingle_ranks.rank_of_count(599)] or abs(int(told[0]) - shingle_ranks.rank_of_count(599)) <= 1
    assert (shingle_ranks.looked_up(hashes(rows[0][1]), ranks) == 0).mean() > 0.9
