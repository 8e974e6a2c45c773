import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fernlake.llm import ann_search, language_id, toxicity

DOCS = "doc_id long, text string, lang string, score string"


def test_gradients_of_the_network():
    rng = np.random.default_rng(0)
    net = {k: v.astype(np.float64) for k, v in language_id.initial(3, 4).items()}
    codes, labels = rng.integers(0, 257, (6, 5)), np.array([0, 1, 2, 0, 1])
    _, grads = language_id.loss_and_gradients(net, codes, labels)
    for name, value in net.items():
        for _ in range(5):
            at = tuple(rng.integers(0, n) for n in value.shape)
            if name[0] == "x":
                at = (codes[2, 1], at[1])
            low, high = ({**net, name: value.copy()} for _ in range(2))
            low[name][at] -= 1e-4
            high[name][at] += 1e-4
            slope = (language_id.loss_and_gradients(high, codes, labels)[0] - language_id.loss_and_gradients(low, codes, labels)[0]) / 2e-4
            assert slope == pytest.approx(grads[name][at], abs=1e-6)


def test_scoring_equals_training_pass():
    net = language_id.initial(3)
    codes = language_id.windows_of(("aé" * 50).encode())
    forward = language_id.run_direction(codes.T, net["xf"], net["uf"])
    backward = language_id.run_direction(codes.T[::-1], net["xb"], net["ub"])
    logits = np.stack([s[0] for s in forward[1:]]) @ net["vf"] + np.stack([s[0] for s in backward[1:]])[::-1] @ net["vb"] + net["b"]
    want = np.exp(logits) / np.exp(logits).sum(-1, keepdims=True)
    assert np.allclose(language_id.label_windows(net, codes).transpose(1, 0, 2), want, atol=1e-5)
    both = language_id.document_probabilities(net, [b"abc" * 100, b"", b"x"])
    assert np.allclose(both.sum(1), [1, 0, 1], atol=1e-5)


def test_language_of_held_out_documents(spark, data):
    got = language_id.query(spark, data).join(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert {r["held_out"] for r in got} == {True, False}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    unseen = [r for r in got if r["held_out"]]
    assert np.mean([r["lang"] == r["lang_pred"] for r in unseen]) >= 0.9


def test_language_edge_cases(spark):
    rows = [(1, None, "en", "x"), (2, "", "en", "x"), (3, "123 !?", "en", "x"), (4, "z" * 300_000, "en", "x"), (None, "word", "en", "x"), (4, "again", None, "x")]
    df = spark.createDataFrame(rows, DOCS)
    net = language_id.initial(2)
    got = [(r["doc_id"], r["lang_pred"]) for r in language_id.apply(df, ["a", "b"], net).collect()]
    assert [g[1] for g in got[:3]] == ["und"] * 3 and all(g[1] in "ab" for g in got[3:])
    labels, net = language_id.fit(df.limit(0))
    assert labels == [] and language_id.apply(df, labels, net).filter("lang_pred <> 'und'").count() == 0


def test_ftrl_learns_and_prunes():
    rng = np.random.default_rng(0)
    rows = []
    for i in range(300):
        noise = rng.integers(100, 5000, 30)
        rows.append((np.unique(np.append(noise, 7 if i % 3 == 0 else 8)).astype(np.uint32), int(i % 3 == 0)))
    weights, bias = toxicity.train(rows)
    assert toxicity.score(np.array([7]), weights, bias) > 0.5 > toxicity.score(np.array([8]), weights, bias)
    assert (weights != 0).mean() < 0.01
    assert not toxicity.train([])[0].any() and not toxicity.train(rows[:1])[0].any()


def test_features_are_words_pairs_and_skips():
    one = toxicity.features("You are, a clown.")
    assert len(one) == 4 + 3 + 2
    assert (toxicity.features("you ARE a  clown") == one).all()
    assert len(toxicity.features(None)) == len(toxicity.features("... !")) == 0
    assert len(toxicity.features("x")) == 1


def test_toxicity_query(spark, data):
    got = toxicity.query(spark, data).collect()
    assert len(got) == spark.read.parquet(f"{data}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)


def test_toxicity_of_planted_words(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        text = list(rng.choice(words, 40))
        if bad:
            text[int(rng.integers(40))] = "scoundrel,"
        rows.append((i, " ".join(text), "en", "clash"))
        labels.append((i, 1 if bad else 0))
    docs = spark.createDataFrame(rows + [(900, None, "en", "c"), (900, "", "en", "c"), (None, "scoundrel", "en", "c"), (901, "scoundrel " * 50_000, "en", "c")], DOCS)
    known = spark.createDataFrame(labels + [(None, 1), (3, None), (5000, 1), (8, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, known)
    got = {r["doc_id"]: r["score"] for r in toxicity.apply(docs, model).collect()}
    unseen = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all((got[i] >= 0.5) == (i % 4 == 0) for i in unseen)
    assert got[900] < 0.5 <= got[None]
    assert not toxicity.fit(docs.limit(0), known)[0].any()


def test_four_bit_tables_sum_products():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 10))
    books = ann_search.fit_books(x)
    codes = ann_search.assign(ann_search.padded(x), books, ann_search.eta_of(12))
    back = np.stack([books[j][codes[:, j]] for j in range(len(books))], 1).reshape(300, -1)
    q = rng.normal(size=(5, 10))
    rough = ann_search.scan(ann_search.pack4(codes), ann_search.tables_of(q, books))
    assert np.allclose(rough, ann_search.padded(q) @ back.T, atol=1e-4)


def test_anisotropic_loss_favours_the_direction():
    x = np.random.default_rng(1).normal(size=(1500, 16))
    books = ann_search.fit_books(x)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)

    def along(eta):
        codes = ann_search.assign(x, books, eta)
        back = np.stack([books[j][codes[:, j]] for j in range(len(books))], 1).reshape(x.shape)
        return (((x - back) * u).sum(1) ** 2).mean()

    assert along(8.0) < along(1.0)


def brute(rows, asks, k):
    out = {}
    for q, v in rows:
        if asks(q):
            scored = sorted(((-float(np.dot(np.float64(v), np.float64(w))), i) for i, w in rows if i != q))
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def test_search_recall_and_exact_scores(spark, data):
    df = spark.read.parquet(f"{data}/embeddings.parquet")
    rows = [(r["vec_id"], np.array(r["embedding"])) for r in df.collect()]
    want = brute(rows, lambda i: i % ann_search.EVERY == 0, ann_search.K)
    got = {}
    for r in ann_search.query(spark, data).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    assert got.keys() == want.keys()
    exact = {q: dict(v) for q, v in brute(rows, lambda i: i % ann_search.EVERY == 0, len(rows)).items()}
    assert all(s == pytest.approx(exact[q][i], abs=1e-12) for q, v in got.items() for i, s in v)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / len(want[q]) for q in want]) >= 0.9


def test_search_with_copies_and_bad_vectors(spark):
    rng = np.random.default_rng(2)
    good = [[float(x) for x in rng.normal(size=5)] for _ in range(30)]
    rows = [(i, good[0] if i < 60 else good[i % 30]) for i in range(100)]
    bad = [(200, None), (201, [0.0] * 5), (202, [1.0, None, 0.0, 0.0, 0.0]), (203, [float("nan")] * 5), (204, [float("inf")] * 5), (205, [1.0]), (None, good[1]), (20, good[0])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumn("rank", F.lit("clash"))
    got = {}
    for r in ann_search.nearest(df, F.col("vec_id") % 20 == 0, 7).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    want = brute(rows, lambda i: i % 20 == 0, 7)
    assert got == {q: [i for i, _ in v] for q, v in want.items()}
    assert ann_search.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = ann_search.nearest(df.filter("vec_id in (0, 61)"), F.col("vec_id") % 20 == 0).collect()
    assert [(r["query_id"], r["vec_id"]) for r in few] == [(0, 61)]


def test_ftrl_equals_the_textbook_update():
    rng = np.random.default_rng(4)
    rows = [(np.unique(rng.integers(0, 40, 6)).astype(np.uint32), int(rng.integers(2))) for _ in range(120)]
    alpha, beta, l1, l2, bias = 0.3, 1.0, 0.4, 1.0, 64
    learner = toxicity.FTRL(6, alpha, beta, l1, l2)
    z, n = dict.fromkeys(range(65), 0.0), dict.fromkeys(range(65), 0.0)

    def weight(i):
        pull = 0.0 if i == bias else l1
        if abs(z[i]) <= pull:
            return 0.0
        return -(z[i] - np.sign(z[i]) * pull) / ((beta + n[i] ** 0.5) / alpha + l2)

    for at, label in rows:
        own = [*at.tolist(), bias]
        w = {i: weight(i) for i in own}
        g = 1 / (1 + np.exp(-sum(w.values()))) - label
        for i in own:
            sigma = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha
            z[i] += g - sigma * w[i]
            n[i] += g * g
        learner.learn(at, label)
    assert learner.model()[0] == pytest.approx([weight(i) for i in range(64)], abs=1e-6)
    assert learner.model()[1] == pytest.approx(weight(bias))


def test_a_language_is_learnt_from_whole_texts_within_its_bytes(spark, monkeypatch):
    monkeypatch.setattr(language_id, "ROW_BYTES", 4000)
    monkeypatch.setattr(language_id, "LANGUAGE_BYTES", 20_000)
    learnt = []
    monkeypatch.setattr(language_id, "train_windows", lambda cut, n: learnt.extend(cut) or language_id.initial(n))
    rows = [(i, ("ab " if i % 2 else "yz ") * (1000 + i), "x" if i % 2 else "y") for i in range(40)] + [(100, "ab " * 5000, "x"), (101, None, "y")]
    language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3))
    for label in (0, 1):
        own = [w for w, y in learnt if y == label]
        assert 4 <= len(own) <= 6 and all(3000 <= (w < 256).sum() <= 4000 for w in own)  # none is cut, none is over


def test_clustered_vectors_need_few_cells(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 16)) * 4
    x = centres[rng.integers(8, size=4000)] + rng.normal(size=(4000, 16)) * 0.3
    found = ann_search.fit_cells(x, 16)
    assert ann_search.probes_for(x, found, 20) <= 6
    assert ann_search.probes_for(rng.normal(size=(3000, 16)), ann_search.fit_cells(x, 16), 20) <= 16
    asked = ann_search.cells_asked(x[:5], found, 3)
    assert (asked.sum(1) == 3).all() and asked[np.arange(5), (x[:5] @ found.T).argmax(1)].all()


def test_an_id_with_two_vectors_is_named_once(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [2.0, 0.0]), (1, [0.0, 3.0]), (2, [1.0, 1.0])]
    got = ann_search.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, 5).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(1, 3.0), (2, 1.0)]


def test_many_cells_and_waves_keep_recall(spark, monkeypatch):
    monkeypatch.setattr(ann_search, "BLOCK", 100)
    monkeypatch.setattr(ann_search, "WAVE", 20)
    rng = np.random.default_rng(6)
    rows = [(i, [float(v) for v in rng.normal(size=8)]) for i in range(1500)]
    got = {}
    for r in ann_search.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, 10).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = brute([(i, np.array(v)) for i, v in rows], lambda i: i % 20 == 0, 10)
    assert np.mean([len(got[q] & {i for i, _ in v}) / 10 for q, v in want.items()]) >= 0.9
