"""Language identification by a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are cut into windows of ``WINDOW`` bytes. Over each window one recurrence
runs forward and one backward, and every byte is labelled from both states. A document's
probabilities are the mean of those of its bytes, over the whole text. All windows of a
batch advance together, so the work is a few array operations for each of ``WINDOW`` steps.

Gates, with ``x`` the byte's learned row and ``h`` the state: ``z, r = sigmoid(x + h U)``,
``n = tanh(x + r (h U))``, ``h' = n + z (h - n)``. Training is backpropagation through time in
numpy with Adam, on at most ``PER_LANGUAGE`` documents of each language (those with the
smallest hash of their id), of which texts longer than ``ROW_BYTES`` and what would bring a language
over ``LANGUAGE_BYTES`` are no part. Of the documents it learns from every window takes part in the draw.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HIDDEN, WINDOW = 8, 64
#: Training documents of each language, bytes of one of them, and of all of a language.
PER_LANGUAGE, ROW_BYTES, LANGUAGE_BYTES = 300, 1 << 20, 1 << 23
STEPS, BATCH, RATE, SEED = 220, 192, 0.02, 0
#: Windows that advance together when scoring.
TOGETHER = 2048
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def initial(n_labels: int, hidden: int = HIDDEN, seed: int = SEED) -> dict[str, np.ndarray]:
    """Index 256 is the padding byte. ``x`` holds the bytes' rows, ``u`` the recurrences, ``v`` and ``b`` the labels'."""
    rng = np.random.default_rng(seed)
    made = {f"x{d}": rng.normal(0, 0.3, (257, 3 * hidden)) for d in "fb"}
    made |= {f"u{d}": rng.normal(0, hidden**-0.5, (hidden, 3 * hidden)) for d in "fb"}
    made |= {f"v{d}": rng.normal(0, hidden**-0.5, (hidden, n_labels)) for d in "fb"} | {"b": np.zeros(n_labels)}
    return {k: v.astype(np.float32) for k, v in made.items()}


def run_direction(codes: np.ndarray, x: np.ndarray, u: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """States of one recurrence over ``codes (steps, rows)``; each step's ``h before, z, r, n, h U``."""
    size = len(u)
    h = np.zeros((codes.shape[1], size), np.float32)
    trace = []
    for step in codes:
        a, hu = x[step], h @ u
        g = _sigmoid(a[:, : 2 * size] + hu[:, : 2 * size])
        z, r = g[:, :size], g[:, size:]
        n = np.tanh(a[:, 2 * size :] + r * hu[:, 2 * size :])
        trace.append((h, z, r, n, hu))
        h = n + z * (h - n)
    trace.append((h,))
    return trace


def back_direction(codes: np.ndarray, trace: list, grads: np.ndarray, x: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of ``x`` and ``u``; ``grads[t]`` is that of the state after step t from its labels."""
    size = len(u)
    dx, du = np.zeros_like(x), np.zeros_like(u)
    dh = np.zeros_like(trace[0][0])
    for t in range(len(codes) - 1, -1, -1):
        h, z, r, n, hu = trace[t]
        dh = dh + grads[t]
        dn = dh * (1 - z) * (1 - n * n)
        dz = dh * (h - n) * z * (1 - z)
        dr = dn * hu[:, 2 * size :] * r * (1 - r)
        gates = np.concatenate([dz, dr], 1)
        dhu = np.concatenate([gates, dn * r], 1)
        np.add.at(dx, codes[t], np.concatenate([gates, dn], 1))
        du += h.T @ dhu
        dh = dh * z + dhu @ u.T
    return dx, du


def loss_and_gradients(net: dict, codes: np.ndarray, labels: np.ndarray) -> tuple[float, dict]:
    """Mean cross entropy over all positions of ``codes (steps, rows)`` that are not padding."""
    forward, backward = run_direction(codes, net["xf"], net["uf"]), run_direction(codes[::-1], net["xb"], net["ub"])
    hf = np.stack([s[0] for s in forward[1:]])
    hb = np.stack([s[0] for s in backward[1:]])[::-1]
    logits = hf @ net["vf"] + hb @ net["vb"] + net["b"]
    p = np.exp(logits - logits.max(-1, keepdims=True))
    p /= p.sum(-1, keepdims=True)
    real = (codes < 256)[:, :, None]
    target = np.eye(p.shape[-1], dtype=np.float32)[labels][None]
    n = max(1, int(real.sum()))
    loss = float(-(np.log(np.maximum(p, 1e-9)) * target * real).sum() / n)
    d = ((p - target) * real / n).astype(np.float32)
    flat = d.reshape(-1, d.shape[-1])
    grads = {"vf": hf.reshape(-1, hf.shape[-1]).T @ flat, "vb": hb.reshape(-1, hb.shape[-1]).T @ flat, "b": flat.sum(0)}
    grads["xf"], grads["uf"] = back_direction(codes, forward, d @ net["vf"].T, net["xf"], net["uf"])
    grads["xb"], grads["ub"] = back_direction(codes[::-1], backward, (d @ net["vb"].T)[::-1], net["xb"], net["ub"])
    return loss, grads


def windows_of(data: bytes, size: int = WINDOW) -> np.ndarray:
    """``(windows, size)`` codes, the last one padded."""
    n = -(-len(data) // size)
    out = np.full(n * size, 256, np.int16)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(n, size)


def train(texts: list[tuple[str, int]], n_labels: int, **options) -> dict[str, np.ndarray]:
    """A network from labelled texts, whole."""
    return train_windows([(windows_of(t.encode("utf-8", "surrogatepass")), y) for t, y in texts], n_labels, **options)


def train_windows(cut: list[tuple[np.ndarray, int]], n_labels: int, steps: int = STEPS, batch: int = BATCH, seed: int = SEED) -> dict[str, np.ndarray]:
    """A network from ``(windows, label)`` of each document; every label has an equal share of each step."""
    net, rng = initial(n_labels, seed=seed), np.random.default_rng(seed)
    cut = [(w, y) for w, y in cut if len(w)]
    if not cut or n_labels < 2:
        return net
    codes, labels = np.concatenate([w for w, _ in cut]), np.repeat([y for _, y in cut], [len(w) for w, _ in cut])
    by = [np.flatnonzero(labels == y) for y in range(n_labels)]
    by = [b for b in by if len(b)]
    m = {k: np.zeros_like(v) for k, v in net.items()}
    s = {k: np.zeros_like(v) for k, v in net.items()}
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(b, -(-batch // len(by))) for b in by])
        _, grads = loss_and_gradients(net, np.ascontiguousarray(codes[pick].T), labels[pick])
        norm = max(1.0, float(np.sqrt(sum((g * g).sum() for g in grads.values()))))
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in grads.items():
            g = g / norm
            m[k] = 0.9 * m[k] + 0.1 * g
            s[k] = 0.99 * s[k] + 0.01 * g * g
            net[k] = (net[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def _advance(codes: np.ndarray, x: np.ndarray, u: np.ndarray, v: np.ndarray, out: np.ndarray) -> None:
    """Add each step's label scores to ``out (steps, rows, labels)``; gates' halves are in the weights."""
    size = len(u)
    h = np.zeros((codes.shape[1], size), np.float32)
    for step, score in zip(codes, out):
        a, hu = x[step], h @ u
        g = np.tanh(a[:, : 2 * size] + hu[:, : 2 * size])
        g *= np.float32(0.5)
        g += np.float32(0.5)
        n = g[:, size:] * hu[:, 2 * size :]
        n += a[:, 2 * size :]
        np.tanh(n, out=n)
        h -= n
        h *= g[:, :size]
        h += n
        score += h @ v


def label_windows(net: dict, codes: np.ndarray) -> np.ndarray:
    """Label probabilities ``(rows, steps, labels)`` of every byte of ``codes (rows, steps)``."""
    size = len(net["uf"])
    half = np.concatenate([np.full(2 * size, 0.5), np.ones(size)]).astype(np.float32)
    steps = np.ascontiguousarray(codes.T)
    out = np.empty((codes.shape[1], len(codes), len(net["b"])), np.float32)
    out[:] = net["b"]
    _advance(steps, net["xf"] * half, net["uf"] * half, net["vf"], out)
    _advance(steps[::-1], net["xb"] * half, net["ub"] * half, net["vb"], out[::-1])
    out -= out.max(-1, keepdims=True)
    np.exp(out, out=out)
    out /= out.sum(-1, keepdims=True)
    return out.transpose(1, 0, 2)


def document_probabilities(net: dict, texts: list[bytes]) -> np.ndarray:
    """Mean label probabilities over all bytes of each text; zeros for an empty one."""
    sums, counts = np.zeros((len(texts), len(net["b"]))), np.array([len(t) for t in texts])
    held: list[np.ndarray] = []
    owners: list[np.ndarray] = []
    rows = 0

    def flush() -> None:
        codes, owner = np.concatenate(held), np.concatenate(owners)
        for at in range(0, len(codes), TOGETHER):
            part = codes[at : at + TOGETHER]
            p = label_windows(net, part) * (part < 256)[:, :, None]
            np.add.at(sums, owner[at : at + TOGETHER], p.sum(1, dtype=np.float64))

    for i, text in enumerate(texts):
        if text:
            held.append(windows_of(text))
            owners.append(np.full(len(held[-1]), i))
            rows += len(held[-1])
        if rows >= 8 * TOGETHER or (i == len(texts) - 1 and rows):
            flush()
            held, owners, rows = [], [], 0
    return sums / np.maximum(counts, 1)[:, None]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> tuple[list[str], dict[str, np.ndarray]]:
    """Labels and network, learnt from rows with id, text and label that are not held out.

    Which rows may be among those is settled from ids and labels alone; only their texts, at most ``LANGUAGE_BYTES`` of a language, reach the driver.
    """
    own = docs.select(F.col(id_col).cast("long").alias("k"), F.col(label_col).alias("y"), F.col(text_col).alias("t"))
    known = own.filter("k is not null and y is not null").filter(~held_out(F.col("k")))
    # a language's share of hashes that holds twice the rows wanted: one row a language, broadcast, so that
    # rows are dropped where they are read and only a few hundred of each language are exchanged and ranked
    place = F.pmod(F.xxhash64("k"), F.lit(1 << 32))
    counted = known.groupBy("y").agg(F.count("*").alias("n"))
    share = counted.select("y", (F.lit(2.0 * PER_LANGUAGE * (1 << 32)) / F.col("n")).alias("below"))
    drawn = known.select("k", "y").join(F.broadcast(share), "y").filter(place < F.col("below"))
    first = Window.partitionBy("y").orderBy(place, "k")
    chosen = drawn.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= PER_LANGUAGE).select("k", "y").distinct()
    taken = known.filter(F.octet_length("t") <= ROW_BYTES).join(F.broadcast(chosen), ["k", "y"]).select("k", "y", "t")
    sized = taken.groupBy("k", "y").agg(F.min("t").alias("t"))  # an id with several texts is learnt from by one
    upto = F.sum(F.octet_length("t")).over(first.rowsBetween(Window.unboundedPreceding, 0))
    taken = sized.withColumn("upto", upto).filter(F.col("upto") <= LANGUAGE_BYTES).select("k", "y", "t")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [windows_of(t.encode("utf-8", "surrogatepass") if LETTER.search(t) else b"").tobytes() for t in batch["t"]]
            yield pd.DataFrame({"k": batch["k"], "y": batch["y"], "w": made})

    rows = taken.mapInPandas(cut, "k long, y string, w binary").collect()
    rows.sort(key=lambda r: (r["y"], r["k"]))
    labels = sorted({r["y"] for r in rows})
    return labels, train_windows([(np.frombuffer(r["w"], np.int16).reshape(-1, WINDOW), labels.index(r["y"])) for r in rows], len(labels))


def apply(docs: DataFrame, labels: list[str], net: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` of every whole text; ``und`` and 0 if it is null or has no letter."""
    sent = docs.sparkSession.sparkContext.broadcast((labels, net))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, weights = sent.value
        for batch in batches:
            there = [isinstance(t, str) and LETTER.search(t) is not None and len(names) > 0 for t in batch["t"]]
            p = document_probabilities(weights, [t.encode("utf-8", "surrogatepass") if ok else b"" for t, ok in zip(batch["t"], there)])
            best = p.argmax(1) if p.shape[1] else np.zeros(len(p), int)
            yield pd.DataFrame(
                {
                    "doc_id": batch["k"],
                    "lang_pred": [names[b] if ok else UNKNOWN for b, ok in zip(best, there)],
                    "score": [min(1.0, float(p[i, b])) if ok else 0.0 for i, (b, ok) in enumerate(zip(best, there))],
                }
            )

    return docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t")).mapInPandas(run, "doc_id long, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fernlake.runtime import table

    docs = table(spark, sf_dir, "documents")
    labelled = apply(docs, *fit(docs))
    return labelled.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
