"""Maximum inner products by score-aware quantisation, four-bit table scans and exact reranking.

A vector is cut into subspaces of two dimensions with 16 codewords each. Codewords and
assignments minimise the anisotropic loss ``|r|^2 + (eta - 1) (u . r)^2`` with ``r`` the
residual and ``u`` the vector's direction: error along the vector, which moves large inner
products, costs ``eta`` times as much as error across it. Assignment is coordinate descent over
subspaces, codewords solve one linear system.

Vectors are dealt to cells, the regions of k-means centres, about one for each ``BLOCK`` vectors. A query first looks
into the cells with the largest products of query and centre; how many it takes is measured, on the
sample that centres are fitted on: as many as bring ``TARGET`` of the sample's nearest.

What sample, cells and codes miss on rows they do not fit is found by bounds. A block knows its ball, and a vector
how far its code is off; by Cauchy-Schwarz no product exceeds that with the ball's middle plus radius, or the code's plus
what it is off. What stays below the query's ``k`` th best of the sample, or of the task so far, is left out; the rest is
scored exactly. So nothing is missed on any rows. On vectors in clusters few blocks are read; without any structure most are.

The index is a table of blocks of four-bit codes with their vectors, sorted by cell, written to the shared
folder. A block is scanned for the queries that look into its cell: a query's products with all codewords
form tables, two subspaces to a byte, and a code's score is the sum of 32 / 2 lookups. The best ``RERANK`` of a
block, and those that bounds do not rule out, are scored exactly in double precision. Queries go out in waves of at most ``WAVE`` vectors; a wave
is ranked and written before the next, so the driver and the broadcasts never hold more than one,
and the index is never shuffled again.

Equal vectors are indexed once with their ``k + 1`` smallest ids, all that a result can name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fernlake.runtime import drop_path, materialize, new_path

K, EVERY = 20, 20
#: Vectors that codewords are fitted on (those with the smallest hash of their id).
SAMPLE = 4096
#: Threshold on the cosine above which products count, as a share; it sets eta.
THRESHOLD = 0.2
BLOCK, RERANK, WAVE, QUERY_PART, SUB = 4096, 256, 8192, 256, 2
#: Most cells (a centre needs some of the sample), and the share of the sample's nearest that the cells looked into must bring.
CELLS, TARGET = SAMPLE // 32, 0.99
#: Rounding of a double product, as a share of the vectors' lengths.
SLACK = 1e-9


def eta_of(dim: int, threshold: float = THRESHOLD) -> float:
    return max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))


def padded(x: np.ndarray) -> np.ndarray:
    """Zero columns up to a multiple of two subspaces."""
    return np.pad(x, ((0, 0), (0, -x.shape[1] % (2 * SUB))))


def assign(x: np.ndarray, books: np.ndarray, eta: float, sweeps: int = 2) -> np.ndarray:
    """Codes ``(n, m)``; ``books`` is ``(m, 16, SUB)``."""
    n, m = len(x), len(books)
    parts = x.reshape(n, m, SUB)
    u = (x / np.linalg.norm(x, axis=1, keepdims=True)).reshape(n, m, SUB)
    dist = np.stack([((parts[:, j, None] - books[j]) ** 2).sum(-1) for j in range(m)], 1)
    along = np.stack([(u[:, j, None] * (parts[:, j, None] - books[j])).sum(-1) for j in range(m)], 1)
    codes = dist.argmin(2)
    rows = np.arange(n)
    total = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(1)
    for _ in range(sweeps):
        for j in range(m):
            rest = total - along[rows, j, codes[:, j]]
            codes[:, j] = (dist[:, j] + (eta - 1) * (rest[:, None] + along[:, j]) ** 2).argmin(1)
            total = rest + along[rows, j, codes[:, j]]
    return codes.astype(np.uint8)


def fit_books(x: np.ndarray, rounds: int = 4, seed: int = 0) -> np.ndarray:
    """Codewords ``(m, 16, SUB)`` that minimise the anisotropic loss on the rows of ``x``."""
    x = padded(np.asarray(x, np.float64))
    n, d = x.shape
    m, eta = d // SUB, eta_of(d)
    rng = np.random.default_rng(seed)
    books = np.stack([x[rng.choice(n, 16, replace=n < 16), j * SUB : (j + 1) * SUB] for j in range(m)])
    for _ in range(6):  # plain k-means to start from
        for j in range(m):
            part = x[:, j * SUB : (j + 1) * SUB]
            near = ((part[:, None] - books[j]) ** 2).sum(-1).argmin(1)
            count = np.bincount(near, minlength=16)
            for c in range(SUB):
                books[j, :, c] = np.where(count, np.bincount(near, part[:, c], 16) / np.maximum(count, 1), books[j, :, c])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for _ in range(rounds):
        codes = assign(x, books, eta)
        column = ((np.arange(m) * 16 + codes) * SUB)[:, :, None] + np.arange(SUB)
        column = column.reshape(n, d)
        spread = np.zeros((n, m * 16 * SUB))
        np.put_along_axis(spread, column, u, 1)
        count = np.bincount(column.ravel(), minlength=m * 16 * SUB)
        left = (eta - 1) * spread.T @ spread
        left[np.diag_indices_from(left)] += count + 1e-6
        right = eta * np.bincount(column.ravel(), x.ravel(), m * 16 * SUB) + 1e-6 * books.ravel()
        books = np.linalg.solve(left, right).reshape(m, 16, SUB)
    return books


def pack4(codes: np.ndarray) -> np.ndarray:
    return codes[:, ::2] | (codes[:, 1::2] << 4)


def scan(packed: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Approximate scores ``(queries, rows)`` from byte tables ``(queries, pairs, 256)``."""
    out = np.zeros((len(tables), len(packed)), np.float32)
    for pair in range(packed.shape[1]):
        out += np.take(tables[:, pair], packed[:, pair], axis=1)
    return out


def tables_of(queries: np.ndarray, books: np.ndarray) -> np.ndarray:
    q = padded(queries).reshape(len(queries), -1, SUB)
    one = np.einsum("qms,mks->qmk", q, books).astype(np.float32)
    return (one[:, ::2, None, :] + one[:, 1::2, :, None]).reshape(len(q), -1, 256)


def fit_cells(x: np.ndarray, cells: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """Centres ``(cells, d)`` of the rows of ``x`` by k-means."""
    centres = x[np.random.default_rng(seed).choice(len(x), min(cells, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = cell_of(x, centres)
        for c in np.unique(own):
            centres[c] = x[own == c].mean(0)
    return centres


def cell_of(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x @ centres.T - 0.5 * (centres**2).sum(1)).argmax(1)


def cells_asked(q: np.ndarray, centres: np.ndarray, probes: int) -> np.ndarray:
    """``(queries, cells)``, true for the ``probes`` cells with the largest products."""
    asked = np.zeros((len(q), len(centres)), bool)
    np.put_along_axis(asked, np.argsort(-(q @ centres.T), 1, kind="stable")[:, :probes], True, 1)
    return asked


def probes_for(x: np.ndarray, centres: np.ndarray, k: int, target: float = TARGET) -> int:
    """Fewest cells for each query that bring ``target`` of the nearest among the rows of ``x``."""
    if len(centres) < 2 or len(x) <= k + 1:
        return len(centres)
    q, own = x[:512], cell_of(x, centres)
    products = q @ x.T
    products[np.arange(len(q)), np.arange(len(q))] = -np.inf
    near = own[np.argpartition(-products, k - 1, 1)[:, :k]]
    place = np.argsort(np.argsort(-(q @ centres.T), 1, kind="stable"), 1)
    found = np.take_along_axis(place, near, 1)
    return next(p for p in range(1, len(centres) + 1) if (found < p).mean() >= target)


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def floors_of(q: np.ndarray, sample: np.ndarray, k: int) -> np.ndarray:
    """What the ``k`` nearest of each query reach at least, by ``sample``, vectors of as many ids (the query's own may be one)."""
    if len(sample) <= k:
        return np.full(len(q), -np.inf)
    out = np.empty(len(q))
    size = np.linalg.norm(sample, axis=1).max()
    for a in range(0, len(q), 512):
        part = q[a : a + 512]
        out[a : a + 512] = np.partition(part @ sample.T, len(sample) - k - 1, 1)[:, len(sample) - k - 1] - SLACK * np.linalg.norm(part, axis=1) * size
    return np.where(np.isfinite(out), out, -np.inf)


def build_index(rows: DataFrame, dim: int, k: int) -> tuple[DataFrame, str, tuple[np.ndarray, np.ndarray, int, np.ndarray]]:
    """Blocks ``cell, n, ids, codes, vectors, off, middle, radius`` of all distinct vectors, their path, and codewords, centres, cells to look into and a sample with one vector an id."""
    spark = rows.sparkSession
    order = Window.partitionBy("v").orderBy("id")
    classes = rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v", "id").collect()
    sample = np.array([r[0] for r in drawn], np.float64)
    named = np.array(list({r[1]: r[0] for r in drawn}.values()), np.float64).reshape(-1, max(1, dim))
    if len(sample):
        books, centres = fit_books(sample), fit_cells(sample, min(CELLS, max(1, rows.count() // BLOCK)))
    else:
        books, centres = np.zeros((1, 16, SUB)), np.zeros((1, dim))
    model = books, centres, probes_for(sample, centres, k) if len(sample) else 1, named
    sent = spark.sparkContext.broadcast(model[:2])

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cell = cell_of(np.array(batch["v"].to_list(), np.float64).reshape(len(batch), -1), sent.value[1]) if len(batch) else np.zeros(0, int)
            yield batch.assign(cell=cell.astype(np.int32))[["cell", "ids", "v"]]

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: list = []
        held: list = []
        at = -1

        def row() -> pd.DataFrame:
            x = np.array(held, np.float64)
            width = max(map(len, ids))
            named = np.full((len(ids), width), np.iinfo(np.int64).min, np.int64)
            for i, own in enumerate(ids):
                named[i, : len(own)] = own
            books = sent.value[0]
            codes = assign(padded(x), books, eta_of(padded(x).shape[1]))
            off = np.linalg.norm(padded(x) - books[np.arange(len(books)), codes].reshape(len(x), -1), axis=1)
            middle = x.mean(0)
            radius = float(np.linalg.norm(x - middle, axis=1).max())
            return pd.DataFrame({"cell": [at], "n": [len(ids)], "ids": [named.tobytes()], "codes": [pack4(codes).tobytes()], "vectors": [x.tobytes()], "off": [off.tobytes()], "middle": [middle.tobytes()], "radius": [radius]})

        for batch in batches:
            for cell, own, v in zip(batch["cell"], batch["ids"], batch["v"]):
                if held and (cell != at or len(held) == BLOCK):
                    yield row()
                    ids, held = [], []
                at = cell
                ids.append(own)
                held.append(v)
        if held:
            yield row()

    # ranges of (cell, hash) split a cell that many vectors fall in
    placed = classes.select("ids", "v").mapInPandas(dealt, "cell int, ids array<long>, v array<double>").withColumn("h", F.xxhash64("v"))
    ranged = placed.repartitionByRange("cell", "h").sortWithinPartitions("cell", "h").select("cell", "ids", "v")
    index, path = materialize(ranged.mapInPandas(blocks, "cell int, n int, ids binary, codes binary, vectors binary, off binary, middle binary, radius double"), "index")
    return index, path, model


def search_index(index: DataFrame, model: tuple[np.ndarray, np.ndarray, int, np.ndarray], queries: DataFrame, dim: int, k: int, vectors_an_id: int = 1) -> DataFrame:
    """``query_id, rank, vec_id, score``: the best of all blocks for each query, wave by wave. An id has ``vectors_an_id`` vectors at most."""
    spark = index.sparkSession
    books, centres, probes, sample = model
    waves = max(1, -(-queries.count() // (WAVE * 3 // 4)))
    path = new_path(spark, "queries")
    queries.withColumn("wave", F.pmod(F.xxhash64("id"), F.lit(waves)).cast("int")).repartition("wave").write.partitionBy("wave").parquet(path)
    asked = spark.read.schema("id long, v array<double>, wave int").parquet(path)
    best, out = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"), None
    for wave in range(waves):
        own = asked.filter(F.col("wave") == wave).collect()
        q = np.array([r["v"] for r in own], np.float64).reshape(len(own), dim)
        sent = spark.sparkContext.broadcast((np.array([r["id"] for r in own], np.int64), q, cells_asked(q, centres, probes), books, floors_of(q, sample, k)))
        # an id with several vectors is as near as the nearest of them
        got = index.mapInPandas(_scanner(sent, (k + 1) * vectors_an_id), "query_id long, vec_id long, score double").filter("vec_id <> query_id").repartition("query_id")
        ranked = got.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        found, _ = materialize(ranked.select("query_id", "rank", "vec_id", "score"), "nearest")
        sent.destroy()
        out = found if out is None else out.union(found)
    drop_path(spark, path)
    return out


def _scanner(sent, held: int):
    """The best ``held`` vectors of a task for each query: enough to name ``k`` ids beside the query's own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, q, asked, books, floors = sent.value
        if not len(names):
            return
        score = np.full((len(q), held), -np.inf)  # the task's best so far
        first = np.full((len(q), held), np.iinfo(np.int64).max)
        place = np.full((len(q), held), -1)
        length = np.linalg.norm(q, axis=1)
        kept: list[np.ndarray] = []
        at = 0

        def take(part: np.ndarray, near: np.ndarray, ok: np.ndarray | None, x: np.ndarray, ids: np.ndarray) -> None:
            """Scores rows ``near`` of a block (those ``ok``) exactly and keeps the best."""
            exact = (x[near] * q[part][:, None]).sum(-1)
            if ok is not None:
                exact = np.where(ok, exact, -np.inf)
            s = np.concatenate([score[part], exact], 1)
            i = np.concatenate([first[part], ids[near, 0]], 1)
            p = np.concatenate([place[part], np.where(exact > -np.inf, at + near, -1)], 1)
            best = np.lexsort((i, -s), axis=1)[:, :held]
            score[part], first[part], place[part] = (np.take_along_axis(z, best, 1) for z in (s, i, p))

        def limits(part: np.ndarray, size: float) -> np.ndarray:
            """What is below it is none of the nearest, whatever the rounding of a product of vectors of up to ``size``."""
            return np.maximum(floors[part], score[part, -1]) - SLACK * length[part] * size

        for batch in batches:
            for cell, n, ids, codes, vectors, off, middle, radius in zip(*(batch[c] for c in ("cell", "n", "ids", "codes", "vectors", "off", "middle", "radius"))):
                ids = np.frombuffer(ids, np.int64).reshape(n, -1)
                packed = np.frombuffer(codes, np.uint8).reshape(n, -1)
                x = np.frombuffer(vectors, np.float64).reshape(n, -1)
                off, middle = np.frombuffer(off, np.float64), np.frombuffer(middle, np.float64)
                kept.append(ids)
                size = float(np.linalg.norm(middle)) + radius
                within = ~(q @ middle + length * radius < limits(np.arange(len(q)), size))
                looking = np.flatnonzero(asked[:, cell] | within)
                for a in range(0, len(looking), QUERY_PART):
                    part = looking[a : a + QUERY_PART]
                    rough = scan(packed, tables_of(q[part], books))
                    near = np.argpartition(-rough, RERANK - 1, axis=1)[:, :RERANK] if n > RERANK else np.broadcast_to(np.arange(n), rough.shape)
                    take(part, near, None, x, ids)
                    if n <= RERANK:
                        continue
                    # the codes are summed in single precision
                    most = rough + length[part][:, None] * (off + 1e-5 * (size + off))
                    left = ~(most < limits(part, size)[:, None]) | ~np.isfinite(rough)
                    np.put_along_axis(left, near, False, 1)
                    some = np.flatnonzero(left.any(0))
                    left = left[:, some] & ~(q[part] @ x[some].T < limits(part, size)[:, None])
                    who = np.flatnonzero(left.any(1))
                    if len(who):
                        left = left[who]
                        rest, ok = np.argsort(~left, 1, kind="stable"), left.sum(1)
                        for c in range(0, int(ok.max()), RERANK):
                            cut = some[rest[:, c : c + RERANK]]
                            take(part[who], cut, np.arange(c, c + cut.shape[1]) < ok[:, None], x, ids)
                at += n
        if not at:
            return
        width = max(z.shape[1] for z in kept)
        names_of = np.concatenate([np.pad(z, ((0, 0), (0, width - z.shape[1])), constant_values=np.iinfo(np.int64).min) for z in kept])
        for a in range(0, len(q), 4096):
            ok = place[a : a + 4096] >= 0
            who = np.repeat(names[a : a + 4096], ok.sum(1))
            vec, val = names_of[place[a : a + 4096][ok]], score[a : a + 4096][ok]
            there = vec != np.iinfo(np.int64).min
            yield pd.DataFrame({"query_id": np.repeat(who, there.sum(1)), "vec_id": vec[there], "score": np.repeat(val, there.sum(1))})

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest inner products found for each query row.

    Rows take no part whose id is null or whose vector is null, zero, holds null or non-finite
    components, or has not the commonest length (of equally common ones the longest). A repeated row counts once, and no
    row of the query's own id is its answer. An id with several vectors is named once, as near as the nearest of them
    to any of the query's. Ties go to the smaller id. Empty tables give no rows.
    """
    clean = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), is_query.alias("asks")).filter(F.col("id").isNotNull() & usable(F.col("v")))
    lengths = clean.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dim = lengths["d"] if lengths else 0
    rows = clean.filter(F.size("v") == dim)
    index, path, model = build_index(rows.select("id", "v").distinct(), dim, k)
    several = rows.select("id", "v").distinct().groupBy("id").count().agg(F.max("count")).first()[0] or 1
    found = search_index(index, model, rows.filter("asks").select("id", "v").distinct(), dim, k, several)
    drop_path(vectors.sparkSession, path)
    return found


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fernlake.runtime import table

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)
