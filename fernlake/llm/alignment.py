"""Alignment of two tokenizers' tokens by byte offsets, and how often their ids are linked corpus-wide.

The byte ends of both token sequences of a text are cumulative sums; where a token of each ends, the
text is cut into groups (``intersect1d`` of the ends, ``searchsorted`` for each token's group). Two tokens
are linked if their byte ranges overlap: the tokens of the other side that one overlaps stand in a row,
so links are that row's first place and length, expanded by ``repeat``.

Both tokenizers cut before a lone space between two other characters, so a chunk of a text up to the next
such space is aligned by itself, and chunks repeat: a batch's distinct ones that are not remembered are
encoded and aligned together, as one run of bytes. Texts with other white space beside a space are aligned whole.

How often two ids are linked is counted in three steps: a task adds up its own texts' links, then come two
shuffles, the first with a salt, so that no pair however frequent, nor a task that meets many, makes a heavy task.
Most links hold one of few pairs. Pairs with a count from some bound on are broadcast, the bound being
the least for which they are no more than ``HOT``; links of rarer pairs are joined, and no rare pair is a hot key.
"""

from __future__ import annotations

import gc
import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernlake.llm.chunks import Chunked, slices
from fernlake.runtime import materialize

#: Pairs that are broadcast with their counts, at most.
HOT = 1 << 20
#: Parts that the first of the two shuffles splits a pair into.
SALTS = 16
#: Distinct chunks a worker remembers, and eight times as many links.
CACHE_CHUNKS = 300_000
#: Chunks that are encoded and aligned in one go, and links a task adds up in one go.
TOGETHER, LINKS = 4096, 1 << 21


def links_of(a_bytes: np.ndarray, b_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Groups of both sides' tokens and all links, from the tokens' lengths in bytes over one text.

    Returns ``group_a, group_b, first, width``: A token i is linked with B tokens ``first[i] .. first[i] + width[i]``.
    """
    a_end, b_end = np.cumsum(a_bytes), np.cumsum(b_bytes)
    cuts = np.intersect1d(a_end, b_end, assume_unique=True)
    first = np.searchsorted(b_end, a_end - a_bytes, side="right")
    last = np.searchsorted(b_end, a_end, side="left")
    return np.searchsorted(cuts, a_end), np.searchsorted(cuts, b_end), first, last - first + 1


def expand(first: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links themselves: places of A and of B tokens."""
    upto = np.cumsum(width)
    total = int(upto[-1]) if len(upto) else 0
    return np.repeat(np.arange(len(width)), width), np.repeat(first - (upto - width), width) + np.arange(total)


def byte_lengths(parts: list[bytes]) -> np.ndarray:
    return np.fromiter(map(len, parts), np.int64, len(parts))


def level_bytes() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Store:
    """What chunks come to, in arrays: ``tell`` (fits, tokens of A, of B, groups), codes of their links end to end, groups as text.

    Row 0 is nothing. It is bounded: a batch that finds it full starts it anew.
    """

    def __init__(self, code: str):
        self.code = code
        self.forget()

    def forget(self) -> None:
        self.row_of: dict[str, int] = {}
        self.tell, self.start, self.length = np.zeros((1024, 4), np.int64), np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.pool, self.rows, self.links, self.texts = np.zeros(4096, self.code), 0, 0, []
        self.add(np.array([[1, 0, 0, 0]]), np.zeros(1, np.int64), np.zeros(0, self.code), [b""])

    def add(self, tell: np.ndarray, length: np.ndarray, codes: np.ndarray, texts: list[bytes]) -> int:
        """The first of the new rows."""
        first, upto, links = self.rows, self.rows + len(tell), self.links + len(codes)
        while upto > len(self.tell):
            self.tell, self.start, self.length = np.concatenate([self.tell] * 2), np.concatenate([self.start] * 2), np.concatenate([self.length] * 2)
        while links > len(self.pool):
            self.pool = np.concatenate([self.pool] * 2)
        self.tell[first:upto], self.length[first:upto], self.start[first:upto] = tell, length, self.links + np.cumsum(length) - length
        self.pool[self.links : links] = codes
        self.texts += texts
        self.rows, self.links = upto, links
        return first

    @property
    def full(self) -> bool:
        return self.rows > CACHE_CHUNKS or self.links > 8 * CACHE_CHUNKS


class Aligner:
    """Aligns a byte-level BPE of the tokenizers library (A) with a sentencepiece model (B)."""

    def __init__(self, level_path: str, piece_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(level_path)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        vocab, of = self.a.get_vocab(with_added_tokens=True), level_bytes()
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_length, self.b_length = byte_lengths(self.a_bytes), byte_lengths(self.b_bytes)
        # a token as text inside its side of a group, and as the last one there
        names = [[f"{i}{end}".encode() for i in range(len(side))] for side, last in ((self.a_bytes, b"|"), (self.b_bytes, b";")) for end in (",", last.decode())]
        self.names = [np.array(x, object) for x in names]
        self.digits = [byte_lengths(x) for x in names]
        self.a_spaced, self.b_spaced = (np.array([x[:1] == b" " for x in side]) for side in (self.a_bytes, self.b_bytes))
        self.store = Store(self.code)

    @property
    def code(self) -> str:
        """The type of a pair's code."""
        return "<i4" if len(self.a_bytes) * len(self.b_bytes) < 1 << 31 else "<i8"

    def _groups(self, sides: list[tuple[np.ndarray, np.ndarray]]) -> tuple[bytes, np.ndarray]:
        """All groups, each as ``a1,a2|b1;``, and the lengths of all groups up to each."""
        (a, of_a), (b, of_b) = sides
        held = np.bincount(of_a), np.bincount(of_b)
        before = np.cumsum(held[1]) - held[1], np.cumsum(held[0])  # tokens of the other side that stand before a group's own
        out, size = np.empty(len(a) + len(b), object), np.zeros(len(held[0]), np.int64)
        for side, (ids, of) in enumerate(sides):
            last = np.append(of[1:] != of[:-1], True)
            out[np.arange(len(ids)) + before[side][of]] = np.where(last, self.names[2 * side + 1][ids], self.names[2 * side][ids])
            size += np.bincount(of, self.digits[2 * side][ids]).astype(np.int64)
        return b"".join(out.tolist()), np.cumsum(size)

    def _align(self, a: np.ndarray, b: np.ndarray, count_a: np.ndarray, count_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """Of texts laid end to end, each end being a cut of both sides: counts, links of each, codes of all links, groups of each."""
        group_a, group_b, first, width = links_of(self.a_length[a], self.b_length[b])
        at_a, at_b = expand(first, width)
        end = np.cumsum(count_a) - 1
        last = group_a[end]
        text, upto = self._groups([(a, group_a), (b, group_b)])
        ends = upto[last].tolist()
        texts = [text[x : y - 1] for x, y in zip([0, *ends], ends)]
        tell = np.stack([np.ones(len(end), np.int64), count_a, count_b, np.diff(last, prepend=-1)], 1)
        return tell, np.diff(np.cumsum(width)[end], prepend=0), (a[at_a] * len(self.b_bytes) + b[at_b]).astype(self.code), texts

    def _spelled(self, ids: list[np.ndarray]) -> list[bytes]:
        return [b"".join(map(side.__getitem__, own.tolist())) for side, own in zip((self.a_bytes, self.b_bytes), ids)]

    def one(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """The same of a text with a space before it; a row of zeros where the bytes of a side are not the text's."""
        ids = [np.array(x, np.int64) for x in (self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, self.b.encode(text))]
        if {b" " + text.encode()} != {*self._spelled(ids)}:
            return np.zeros((1, 4), np.int64), np.zeros(1, np.int64), np.zeros(0, self.code), [b""]
        return self._align(*ids, *(np.array([len(x)]) for x in ids))

    def _learn(self, chunks: list[str]) -> None:
        """Chunks without white space at their ends: as one text of both sides, where a token that begins with a space begins a chunk."""
        whole = " ".join(chunks)
        ids = [np.array(x, np.int64) for x in (self.a.encode_batch_fast([" " + whole], add_special_tokens=False)[0].ids, self.b.encode(whole))]
        starts = [np.flatnonzero(spaced[own]) for spaced, own in zip((self.a_spaced, self.b_spaced), ids)]
        if {len(chunks)} == {*map(len, starts)} and {b" " + whole.encode()} == {*self._spelled(ids)}:
            found = [self._align(*ids, *(np.diff(at, append=len(own)) for at, own in zip(starts, ids)))]
        else:
            found = map(self.one, chunks)
        at = 0
        for got in found:
            first = self.store.add(*got)
            self.store.row_of.update(zip(chunks[at : at + len(got[0])], range(first, self.store.rows)))
            at += len(got[0])

    def _rows_of(self, chunks: list[str], used: np.ndarray) -> np.ndarray:
        """Rows of the store."""
        if self.store.full:
            self.store.forget()
        row_of = self.store.row_of
        new = [i for i in np.flatnonzero(used).tolist() if chunks[i] not in row_of]
        for low in range(0, len(new), TOGETHER):
            self._learn([chunks[i] for i in new[low : low + TOGETHER]])
        return np.fromiter((row_of.get(c, 0) for c in chunks), np.int64, len(chunks))

    def column(self, texts: pa.Array) -> Iterator[tuple[int, int, int, np.ndarray, str]]:
        """``n_a, n_b, n_groups, codes of all links, hash of the groups`` of each text."""
        none = np.zeros(0, self.code)
        for part in slices(texts):
            part = pc.fill_null(part, "")
            cut = Chunked(pc.binary_join_element_wise(pa.scalar(" ", part.type), part, pa.scalar("", part.type)))
            store, row_of = self.store, np.append(self._rows_of(cut.spaced, cut.used), 0)  # nothing stands before the first space
            cut.codes[cut.edge[:-1]] = len(cut.spaced)
            empty = pc.equal(pc.binary_length(part), 0).to_numpy(zero_copy_only=False)
            own = row_of[cut.codes]
            tell = np.add.reduceat(store.tell[own], cut.edge[:-1], axis=0) if len(part) else np.zeros((0, 4))
            fits, sizes = tell[:, 0] == np.diff(cut.edge), tell[:, 1:].tolist()
            for i, (low, high) in enumerate(zip(cut.edge[:-1].tolist(), cut.edge[1:].tolist())):
                if empty[i] or not (cut.apart[i] or fits[i]):
                    yield 0, 0, 0, none, ""
                    continue
                if cut.apart[i]:
                    one, _, codes, (text,) = self.one(part[i].as_py())
                    fit, *size = one[0].tolist()
                    yield *size, codes, hashlib.sha256(text).hexdigest() if fit else ""
                    continue
                rows = own[low + 1 : high]
                length = store.length[rows]
                upto = np.cumsum(length)
                codes = store.pool[np.repeat(store.start[rows] - upto + length, length) + np.arange(upto[-1])]
                yield *sizes[i], codes, hashlib.sha256(b";".join(map(store.texts.__getitem__, rows.tolist()))).hexdigest()


@lru_cache(maxsize=2)
def aligner(level_path: str, piece_path: str) -> Aligner:
    made = Aligner(level_path, piece_path)
    gc.freeze()
    return made


def _lists(arrays: list[np.ndarray], kind: str) -> pa.ListArray:
    edge = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(edge), pa.array(np.concatenate(arrays).astype(kind) if arrays else np.zeros(0, kind)))


def alignments(docs: DataFrame, level_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times``: each whole text's counts, and its distinct pairs of linked ids with how often.

    A text that is null, empty or not what its tokens' bytes come to (with a space before it) has no tokens.
    """
    code = aligner(level_path, piece_path).code
    kind = {"<i4": "int", "<i8": "long"}[code]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = aligner(level_path, piece_path)
        for batch in batches:
            got, pairs, times, low, held = [], [], [], 0, 0

            def rows() -> pa.RecordBatch:
                counts = [pa.array([x[c] for x in got], pa.int64()) for c in range(4)]
                columns = [batch.column(0).slice(low, len(got)), *counts, pa.array([x[4] for x in got], pa.string()), _lists(pairs, code), _lists(times, "<i4")]
                return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

            for n_a, n_b, groups, codes, digest in of.column(batch.column(1)):
                different, often = np.unique(codes, return_counts=True)
                got.append((n_a, n_b, groups, len(codes), digest))
                pairs.append(different)
                times.append(often)
                held += len(different)
                if held >= LINKS:
                    yield rows()
                    low += len(got)
                    got, pairs, times, held = [], [], [], 0
            yield rows()

    schema = f"doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<{kind}>, times array<int>"
    return docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t")).mapInArrow(run, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair, n``: how many links corpus-wide hold the pair, by a task's own sums and a salted and a plain shuffle."""
    kind = aligned.schema["pairs"].dataType.elementType.simpleString()
    code = {"int": "<i4", "bigint": "<i8"}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = TaskContext.get().partitionId() % SALTS
        pairs, times, held = [], [], 0

        def summed() -> pa.RecordBatch:
            key, at = np.unique(np.concatenate(pairs), return_inverse=True)
            n = np.bincount(at, np.concatenate(times), len(key)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(key.astype(code)), pa.array(np.full(len(key), salt, np.int32)), pa.array(n)], ["pair", "salt", "n"])

        for batch in batches:
            pairs.append(batch.column(0).flatten().to_numpy())
            times.append(batch.column(1).flatten().to_numpy())
            held += len(pairs[-1])
            if held >= LINKS:
                yield summed()
                pairs, times, held = [], [], 0
        if held:
            yield summed()

    own = aligned.select("pairs", "times").mapInArrow(run, f"pair {kind}, salt int, n long")
    return own.groupBy("pair", "salt").agg(F.sum("n").alias("n")).groupBy("pair").agg(F.sum("n").alias("n"))


def _frequent(counts: DataFrame, most: int) -> tuple[DataFrame, int, int]:
    """Pairs from the least count on for which they are at most ``most``, that count, and how many pairs lie below it.

    Counts are told apart to an eighth of their power of two, so no more than a few hundred rows reach the driver.
    """
    power = F.floor(F.log2(F.col("n").cast("double"))).cast("int")
    eighth = F.floor(F.col("n") * 8 / F.pow(F.lit(2.0), power)).cast("int")  # 8 to 15
    steps = counts.groupBy(power.alias("power"), eighth.alias("eighth")).agg(F.count("*").alias("pairs"), F.min("n").alias("least")).collect()
    taken, bound, rare = 0, 1 << 62, 0
    for step in sorted(steps, key=lambda s: -s["least"]):
        if rare or taken + step["pairs"] > most:
            rare += step["pairs"]
        else:
            taken, bound = taken + step["pairs"], step["least"]
    return counts.filter(F.col("n") >= bound), bound, rare


def with_counts(aligned: DataFrame, pieces: int, hot: int = HOT) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of ``aligned``, a written table.

    ``pieces``: how many ids B has, which also bounds the broadcast of each B id's highest count.
    """
    spark = aligned.sparkSession
    kind = aligned.schema["pairs"].dataType.elementType.simpleString()
    counts, _ = materialize(pair_counts(aligned), "pair-counts")
    highest = counts.groupBy((F.col("pair") % pieces).cast("int").alias("b")).agg(F.max("n").alias("n")).toArrow()
    best = np.zeros(pieces, np.int64)
    best[highest.column("b").to_numpy()] = highest.column("n").to_numpy()
    frequent, bound, rare = _frequent(counts, hot)
    known = frequent.toArrow()
    order = np.argsort(key := known.column("pair").to_numpy())
    sent = spark.sparkContext.broadcast((key[order], known.column("n").to_numpy()[order], best))

    def looked_up(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of all rows, their places among the broadcast ones, and whether they are there."""
        pairs, keys = column.flatten().to_numpy(), sent.value[0]
        at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
        return pairs, at, keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)

    plain = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, at, there = looked_up(batch.column("pairs"))
            times = batch.column("times").flatten().to_numpy().astype(np.int64)
            n = np.where(there, sent.value[1][at] if len(sent.value[1]) else 0, 0)
            edge = batch.column("pairs").offsets.to_numpy().astype(np.int64)
            upto = lambda x: np.concatenate([[0], np.cumsum(x)])[edge - edge[0]]
            sums = [np.diff(upto(np.where(there & (n == sent.value[2][pairs % pieces]), times, 0))), np.diff(upto(n * times))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in plain), *map(pa.array, sums)], [*plain, "n_best", "count_sum"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, _, there = looked_up(batch.column("pairs"))
            row = np.repeat(batch.column("row").to_numpy(), np.diff(batch.column("pairs").offsets.to_numpy()))
            times = batch.column("times").flatten().to_numpy()
            high = sent.value[2][pairs % pieces]
            yield pa.RecordBatch.from_arrays([pa.array(x[~there]) for x in (row, pairs, times, high)], ["row", "pair", "times", "high"])

    numbered = aligned.withColumn("row", F.monotonically_increasing_id())  # of a written table, so the same each time
    scored = numbered.mapInArrow(score, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")
    if rare:
        asked = numbered.select("row", "pairs", "times").mapInArrow(others, f"row long, pair {kind}, times int, high long")
        met = asked.join(counts.filter(F.col("n") < bound), "pair")
        sums = met.groupBy("row").agg(F.sum(F.when(F.col("n") == F.col("high"), F.col("times")).otherwise(0)).alias("b"), F.sum(F.col("n") * F.col("times")).alias("s"))
        scored = scored.join(sums, "row", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("b", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("s", F.lit(0))})
    return scored.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def align_documents(docs: DataFrame, level_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """One row for every row of ``docs``: tokens of both sides, groups, links, and the corpus-wide counts of the pairs that links hold.

    ``n_best`` are links whose pair is as frequent as any of its B id, ``count_sum`` adds up the counts of all links'
    pairs. Null and empty texts, and texts that either side does not give back byte for byte, have zeros and an empty
    hash, and count nowhere. Repeated rows and ids count each time; null ids stay null; other columns are ignored;
    an empty table gives no rows. Very long texts are aligned whole, in one task.
    """
    aligned, _ = materialize(alignments(docs, level_path, piece_path, id_col, text_col), "aligned")
    return with_counts(aligned, len(aligner(level_path, piece_path).b_bytes), hot)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from fernlake.runtime import table

    return align_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
