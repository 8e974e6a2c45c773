"""Byte-level BPE by dynamic programming over prefixes.

For a piece of text and each of its byte prefixes there is exactly one token that a
merge-by-rank encoder leaves last. Token ``t`` ending at byte ``j`` is that token if it
may follow the last token of the prefix before it, that is, if merging the two tokens' bytes
from scratch gives back the two. So the table from prefixes to last tokens is filled left to
right, appending extends it without changing earlier entries, and an edit re-encodes only from
the edit to where the table runs on as before.

Pieces of up to ``SHARED`` bytes share one table of a bounded size, keyed by their prefixes. A longer piece
has a table of its own, an array with one token a byte, so memory is linear in its length; the tokens that
end at a byte come from an automaton over the vocabulary.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from array import array
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernlake.llm.chunks import Chunked, gather, slices
from fernlake.llm.memory import Memory

#: Distinct chunks a worker remembers; the other memories follow it. Three times as many take some 100 MB more and a third less time.
REMEMBER = 120_000
#: Rows of ids that leave in one Arrow batch.
OUT_ROWS = 1000
#: Texts whose distinct chunks and ids are held at once while ids are made: 2,000 take a worker some 50 MB more, and hardly less time.
ENCODE_TOGETHER = 250
#: Bytes up to which a piece's prefixes are entered in the shared table, and characters up to which pieces and chunks are remembered.
SHARED = 64


def _numbers(decimal: str) -> np.ndarray:
    return np.fromstring(decimal, np.int32, sep=" ") if decimal else np.zeros(0, np.int32)


class PrefixBPE:
    """Encoder and decoder over ``ranks`` (bytes -> rank), pieces cut by ``pattern``."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remember: int = REMEMBER):
        import regex

        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self.cut = regex.compile(pattern).findall
        self.length = {rank: len(token) for token, rank in ranks.items()}
        self._decimal = {rank: str(rank) for rank in ranks.values()}
        self._pairs: dict[int, bool] = {}
        #: Prefix of a short piece -> its last token.
        self.table: dict[bytes, int] = {}
        self._pieces, self._chunks = Memory(remember * 2 // 3, SHARED), Memory(remember, SHARED)
        #: Most prefixes (of ``SHARED`` bytes at most) and pairs of tokens; beyond them a memory starts anew.
        self.most = remember * 5 // 3

    @cached_property
    def automaton(self):
        """Finds the tokens that end at each byte; made when a long piece first needs it."""
        import ahocorasick

        made = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            made.add_word(token.decode("latin-1"), (rank, len(token)))
        made.make_automaton()
        return made

    def _merged(self, piece: bytes) -> list[bytes]:
        """Merging by rank from single bytes; used on pairs of tokens only."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        get = self.ranks.get
        while len(parts) > 1:
            pairs = [get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
            low = min(pairs)
            if low == 1 << 60:
                break
            i = pairs.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def follows(self, left: int, right: int) -> bool:
        """Whether an encoder ever leaves token ``right`` next to token ``left``."""
        key = left << 32 | right
        found = self._pairs.get(key)
        if found is None:
            if len(self._pairs) > self.most:
                self._pairs.clear()
            a, b = self.bytes_of[left], self.bytes_of[right]
            found = self._pairs[key] = self._merged(a + b) == [a, b]
        return found

    def extend(self, data: bytes) -> None:
        """Enter ``data`` and its prefixes in the table, going on from the longest that is there.

        Pieces that begin alike share their prefixes' entries.
        """
        table, rank_of, pairs, longest = self.table, self.ranks.get, self._pairs, self.longest
        end = len(data)
        while end and data[:end] not in table:
            end -= 1
        while end < len(data):
            end += 1
            prefix = data[:end]
            last = rank_of(prefix)
            if last is None:
                for start in range(max(1, end - longest), end):
                    last = rank_of(prefix[start:])
                    if last is not None:
                        left = table[prefix[:start]]
                        fits = pairs.get(left << 32 | last)
                        if self.follows(left, last) if fits is None else fits:
                            break
                else:
                    raise ValueError("the ranks lack a single byte")
            table[prefix] = last

    def path(self, data: bytes) -> list[int]:
        """The tokens of ``data``, read off the table from its end."""
        out, table, length = [], self.table, self.length
        while data:
            token = table[data]
            out.append(token)
            data = data[: -length[token]]
        out.reverse()
        return out

    def encode_piece(self, data: bytes) -> list[int]:
        """Also after an edit: only prefixes that were not there before are worked out."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        if len(data) > SHARED:
            return Prefixes(self, data).tokens()
        if len(self.table) > self.most:
            self.table.clear()
        self.extend(data)
        return self.path(data)

    def _ids(self, text: str) -> str:
        """Decimal ids of a text, piece by piece."""
        pieces, out = self._pieces, []
        for piece in self.cut(text):
            ids = pieces.get(piece)
            if ids is None:
                ids = pieces.keep(piece, " ".join(map(self._decimal.__getitem__, self.encode_piece(piece.encode("utf-8", "surrogatepass")))))
            out.append(ids)
        return " ".join(out)

    def encode_text(self, text: str) -> str:
        """Decimal ids joined by one space."""
        return self._ids(text)

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self._ids(text).split()]

    def chunk_ids(self, cut: Chunked) -> list[str]:
        """Decimal ids of a batch's distinct chunks, by code; of those that only begin texts also with a space: none."""
        known = self._chunks
        found = [ids or "" for ids in map(known.get, cut.spaced)]
        for i in np.flatnonzero(cut.used).tolist():
            if not found[i]:
                found[i] = known.keep(cut.spaced[i], self._ids(" " + cut.spaced[i]))
        return found + [self._ids(c) for c in cut.first]

    def column_digests(self, texts: pa.Array) -> Iterator[tuple[int, str, str]]:
        """Of each text the number of ids, and digests of the ids and of what they decode to."""
        for part in slices(texts):
            yield from self._slice_digests(Chunked(part))

    def _slice_digests(self, cut: Chunked) -> Iterator[tuple[int, str, str]]:
        sha = hashlib.sha256
        found = self.chunk_ids(cut)
        decoded = [self.decode(map(int, ids.split())) for ids in found]
        for i, (codes, apart) in enumerate(zip(cut.rows(), cut.apart)):
            if apart:
                joined = self._ids(cut.whole(i))
                back = self.decode(map(int, joined.split()))
            else:
                own = codes.tolist()
                parts = list(map(found.__getitem__, own))
                joined = " ".join(parts if parts[0] else parts[1:])
                back = b"".join(map(decoded.__getitem__, own))
            raw = joined.encode()
            yield (raw.count(b" ") + 1 if raw else 0), sha(raw).hexdigest(), sha(back).hexdigest()

    def column_ids(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Each text's ids."""
        for part in slices(texts, ENCODE_TOGETHER):
            yield from self._slice_ids(Chunked(part))

    def _slice_ids(self, cut: Chunked) -> Iterator[np.ndarray]:
        found = self.chunk_ids(cut)
        length = np.array([ids.count(" ") + 1 if ids else 0 for ids in found])
        pool = _numbers(" ".join(filter(None, found)))
        for i, (ids, apart) in enumerate(zip(gather(cut, pool, length), cut.apart)):
            yield _numbers(self._ids(cut.whole(i))) if apart else ids

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class Prefixes:
    """One piece and the last token of each of its prefixes, an array as long as the piece."""

    def __init__(self, bpe: PrefixBPE, data: bytes = b""):
        self.bpe, self.data, self.last = bpe, bytearray(), array("i")
        self.append(data)

    def _extend(self, before: array | None = None, shift: int = 0) -> None:
        """Fill the table up to the end of the data.

        ``before`` is an earlier table whose entry ``j - shift`` told of the same bytes from here on: once as
        many entries as the longest token has bytes are the same again, so is all that follows.
        """
        bpe, last, follows = self.bpe, self.last, self.bpe.follows
        pairs = bpe._pairs
        low, alike = max(0, len(last) - bpe.longest), 0
        for at, (token, length) in bpe.automaton.iter(self.data[low:].decode("latin-1")):
            end, start = low + at, low + at + 1 - length
            if end != len(last):
                if end > len(last):
                    break
                continue
            if start:
                left = last[start - 1]
                fits = pairs.get(left << 32 | token)
                if not (follows(left, token) if fits is None else fits):
                    continue
            last.append(token)
            if before is not None:
                alike = alike + 1 if before[end - shift] == token else 0
                if alike == bpe.longest:
                    last.extend(before[end + 1 - shift :])
                    break
        if len(last) < len(self.data):
            raise ValueError("the ranks lack a single byte")

    def append(self, more: bytes) -> None:
        self.data += more
        self._extend()

    def replace(self, at: int, removed: int, added: bytes) -> None:
        """Put ``added`` in the place of ``removed`` bytes from ``at`` on."""
        if not 0 <= at <= at + removed <= len(self.data):
            raise IndexError("the edit lies outside the piece")
        before, shift = self.last, len(added) - removed
        self.last, self.data[at : at + removed] = before[:at], added
        if added:
            whole, self.data = self.data, self.data[: at + len(added)]
            self._extend()
            self.data = whole
        self._extend(before, shift)

    def tokens(self) -> list[int]:
        out, end, length = [], len(self.data), self.bpe.length
        while end:
            out.append(self.last[end - 1])
            end -= length[out[-1]]
        out.reverse()
        return out


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def codec(path: str, pattern: str, remember: int = REMEMBER) -> PrefixBPE:
    made = PrefixBPE(load_ranks(path), pattern, remember)
    gc.freeze()  # the large tables hold no cycles: spare the collector walking them
    return made


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids array<int>`` of every whole text; null texts count as empty, rows repeat as given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(ranks_path, pattern)
        for batch in batches:
            ids: list[np.ndarray] = []
            low = 0
            for i, got in enumerate(bpe.column_ids(batch.column(1)), 1):
                ids.append(got)
                if i % OUT_ROWS == 0 or i == batch.num_rows:
                    edge = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                    held = pa.ListArray.from_arrays(pa.array(edge), pa.array(np.concatenate(ids), pa.int32()))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, len(ids)), held], ["doc_id", "ids"])
                    low, ids = i, []
            pa.default_memory_pool().release_unused()

    return docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``doc_id, text`` from ``ids``; bytes that are not UTF-8 become U+FFFD, null ids give a null text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = codec(ranks_path, pattern)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": [None if i is None else bpe.decode(map(int, i)).decode("utf-8", "replace") for i in batch["ids"]]})

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, text string")


def digest_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", remember: int = REMEMBER) -> DataFrame:
    """Encode, decode and digest every whole text in one narrow pass (no shuffle).

    Null texts count as empty; null ids, repeated rows and further columns do no harm.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(ranks_path, pattern, remember)
        for batch in batches:
            made = list(zip(*bpe.column_digests(batch.column(1)))) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made[0], pa.int64()), pa.array(made[1], pa.string()), pa.array(made[2], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from fernlake.runtime import table

    return digest_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, remember=3 * REMEMBER)
