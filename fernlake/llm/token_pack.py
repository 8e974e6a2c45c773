"""Token ids as fixed-width bit-packed blocks.

Every id takes ``width = bit_length(vocabulary - 1)`` bits. 64 ids fill exactly
``width`` little-endian 64-bit words, so id ``i`` lies in the group ``i // 64`` whose
place is a multiplication away: a reader unpacks any range by touching only its
groups, and a whole block with 64 vector operations.

A payload is a header, the documents' token offsets and the groups:

    magic 'FTP1' | width u32 | documents u64 | tokens u64 | offsets u64[documents + 1] | words u64[]

A file set is a table of payloads (one row each) that Spark's writers commit, with
columns ``shard, block, first_token, n_docs, n_tokens, doc_ids, payload``; shards and blocks
ascend with doc_id, and ``first_token`` counts within the shard.
"""

from __future__ import annotations

import gc
import os
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fernlake.llm.chunks import Chunked, gather, slices
from fernlake.llm.memory import Memory
from fernlake.runtime import materialize

MAGIC, HEAD = b"FTP1", struct.Struct("<4sIQQ")
#: Tokens after which a block is closed; a longer document has a block of its own.
BLOCK_TOKENS = 1 << 18
#: Distinct chunks a worker remembers.
CACHE_CHUNKS = 500_000
#: Characters up to which a chunk is remembered.
LONGEST_CHUNK = 64
#: Chunks that go to the library in one call.
LEARN_TOGETHER = 4096


def width_of(vocab_size: int) -> int:
    return max(1, (vocab_size - 1).bit_length())


def pack_bits(ids: np.ndarray, width: int) -> np.ndarray:
    """uint64 words that hold ``ids`` at ``width`` bits each (the last group zero-filled)."""
    if len(ids) and int(ids.max()) >> width:
        raise ValueError(f"an id needs more than {width} bits")
    groups = -(-len(ids) // 64)
    if width in (8, 16, 32):  # the lanes below would only copy
        out = np.zeros(groups * 64, f"<u{width // 8}")
        out[: len(ids)] = ids
        return out.view("<u8")
    full = np.zeros(groups * 64, np.uint64)
    full[: len(ids)] = ids
    lanes = np.ascontiguousarray(full.reshape(groups, 64).T)
    words = np.zeros((width, groups), np.uint64)
    for lane in range(64):
        word, shift = divmod(lane * width, 64)
        words[word] |= lanes[lane] << np.uint64(shift)
        if shift + width > 64:
            words[word + 1] |= lanes[lane] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).reshape(-1)


def unpack_bits(words: np.ndarray, width: int, start: int, count: int) -> np.ndarray:
    """Ids ``start .. start + count`` as uint32; reads only the groups they lie in."""
    if count <= 0:
        return np.zeros(0, np.uint32)
    if width in (8, 16, 32):
        return words.view(f"<u{width // 8}")[start : start + count].astype(np.uint32)
    first, last = start // 64, (start + count - 1) // 64 + 1
    part = np.ascontiguousarray(words[first * width : last * width].reshape(last - first, width).T)
    out, mask = np.empty((64, last - first), np.uint32), np.uint64((1 << width) - 1)
    for lane in range(64):
        word, shift = divmod(lane * width, 64)
        value = part[word] >> np.uint64(shift)
        if shift + width > 64:
            value = value | (part[word + 1] << np.uint64(64 - shift))
        out[lane] = value & mask
    flat = np.ascontiguousarray(out.T).reshape(-1)
    return flat[start - first * 64 : start - first * 64 + count]


def write_block(ids: np.ndarray, sizes: list[int], width: int) -> bytes:
    """A payload of documents' ids end to end, ``sizes`` of them each."""
    offsets = np.zeros(len(sizes) + 1, "<u8")
    offsets[1:] = np.cumsum(sizes)
    return HEAD.pack(MAGIC, width, len(sizes), len(ids)) + offsets.tobytes() + pack_bits(ids, width).astype("<u8").tobytes()


class BlockReader:
    """Random access to one payload: ``reader[i]`` is document i, ``reader.tokens(a, n)`` any range."""

    def __init__(self, payload: bytes):
        magic, self.width, self.n_docs, self.n_tokens = HEAD.unpack_from(payload)
        if magic != MAGIC:
            raise ValueError("not a packed token block")
        self.offsets = np.frombuffer(payload, "<u8", self.n_docs + 1, HEAD.size).astype(np.int64)
        self.words = np.frombuffer(payload, "<u8", -1, HEAD.size + 8 * (self.n_docs + 1))

    def tokens(self, start: int, count: int) -> np.ndarray:
        if start < 0 or start + count > self.n_tokens:
            raise IndexError("range lies outside the block")
        return unpack_bits(self.words, self.width, start, count)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.tokens(int(self.offsets[i]), int(self.offsets[i + 1] - self.offsets[i]))

    def all(self) -> np.ndarray:
        return self.tokens(0, self.n_tokens)


class ChunkEncoder:
    """Columns of texts to ids by the tokenizers library, asked only for what it has not been asked yet.

    Distinct chunks of a batch that are not remembered go to the library many at once, as one text: a
    chunk's first token is the next one that begins with a space.

    Strings of special tokens inside a text are ordinary text, as the description of the vocabulary files
    (their README) sets the library up: data must not be able to forge control tokens. With ``special_text``
    false they become their special ids, as the library does without that switch.
    """

    def __init__(self, path: str, special_text: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_text
        self.control = [] if special_text else [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.spaced = np.zeros(max(vocab.values()) + 1, bool)
        self.spaced[[i for token, i in vocab.items() if token.startswith("\u0120")]] = True  # how byte-level vocabularies write a space
        self.known, self.known_first = Memory(CACHE_CHUNKS, LONGEST_CHUNK), Memory(CACHE_CHUNKS // 10, LONGEST_CHUNK)

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def _learn(self, new: list[str]) -> list[bytes]:
        """Ids of chunks, each with a space before it."""
        ids = np.frombuffer(self.whole(" " + " ".join(new)), np.uint32)
        raw, at = ids.tobytes(), (np.flatnonzero(self.spaced[ids]) * 4).tolist()
        if len(at) != len(new):
            raise RuntimeError("the tokenizer does not cut at lone spaces")
        return [raw[a:b] for a, b in zip(at, [*at[1:], len(raw)])]

    def _spaced_chunks(self, chunks: list[str], used: np.ndarray) -> list[bytes]:
        found = [ids or b"" for ids in map(self.known.get, chunks)]
        plain = [i for i in np.flatnonzero(used).tolist() if not found[i]]
        for part in range(0, len(plain), LEARN_TOGETHER):
            own = plain[part : part + LEARN_TOGETHER]
            for i, ids in zip(own, self._learn([chunks[i] for i in own])):
                found[i] = self.known.keep(chunks[i], ids)
        return found

    def _first_chunks(self, chunks: list[str]) -> list[bytes]:
        found = list(map(self.known_first.get, chunks))
        new = [i for i, ids in enumerate(found) if ids is None]
        for i, got in zip(new, self.tokenizer.encode_batch_fast([chunks[i] for i in new], add_special_tokens=False)):
            found[i] = self.known_first.keep(chunks[i], array("I", got.ids).tobytes())
        return found

    def column(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Each text's ids in turn; null is empty."""
        for part in slices(texts):
            controlled = np.zeros(len(part), bool)  # texts with control strings go to the library whole
            for token in self.control:
                controlled |= pc.fill_null(pc.match_substring(part, token), False).to_numpy(zero_copy_only=False)
            cut = Chunked(pc.if_else(pa.array(controlled), "", part) if controlled.any() else part)
            found = self._spaced_chunks(cut.spaced, cut.used) + self._first_chunks(cut.first)
            pool, length = np.frombuffer(b"".join(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found)) // 4
            for i, (ids, apart) in enumerate(zip(gather(cut, pool, length), cut.apart | controlled)):
                yield np.frombuffer(self.whole(part[i].as_py()), np.uint32) if apart else ids


@lru_cache(maxsize=2)
def encoder(path: str, special_text: bool = True) -> ChunkEncoder:
    made = ChunkEncoder(path, special_text)
    gc.freeze()  # the large memory holds no cycles: spare the collector walking it
    return made


FILE_SCHEMA = "shard int, block int, first_token long, n_docs int, n_tokens long, doc_ids array<long>, payload binary"
FILE_ARROW = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first_token", pa.int64()), ("n_docs", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("payload", pa.binary())])


def write_tokens(docs: DataFrame, tokenizer_path: str, vocab_size: int, end_id: int, partitions: int | None = None, id_col: str = "doc_id", text_col: str = "text", special_text: bool = True) -> tuple[DataFrame, str]:
    """Encode whole texts and write them as packed blocks in ascending id order.

    Null texts count as empty; ``end_id`` follows every document. Null ids come first, rows
    that share an id stand together by a hash of their text, then in the order given; they are
    split over tasks like any others, however many share one. Other columns are ignored. An empty
    table gives an empty file set. Returns the committed file set read back, and its path.

    One range shuffle moves the texts (not the longer ids); a task keeps at most one block.
    """
    width = width_of(vocab_size)

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer_path, special_text).column, np.array([end_id], np.uint32)
        at, block, first = TaskContext.get().partitionId(), 0, 0
        ids: list[int | None] = []
        held: list[np.ndarray] = []
        sizes: list[int] = []
        size = 0

        def row() -> pa.RecordBatch:
            payload = write_block(np.concatenate(held), sizes, width)
            made = {"shard": at, "block": block, "first_token": first, "n_docs": len(ids), "n_tokens": size, "doc_ids": ids, "payload": payload}
            return pa.RecordBatch.from_pylist([made], FILE_ARROW)

        for batch in batches:
            for key, got in zip(batch.column(0).to_pylist(), encode(batch.column(1))):
                ids.append(key)
                held += [got, end]
                sizes.append(len(got) + 1)
                size += len(got) + 1
                if size >= BLOCK_TOKENS:
                    yield row()
                    block, first = block + 1, first + size
                    ids, held, sizes, size = [], [], [], 0
        if ids:
            yield row()

    own = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t"), F.xxhash64(text_col).alias("h"), F.monotonically_increasing_id().alias("at"))
    order = ["k", "h", "at"]
    ranged = own.repartitionByRange(partitions, *order) if partitions else own.repartitionByRange(*order)
    return materialize(ranged.sortWithinPartitions(*order).select("k", "t").mapInArrow(shard, FILE_SCHEMA), "tokens")


def read_tokens(files: DataFrame, of_block: Callable[[np.ndarray, np.ndarray], dict], schema: str) -> DataFrame:
    """``doc_id, start, n_tokens`` and the columns of ``of_block(ids, offsets)``, from the files alone.

    ``start`` counts all tokens before the document; shard bases come from the manifest, which
    has one row a shard and so stays small whatever the corpus holds.
    """
    sizes = files.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    bases = sizes.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                base, first = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                reader = BlockReader(batch.column(3)[i].as_buffer())
                tokens, off = reader.all(), reader.offsets
                made = {"doc_id": batch.column(2)[i].values, "start": pa.array(base + first + off[:-1]), "n_tokens": pa.array(np.diff(off))}
                made |= {name: pa.array(values) for name, values in of_block(tokens, off).items()}
                yield pa.RecordBatch.from_pydict(made)

    return files.join(F.broadcast(bases), "shard").select("base", "first_token", "doc_ids", "payload").mapInArrow(unpack, f"doc_id long, start long, n_tokens long, {schema}")


def crc_of(ids: np.ndarray, offsets: np.ndarray) -> dict:
    """Unsigned crc32 of each document's ids as little-endian 32-bit integers."""
    raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
    edge = (offsets * 4).tolist()
    return {"ids_crc32": [zlib.crc32(raw[a:b]) for a, b in zip(edge, edge[1:])]}


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` encoded, packed, written and read back: one row a document."""
    import public_tokenizers

    from fernlake.runtime import table

    files, _ = write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 50_257, 0)
    return read_tokens(files, crc_of, "ids_crc32 long")
