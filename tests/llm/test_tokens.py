import base64
import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fernlake.llm import byte_bpe, token_pack

RANKS, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, shard int"


def odd_texts(n=1500, seed=1):
    rng = random.Random(seed)
    bits = ["a", "the", "ing", "1", "é", " ", " ", "\n", "  ", "中", "😀", "'s", "\x00", "—", "aaaa", "\t", "\x1c", "\x85", "\u200b", "<|endoftext|>", "Ġ"]
    return ["", " ", "a", " a", "a ", None, *("".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(n))]


@pytest.fixture(scope="module")
def library():
    made = Tokenizer.from_file(JSON)
    made.encode_special_tokens = True
    return made


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.load_ranks(RANKS)


@pytest.fixture(scope="module")
def tik(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("width", [1, 5, 8, 16, 17, 31, 32])
def test_bits_come_back(width):
    for n in (0, 1, 63, 64, 65, 1001):
        ids = np.random.default_rng(n).integers(0, 1 << width, n, dtype=np.uint64)
        words = token_pack.pack_bits(ids, width)
        assert (token_pack.unpack_bits(words, width, 0, n) == ids).all()
        if n > 100:
            assert (token_pack.unpack_bits(words, width, 77, 20) == ids[77:97]).all()
    with pytest.raises(ValueError):
        token_pack.pack_bits(np.array([1 << width], np.uint64), width)


def test_blocks_have_random_access():
    docs = [np.arange(n, dtype=np.uint32) for n in (0, 3, 200)]
    reader = token_pack.BlockReader(token_pack.write_block(np.concatenate(docs), [len(d) for d in docs], token_pack.width_of(50_257)))
    assert reader.width == 16 and all((reader[i] == d).all() for i, d in enumerate(docs))
    assert reader.tokens(3, 5).tolist() == [0, 1, 2, 3, 4]
    with pytest.raises(IndexError):
        reader.tokens(200, 5)
    with pytest.raises(ValueError):
        token_pack.BlockReader(b"XXXX" + bytes(20))


@pytest.mark.parametrize("special_text", [True, False])
def test_column_encoding_equals_the_library(special_text):
    texts = odd_texts() + ["<|endoftext|>", "a <|endoftext|> b", "foo<|endoftext|>bar baz", "<|endoftext|> <|endoftext|"]
    library = Tokenizer.from_file(JSON)
    library.encode_special_tokens = special_text
    got = list(token_pack.encoder(JSON, special_text).column(pa.array(texts)))
    assert [g.tolist() for g in got] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert (got[-4].tolist() == [50256]) != special_text


def test_files_read_back(spark, library):
    texts = odd_texts(200)
    rows = [(i * 3 - 50, t, 1) for i, t in enumerate(texts)] + [(7 * 10**12, "x " * 20_000, 1)]
    files, _ = token_pack.write_tokens(spark.createDataFrame(rows, SCHEMA).repartition(5), JSON, 50_257, 0, 3)
    got = token_pack.read_tokens(files, token_pack.crc_of, "ids_crc32 long").orderBy("doc_id").collect()
    start = 0
    for (key, text, _), r in zip(rows, got, strict=True):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (key, start, len(ids))
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_files_of_ties_nulls_and_nothing(spark):
    rows = [(5, "b", 0), (5, "a", 0), (None, "c", 0), (5, None, 0)]
    files, _ = token_pack.write_tokens(spark.createDataFrame(rows, SCHEMA), JSON, 50_257, 0)
    got = token_pack.read_tokens(files, token_pack.crc_of, "ids_crc32 long").orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 5, 5, 5] and sorted(r["n_tokens"] for r in got[1:]) == [1, 2, 2]
    assert [r["start"] for r in got] == [sum(r["n_tokens"] for r in got[:i]) for i in range(4)]
    empty, _ = token_pack.write_tokens(spark.createDataFrame([], SCHEMA), JSON, 50_257, 0)
    assert token_pack.read_tokens(empty, token_pack.crc_of, "ids_crc32 long").count() == 0


def test_one_id_is_split_over_tasks(spark):
    rows = [(None if i % 3 else 7, f"text {i // 6}", 0) for i in range(600)]
    files, _ = token_pack.write_tokens(spark.createDataFrame(rows, SCHEMA).repartition(3), JSON, 50_257, 0, 4)
    assert files.select("shard").distinct().count() == 4
    got = token_pack.read_tokens(files, token_pack.crc_of, "ids_crc32 long").orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None] * 400 + [7] * 200


def test_pack_query(spark, data, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    start = 0
    for r in token_pack.query(spark, data).orderBy("doc_id").collect():
        ids = [*library.encode(texts.pop(r["doc_id"]) or "", add_special_tokens=False).ids, 0]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert not texts


def test_prefix_encoding_equals_tiktoken(tik, ranks):
    bpe = byte_bpe.PrefixBPE(ranks, public_tokenizers.PATTERN)
    texts = odd_texts()
    for text, ids, digest in zip(texts, bpe.column_ids(pa.array(texts)), bpe.column_digests(pa.array(texts)), strict=True):
        want = tik.encode_ordinary(text or "")
        assert ids.tolist() == bpe.encode(text or "") == want
        assert bpe.decode(want) == (text or "").encode()
        assert digest == (len(want), hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())


def test_appending_and_editing_keep_earlier_entries(ranks, tik):
    bpe = byte_bpe.PrefixBPE(ranks, public_tokenizers.PATTERN)
    bpe.extend(b"thinoringness")
    before = dict(bpe.table)
    bpe.extend(b"thinoringnesses")
    assert {k: bpe.table[k] for k in before} == before
    assert bpe.path(b"thinoringnesses") == tik.encode_ordinary("thinoringnesses")
    assert bpe.encode_piece(b"thinXringness") == tik.encode_ordinary("thinXringness")
    long = b"ab" * 4000
    assert bpe.decode(bpe.encode_piece(long)) == long


LETTERS = "abcdefghijklmnopqrstuvwxyz"


@pytest.mark.parametrize("alphabet", [LETTERS, "ab", "a", "-=", "".join(chr(0x4E00 + 7 * i) for i in range(900)), LETTERS + LETTERS.upper() + "+/"])
def test_long_pieces_take_linear_memory(tik, ranks, alphabet):
    rng = random.Random(3)
    bpe = byte_bpe.PrefixBPE(ranks, public_tokenizers.PATTERN, 1000)
    assert bpe.encode("x") and bpe.automaton  # what does not depend on the text
    sizes = []
    for n in (5_000, 20_000):
        text = "".join(rng.choice(alphabet) for _ in range(n))
        tracemalloc.start()
        got = bpe.encode(text)
        sizes.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert got == tik.encode_ordinary(text)
    assert sizes[1] < 8 * sizes[0] + 2**20 and sizes[1] < 300 * len(text.encode())
    assert max(map(len, bpe.table), default=0) <= byte_bpe.SHARED


def test_a_piece_of_a_quarter_megabyte(tik, ranks):
    text = base64.b64encode(random.Random(4).randbytes(3 << 16)).decode().translate(str.maketrans("0123456789+/=", "abcdefghijklm"))
    assert byte_bpe.PrefixBPE(ranks, public_tokenizers.PATTERN).encode(text) == tik.encode_ordinary(text)


def test_edits_of_long_pieces_equal_encoding_anew(ranks):
    rng, bpe = random.Random(5), byte_bpe.PrefixBPE(ranks, public_tokenizers.PATTERN)
    some = lambda n: bytes(rng.choice(b"abcdein -") for _ in range(n))
    for _ in range(80):
        data = some(rng.randint(0, 700))
        made = byte_bpe.Prefixes(bpe, data)
        at = rng.randint(0, len(data))
        gone, added = rng.randint(0, min(6, len(data) - at)), some(rng.randint(0, 6))
        made.replace(at, gone, added)
        made.append(b"xyz")
        anew = byte_bpe.Prefixes(bpe, data[:at] + added + data[at + gone :] + b"xyz")
        assert made.data == anew.data and made.last == anew.last and made.tokens() == anew.tokens()
        assert bpe.decode(made.tokens()) == bytes(made.data)
    with pytest.raises(IndexError):
        made.replace(len(made.data), 1, b"")


def test_digests_of_nulls_repeats_and_clashing_columns(spark, tik):
    rows = [(None, "one", 1), (4, None, 1), (4, "one", 1), (4, "one", 1), (5, "", 1), (None, None, 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("n_tokens", F.lit("clash")).withColumn("ids", F.lit("clash"))
    got = [(r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in byte_bpe.digest_documents(df, RANKS, public_tokenizers.PATTERN).collect()]
    want = [(k, len(tik.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for k, t, _ in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sorted(map(str, byte_bpe.encode_documents(df, RANKS, public_tokenizers.PATTERN).collect())) == sorted(f"Row(doc_id={k}, ids={tik.encode_ordinary(t or '')})" for k, t, _ in rows)


def test_bpe_query(spark, data, tik):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = byte_bpe.query(spark, data).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        ids = tik.encode_ordinary(texts[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()


def test_documents_round_trip(spark):
    texts = odd_texts(100)
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], SCHEMA)
    ids = byte_bpe.encode_documents(df, RANKS, public_tokenizers.PATTERN)
    back = {r["doc_id"]: r["text"] for r in byte_bpe.decode_documents(ids, RANKS, public_tokenizers.PATTERN).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert byte_bpe.digest_documents(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0
