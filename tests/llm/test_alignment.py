"""Alignment against a brute-force version that compares all tokens of a text."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from fernlake.llm import alignment

LEVEL, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def _slow(rows):
    """Each text's tokens, groups and links by comparing every A with every B token."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_lib, b_lib = Tokenizer.from_file(LEVEL), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    a_lib.encode_special_tokens = True
    of = alignment.level_bytes()
    found = []
    for doc_id, text in rows:
        links, groups, a, b = [], [], [], []
        if text:
            a = a_lib.encode(" " + text, add_special_tokens=False).ids
            b = b_lib.encode(text)
            spell_a = [bytes(of[c] for c in a_lib.id_to_token(i)) for i in a]
            spell_b = [bytes([int(b_lib.id_to_piece(i)[3:5], 16)]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(spell_a) != (" " + text).encode() or b"".join(spell_b) != (" " + text).encode():
                a, b = [], []
            else:
                span_a, span_b = [], []
                for spell, spans in ((spell_a, span_a), (spell_b, span_b)):
                    at = 0
                    for part in spell:
                        spans.append((at, at + len(part)))
                        at += len(part)
                links = [(x, y) for x, (s, e) in zip(a, span_a) for y, (p, q) in zip(b, span_b) if s < q and p < e]
                low = 0
                for cut in sorted({e for _, e in span_a} & {e for _, e in span_b}):
                    inside = [",".join(str(i) for i, (s, e) in zip(ids, spans) if low <= s and e <= cut) for ids, spans in ((a, span_a), (b, span_b))]
                    groups.append("|".join(inside))
                    low = cut
        found.append((doc_id, a, b, groups, links))
    counts = Counter(x for *_, links in found for x in links)
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for doc_id, a, b, groups, links in found:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        out.append((doc_id, len(a), len(b), len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), digest))
    return sorted(out, key=str)


ODD = [
    None, "", " ", "  two  spaces ", "a", "tab\there\nnew line \n end", "▁ bar", "naïve 東京 \U0001f600 नमस्ते",
    "<|endoftext|> <s> </s> <unk> <0x41>", "x" * 300, "nbsp here", "\x00 null", "don't we'll I'M", "https://example.org/a?b=c&d=12345678", "　wide　", " lead", "trail ",
]


@pytest.mark.parametrize("hot", [alignment.HOT, 40, 0])
def test_equals_brute_force(spark, hot):
    pick = random.Random(5)
    words = "the of token alignment's café Straße 2024-11-05 你好 x=1; é bytes (fallback) \U0001f468‍\U0001f469 zz".split()
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, " ".join(pick.choices(words, k=pick.randint(1, 30)))) for i in range(40)]
    rows += [(100, rows[-1][1]), (None, "a text without an id"), (7, "other text of a repeated id")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, row string, pairs int").repartition(3)
    got = alignment.align_documents(docs, LEVEL, PIECE, hot=hot)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=str) == _slow(rows)


def test_links_of_random_cuts():
    draw = np.random.default_rng(1)
    for _ in range(50):
        a = draw.integers(1, 5, draw.integers(1, 20))
        b = []
        while sum(b) < a.sum():
            b.append(min(int(draw.integers(1, 6)), int(a.sum() - sum(b))))
        group_a, group_b, first, width = alignment.links_of(a, np.array(b))
        at_a, at_b = alignment.expand(first, width)
        ends = [np.cumsum(a), np.cumsum(b)]
        spans = [list(zip(e - n, e)) for e, n in zip(ends, (a, np.array(b)))]
        assert list(zip(at_a, at_b)) == [(i, j) for i, (s, e) in enumerate(spans[0]) for j, (p, q) in enumerate(spans[1]) if s < q and p < e]
        assert group_a[-1] == group_b[-1] == len(set(ends[0]) & set(ends[1])) - 1


def test_empty_table_and_long_text(spark):
    assert alignment.align_documents(spark.createDataFrame([], "doc_id long, text string"), LEVEL, PIECE).count() == 0
    rows = [(1, "word " * 60_000 + "end"), (2, "y" * 20_000)]
    got = {r["doc_id"]: r for r in alignment.align_documents(spark.createDataFrame(rows, "doc_id long, text string"), LEVEL, PIECE).collect()}
    assert got[1]["n_groups"] == got[1]["n_a"] == got[1]["n_b"] == 60_001
    assert got[1]["count_sum"] == 60_000**2 + 1 and got[1]["n_best"] == 60_001
    assert got[2]["n_links"] == got[2]["n_a"] + got[2]["n_b"] - got[2]["n_groups"]
