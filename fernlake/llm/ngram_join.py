"""Similarity join of word n-gram sets by token-combination prefixes.

A document is the set of its word n-grams, its tokens. One order holds for all: rare tokens first, by their counts in
all documents. Of a set of ``n`` tokens, any that is similar enough to another misses at most ``slack = n - ceil(s * n)``.
Tokens fall into classes: rare ones stand for themselves; frequent ones, split by a hash into small classes, are indexed by
combinations of ``k``, 2 or 3 by how frequent they are, which far fewer sets share than share a token. The prefix is
extended until misses cannot hide every signature: ``p`` tokens of a class of combinations of ``k`` withstand ``p - k + 1`` misses,
and the prefix ends where its classes withstand ``slack + 1`` together. Of two similar sets take the one whose prefix ends
first: one of its classes keeps ``k`` tokens that both have, and these stand in the other's prefix too, so the two share a signature.

How many classes there are follows the size of sets, so that classes have a few tokens each: it is set by the level
(power of two) of the size. A set whose partners may lie on the level below signs on both. A set that ends before its classes withstand
enough has its whole as prefix, which serves against sets that do; for two such sets both sign by the tokens of the plain prefix.

What shares a signature is then compared as near-duplicates of the pipeline are: against one of its bucket, then
all that these links have not connected, in blocks, ruled out by bounds and verified on whole sets.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernlake.llm import shingle_ranks
from fernlake.llm.simhash import similar_rows

SIMILARITY, WORDS = 0.85, 4
#: Documents above what chance puts on a counter from which a token is indexed by pairs, and by triples.
PAIRS, TRIPLES = shingle_ranks.rank_of_count(32), shingle_ranks.rank_of_count(2048)
#: Tokens that a class of combinations is meant to have in a prefix.
CLASS = 4


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit given."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def combined(*parts: np.ndarray | int) -> np.ndarray:
    """One hash of several hashes, in their order."""
    out = np.uint64(0x9E3779B97F4A7C15)
    for part in parts:
        out = _mixed(np.atleast_1d(np.asarray(part, np.uint64)) + _mixed(np.atleast_1d(out)))
    return out


def slack_of(size: int, similarity: float) -> int:
    """The most tokens of a set that a similar set can miss."""
    return size - int(np.ceil(similarity * size - 1e-9))


def levels_of(size: int, similarity: float) -> list[int]:
    """Levels of the sizes from the smallest partner's up to the set's own."""
    return list(range((size - slack_of(size, similarity)).bit_length() - 1, size.bit_length()))


def classes_on(level: int, similarity: float) -> int:
    return max(1, int((1 << level + 1) * (1 - similarity) * 4 / 3 / CLASS))


def _numbered(groups: np.ndarray) -> np.ndarray:
    """Each entry's place among the entries of its own value."""
    order = np.argsort(groups, kind="stable")
    own = groups[order]
    out = np.empty(len(groups), np.int64)
    out[order] = np.arange(len(own)) - np.searchsorted(own, own)
    return out


def combinations(tokens: np.ndarray, groups: np.ndarray, k: np.ndarray, level: int) -> np.ndarray:
    """Signatures of all pairs, or triples where ``k`` is 3, of tokens of the same group; a group has one ``k``."""
    order = np.argsort(groups, kind="stable")
    tokens, groups, k = tokens[order], groups[order], k[order]
    start = np.flatnonzero(np.diff(groups, prepend=-1))
    out = []
    for a, b in zip(start.tolist(), [*start[1:].tolist(), len(groups)]):
        own = tokens[a:b]
        i, j = np.triu_indices(b - a, 1)
        if k[a] == 2:
            out.append(combined(level, own[i], own[j]))
        else:
            times = b - a - 1 - j
            upto = np.cumsum(times)
            l_ = np.arange(upto[-1] if len(upto) else 0) - np.repeat(upto - times - j - 1, times)
            out.append(combined(level, own[np.repeat(i, times)], own[np.repeat(j, times)], own[l_]))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def signatures(tokens: np.ndarray, ranks: np.ndarray, similarity: float = SIMILARITY, pairs: int = PAIRS, triples: int = TRIPLES) -> tuple[np.ndarray, int]:
    """A set's signatures, in an order that all sets share, and how many of the first are tokens, rarest first."""
    if not len(tokens):
        return tokens, 0
    rank, need = shingle_ranks.looked_up(tokens, ranks), slack_of(len(tokens), similarity) + 1
    order = np.lexsort((tokens, rank))
    tokens, rank = tokens[order], rank[order]
    rare = int(np.searchsorted(rank, pairs))
    if rare >= need:
        return tokens[:need], need
    rest, k = tokens[rare:], np.where(rank[rare:] >= triples, 3, 2)
    made, whole = [], False
    for level in levels_of(len(tokens), similarity):
        groups = (_mixed(rest) % np.uint64(classes_on(level, similarity))).astype(np.int64) * 2 + (k == 3)
        withstands = rare + np.cumsum(_numbered(groups) >= k - 1)
        enough = int(np.searchsorted(withstands, need)) + 1
        whole |= enough > len(rest)
        made.append(combinations(rest[:enough], groups[:enough], k[:enough], level))
    if whole:
        made.append(combined(0xFFFF, rest[: need - rare]))
    return np.concatenate([tokens[:rare], np.unique(np.concatenate(made))]), rare


def joined(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row: the size of its set and the smallest doc_id reachable by links, itself included.

    Two documents link if their sets' intersection is at least ``similarity`` of their union: every such pair between different texts is
    connected, whatever the size of its group. Only A-Z are lower-cased, words end at ASCII white space; with fewer words than ``words`` the
    whole sequence is the one token. Null texts and texts without words have empty sets, link with nothing and are their own component. Texts
    that differ in white space or A-Z case only are one class. Null ids take part but name a component only where all its ids are null; repeated rows and ids stay;
    other columns are ignored; an empty table gives no rows.
    """
    rows = similar_rows(docs, similarity, id_col, text_col, words, lambda tokens, ranks: signatures(tokens, ranks, similarity))
    empty = F.col("size") == 0
    return rows.select("doc_id", F.col("size").cast("long").alias("n_shingles"), F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fernlake.runtime import table

    return joined(table(spark, sf_dir, "documents"))
