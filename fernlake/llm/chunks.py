"""Texts of a batch as codes of their distinct chunks.

Patterns of byte-level tokenizers cut before a lone space between two characters that are not
white space. A text is cut at its spaces; each chunk but the first stands for itself and the
space before it. Chunks repeat, so an encoder works on a batch's distinct ones, which Arrow finds,
and texts are put together from codes. A text with other white space beside a space is not cut
right by this and is marked ``apart``, to be encoded whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


#: Texts that are cut together: enough for chunks to repeat, few enough for a worker's memory.
TOGETHER = 2000


def slices(texts: pa.Array, rows: int = TOGETHER) -> Iterator[pa.Array]:
    for low in range(0, len(texts), rows):
        yield texts.slice(low, rows)


def _ragged(chunk: str) -> bool:
    return not chunk or chunk[0].isspace() or chunk[-1].isspace()


class Chunked:
    """``spaced`` and ``first``: distinct chunks with and without a space before them; ``codes`` number the one and then the other."""

    def __init__(self, texts: pa.Array):
        self.texts = pc.fill_null(texts, "")
        lists = pc.split_pattern(self.texts, " ")
        flat, edge = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
        self.edge = edge - edge[0]
        coded, firsts = flat.dictionary_encode(), flat.take(pa.array(self.edge[:-1])).dictionary_encode()
        self.spaced, self.first = coded.dictionary.to_pylist(), firsts.dictionary.to_pylist()
        self.codes = coded.indices.to_numpy().astype(np.int32)
        at = firsts.indices.to_numpy()
        self.ragged = np.fromiter(map(_ragged, self.spaced), bool, len(self.spaced))
        loose = np.array([bool(c) and c[-1].isspace() for c in self.first], bool)
        alone = np.diff(self.edge) == 1
        self.codes[self.edge[:-1]] = len(self.spaced) + at
        marked = np.concatenate([self.ragged, loose])[self.codes]
        self.apart = (np.add.reduceat(marked, self.edge[:-1]) > 0) & ~alone if len(texts) else np.zeros(0, bool)
        self.used = np.zeros(len(self.spaced), bool)  # a chunk that only begins texts is not needed with a space
        inner = self.codes[self.codes < len(self.spaced)]
        self.used[inner] = True
        self.used &= ~self.ragged

    def whole(self, i: int) -> str:
        return self.texts[i].as_py()

    def rows(self) -> Iterator[np.ndarray]:
        """Each text's codes."""
        for a, b in zip(self.edge[:-1].tolist(), self.edge[1:].tolist()):
            yield self.codes[a:b]


def gather(chunked: Chunked, pool: np.ndarray, length: np.ndarray, together: int = 256) -> Iterator[np.ndarray]:
    """Each text's ids, where chunk ``c`` has the next ``length[c]`` of ``pool``."""
    start, edge = np.cumsum(length) - length, chunked.edge
    for low in range(0, len(edge) - 1, together):
        ends = edge[low : low + together + 1]
        own = chunked.codes[ends[0] : ends[-1]]
        sizes = length[own]
        upto = np.cumsum(sizes)
        ids = pool[np.repeat(start[own] - upto + sizes, sizes) + np.arange(upto[-1])]
        stop = upto[ends[1:] - ends[0] - 1].tolist()
        for a, b in zip([0, *stop[:-1]], stop):
            yield ids[a:b]
