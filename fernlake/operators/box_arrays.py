"""Boxes of many images at once, as arrays inside a task.

Rows come sorted by image, ``_k`` numbering an image's rows from 1. The arithmetic is ``functions.boxes``', with SQL's
order of doubles: NaN is the largest, and a missing corner leaves the other box's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Pairs that are compared at a time.
PAIRS = 1 << 20


def chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Table, bool]]:
    """Tables of whole images with up to ``most`` rows each, and, marked, pieces of one larger image in order."""
    rest = None
    for batch in batches:
        own = pa.Table.from_batches([batch])
        table = own if rest is None else pa.concat_tables([rest, own])
        rest = None
        starts = np.flatnonzero(table.column("_k").to_numpy() == 1)
        lead = int(starts[0]) if len(starts) else len(table)
        if lead:
            yield table.slice(0, lead), True
        if not len(starts):
            continue
        low = 0
        large = np.flatnonzero(np.diff(starts) > most).tolist()
        for i in large:
            if i > low:
                yield table.slice(starts[low], starts[i] - starts[low]), False
            yield table.slice(starts[i], starts[i + 1] - starts[i]), True
            low = i + 1
        if low < len(starts) - 1:
            yield table.slice(starts[low], starts[-1] - starts[low]), False
        last = table.slice(starts[-1])
        if len(last) > most:
            yield last, True
        else:
            rest = last
    if rest is not None:
        yield rest, False


class Boxes:
    """Boxes by corners, an image's together: ``n`` of each image, from ``start``; ``rows`` are their rows of a table."""

    def __init__(self, corners: list[np.ndarray], absent: bool, rows: np.ndarray, n: np.ndarray):
        (self.x1, self.y1, self.x2, self.y2), self.absent, self.rows = corners, absent, rows
        self.area = span(self.x1, self.x2, absent) * span(self.y1, self.y2, absent)
        self.n, self.start = n, np.cumsum(n) - n

    @classmethod
    def of(cls, table: pa.Table, image: np.ndarray, rows: np.ndarray, images: int) -> Boxes:
        """Some of a table's rows; ``image`` numbers the images of all of them."""
        corners, absent = [], False
        for name, none in (("x1", -np.inf), ("y1", -np.inf), ("x2", np.inf), ("y2", np.inf)):
            column = table.column(name)
            values = column.to_numpy()
            if column.null_count:
                values, absent = np.where(column.is_null().to_numpy(), none, values), True
            corners.append(values[rows])
        return cls(corners, absent, rows, np.bincount(image[rows], minlength=images))

    def where(self, wanted: np.ndarray, image: np.ndarray) -> Boxes:
        """Those of the boxes."""
        rows = self.rows[wanted]
        return Boxes([c[wanted] for c in (self.x1, self.y1, self.x2, self.y2)], self.absent, rows, np.bincount(image[rows], minlength=len(self.n)))


def span(low: np.ndarray, high: np.ndarray, absent: bool) -> np.ndarray:
    with np.errstate(invalid="ignore"):
        long = np.maximum(0.0, high - low)
    return np.where(np.isinf(long), 0.0, long) if absent else long


def iou(a: Boxes, i: np.ndarray, b: Boxes, j: np.ndarray) -> np.ndarray:
    """IoUs of the boxes at ``i`` with those at ``j``; 0 where the union is not positive."""
    absent = a.absent or b.absent
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        wide = span(np.maximum(a.x1[i], b.x1[j]), np.fmin(a.x2[i], b.x2[j]), absent)
        high = span(np.maximum(a.y1[i], b.y1[j]), np.fmin(a.y2[i], b.y2[j]), absent)
        both = wide * high
        union = a.area[i] + b.area[j] - both
        return np.where(union <= 0, 0.0, both / union)


def each(n: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``n`` numbers from ``start`` on for each place, and the places."""
    at = np.repeat(np.arange(len(n)), n)
    return at, np.arange(len(at)) - (np.cumsum(n) - n)[at] + start[at]


def parts(n: np.ndarray) -> list[np.ndarray]:
    """Places in runs that add up to about ``PAIRS``, a larger place by itself."""
    return np.split(np.arange(len(n)), np.flatnonzero(np.diff(np.cumsum(n) // PAIRS)) + 1) if len(n) else []


def pairs(a: Boxes, b: Boxes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Each box of ``a`` with each of ``b`` of its image, in order, and their IoUs; some images at a time."""
    for own in parts(a.n * b.n):
        of, i = each(a.n[own], a.start[own])
        at, j = each(b.n[own][of], b.start[own][of])
        i = i[at]
        yield i, j, iou(a, i, b, j)


def best(a: Boxes, b: Boxes) -> np.ndarray:
    """Of each box of ``a`` the largest IoU with a box of ``b`` of its image, 0 without any."""
    found = np.zeros(len(a.rows))
    for i, _, v in pairs(a, b):
        if len(i):
            first = np.flatnonzero(np.diff(i, prepend=-1))
            found[i[first]] = np.maximum.reduceat(v, first)
    return found


def kept(a: Boxes, threshold: float) -> np.ndarray:
    """Which boxes greedy suppression keeps; an image's come best first."""
    dropped = bytearray(len(a.rows))
    for i, j, v in pairs(a, a):
        over = (i < j) & ~(v <= threshold)
        for x, y in zip(i[over].tolist(), j[over].tolist()):
            if not dropped[x]:
                dropped[y] = 1
    return np.frombuffer(dropped, np.uint8) == 0


def matches(a: Boxes, b: Boxes, index: np.ndarray, threshold: float) -> np.ndarray:
    """The place in ``b`` of the box that each of ``a`` takes, -1 for none; an image's come best first.

    Of boxes alike that with the lower ``index`` is taken.
    """
    got, used = [-1] * len(a.rows), bytearray(len(b.rows))
    for i, j, v in pairs(a, b):
        near = ~(v < threshold)
        i, j, v = i[near], j[near], v[near]
        order = np.lexsort((index[j], np.where(np.isnan(v), -np.inf, -v), i))
        for x, y in zip(i[order].tolist(), j[order].tolist()):
            if got[x] < 0 and not used[y]:
                got[x], used[y] = y, 1
    return np.array(got, np.int64)
