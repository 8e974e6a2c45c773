"""One JSON document as many rows, and many rows as one JSON document, in parallel both ways.

Reading. Spark's text source cuts a file into splits, here at commas that end lines, or at all commas. Whether a split begins inside a string, and how
deep in brackets, follows from all before it, so a first pass brings each split to a summary that can be
composed: whether it flips being inside a string, and how many brackets it opens, were it to begin outside a string or inside
one. Composed in order they say how each split begins (one row a split passes the driver), and a second pass
cuts every split at the commas, openings and closings that end an element. What two splits share is put
together by its first split. An element is a value of a list, or a member of an object, that a field of the
document holds; or a member of the document itself that holds neither.

Writing. Rows are sorted over ranges and written by Spark's own writer, elements apart by commas. The
committed parts are then laid end to end into a file beside the target, which takes the target's name last.
"""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fernlake.runtime import drop_path, materialize

#: What stands after each element that is written.
SEPARATOR = ",\n"
#: Bytes of a row up to which a document is cut at ``SEPARATOR`` alone.
LONGEST = 1 << 13
#: Bytes that are cut at a time.
TOGETHER = 1 << 22
WHOLE, BEGINS, GOES_ON = 0, 1, 2
_ROLE = np.zeros(256, np.int8)
_ROLE[[ord(c) for c in "{["]], _ROLE[[ord(c) for c in "}]"]], _ROLE[ord(",")] = 1, -1, 2

_FRAGMENT = pa.schema([("split", pa.int64()), ("n", pa.int64()), ("kind", pa.int32()), ("depth", pa.int32()), ("field", pa.string()), ("opens", pa.bool_()), ("raw", pa.string())])


def marks(text: bytes, inside: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """Places and roles (1 opens, -1 closes, 2 comma) of what stands outside strings, and whether the end is inside one."""
    b = np.frombuffer(text, np.uint8)
    quotes = np.flatnonzero(b == 34)
    slashes = b == 92
    if slashes.any():  # a quote after an odd run of backslashes is part of its string
        last = np.maximum.accumulate(np.where(slashes, -1, np.arange(len(b))))
        quotes = quotes[(quotes - 1 - np.where(quotes > 0, last[quotes - 1], -1)) % 2 == 0]
    at = np.flatnonzero(_ROLE[b])
    outside = (np.searchsorted(quotes, at) + inside) % 2 == 0
    at = at[outside]
    return at, _ROLE[b[at]], bool((len(quotes) + inside) % 2)


def summary(text: bytes) -> tuple[bool, int, int]:
    """Whether a run of bytes flips being inside a string; brackets it opens, were it to begin outside and inside one."""
    _, role, flips = marks(text, False)
    outside = int(role[role != 2].sum())
    # what stands outside strings were it to begin inside one is what stands inside them otherwise
    n = [text.count(c) for c in (b"{", b"[", b"}", b"]")]
    return flips, outside, n[0] + n[1] - n[2] - n[3] - outside


class Cutter:
    """Cuts a split's bytes into elements and the fragments at its ends."""

    def __init__(self, split: int, inside: bool, depth: int):
        self.split, self.inside, self.depth, self.rest, self.n = split, inside, depth, b"", 0
        self.first, self.field, self.rows = depth > 0, None, []  # before the document there is nothing to go on with

    def row(self, kind: int, raw: bytes, opens: bool = False) -> None:
        deep = min(self.depth, 2)  # what goes on may begin deep inside an element
        self.rows.append((self.split, self.n, kind, deep, self.field if deep == 2 else "", opens, raw.decode()))
        self.n += 1

    def feed(self, text: bytes) -> None:
        text = self.rest + text
        at, role, _ = marks(text, self.inside)
        after = self.depth + np.cumsum(np.where(role == 2, 0, role))
        before = after - np.where(role == 2, 0, role)
        ends = np.flatnonzero(np.minimum(before, after) <= np.where(role == 2, 2, 1))
        low = 0
        for place, kind, deep in zip(at[ends].tolist(), role[ends].tolist(), after[ends].tolist()):
            raw, opens = text[low:place], kind == 1
            if self.first:
                self.row(GOES_ON, raw, opens)
            elif self.depth == 2 or (self.depth == 1 and not opens):
                if raw.strip():
                    self.row(WHOLE, raw)
            elif self.depth == 0 and opens:
                self.row(WHOLE, text[place : place + 1])  # what the document is
            unnamed, self.first, self.depth, self.inside, low = self.first, False, deep, False, place + 1
            if opens and deep == 2:
                key = raw.strip()
                self.field = None if unnamed else json.loads(key[:-1]) if key.endswith(b":") else ""
                self.row(WHOLE, b"")
        self.rest = text[low:]

    def close(self) -> None:
        self.row(GOES_ON if self.first else BEGINS, self.rest)

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(_FRAGMENT), _FRAGMENT.types)], schema=_FRAGMENT)


def _runs(batches: Iterator[pa.RecordBatch], separator: bytes) -> Iterator[tuple[int, bytes]]:
    """Runs of bytes with the place their split has in the file."""
    for batch in batches:
        value, split = batch.column(0), batch.column(1).to_numpy()
        for part in np.split(np.arange(len(split)), np.flatnonzero(np.diff(split)) + 1):
            for low in range(int(part[0]), int(part[-1]) + 1, 1 << 16) if len(part) else ():
                own = value.slice(low, min(1 << 16, int(part[-1]) + 1 - low)).cast(pa.binary())
                joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), separator)
                yield int(split[low]), joined[0].as_py() + separator


def _summaries(separator: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[bool, int, int, int]] = {}
        for split, text in _runs(batches, separator):
            flips, out, inn, size = held.get(split, (False, 0, 0, 0))
            own = summary(text)
            held[split] = (flips ^ own[0], out + own[1 + flips], inn + own[2 - flips], size + len(text))
        rows = [(s, *x) for s, x in held.items()]
        types = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(types)], ["split", "flips", "outside", "inside", "size"])

    return run


def _cut_at(spark: SparkSession, path: str) -> tuple[DataFrame, bytes, list]:
    """A document's text cut into rows, what it is cut at, and the summaries of its splits.

    Rows end at commas that end a line, a row an element in most documents. Hadoop passes over longer rows than ``LONGEST``,
    so where any byte is missed the document is cut at every comma.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    length = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).getLen()
    for separator in (SEPARATOR, ","):
        read = spark.read.option("lineSep", separator)
        if separator == SEPARATOR:
            read = read.option("mapreduce.input.linerecordreader.line.maxlength", str(LONGEST))
        text = read.text(path).select("value", F.col("_metadata.file_block_start").alias("split"))
        end = separator.encode()
        found = sorted(text.mapInArrow(_summaries(end), "split long, flips boolean, outside long, inside long, size long").collect())  # one row a split
        if sum(s["size"] for s in found) in (length, length + len(end)):
            break
    return text, end, found


def elements(spark: SparkSession, path: str) -> DataFrame:
    """``field, split, n, raw`` of the elements of the JSON document at ``path``, in the order of ``split, n``.

    ``field`` names the list or object they stand in; it is empty for members of the document that are neither, and for
    the row that says what the document is (``{`` or ``[``). ``raw`` is JSON: a value, or ``"key": value`` in objects; an
    empty one says that the field is there. A document that is not whole raises.
    """
    text, separator, found = _cut_at(spark, path)
    begins, inside, depth = {}, False, 0
    for s in found:
        begins[s["split"]] = (inside, depth)
        inside, depth = inside ^ s["flips"], depth + (s["inside"] if inside else s["outside"])
    if inside or depth:
        raise ValueError(f"{path} holds no whole JSON document")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, held = None, []
        for split, run in _runs(batches, separator):
            if cutter is None or cutter.split != split:
                if cutter:
                    cutter.feed(b"".join(held))
                    cutter.close()
                    yield cutter.batch()
                cutter, held = Cutter(split, *begins[split]), []
            held.append(run)
            if sum(map(len, held)) >= TOGETHER:
                cutter.feed(b"".join(held))
                held = []
                yield cutter.batch()
        if cutter:
            cutter.feed(b"".join(held))
            cutter.close()
            yield cutter.batch()

    made, _ = materialize(text.mapInArrow(cut, "split long, n long, kind int, depth int, field string, opens boolean, raw string"), "elements")
    # what the driver sees of a split: its ends, its last field, and the text of ends that may name a field
    ends = made.filter(F.col("kind") != WHOLE).select("split", "n", "kind", "depth", "opens", F.when(F.col("depth") < 2, F.col("raw")).alias("raw"))
    last = dict(made.filter("depth = 2 and field is not null").groupBy("split").agg(F.max_by("field", "n")).collect())
    owners, fields, owner, name, held = [], [], None, "", ""
    of_split: dict[int, str] = {}
    for e in sorted(ends.collect(), key=lambda e: (e["split"], e["n"])):
        if e["kind"] == GOES_ON:
            of_split[e["split"]] = name  # of the rows before any other field opens
            held += e["raw"] or ""
            if owner is not None:
                owners.append((e["split"], e["n"], *owner, name if e["depth"] == 2 else "", e["opens"]))
            if e["opens"] and e["depth"] == 1:
                of_split[e["split"]] = json.loads(held.strip()[:-1])
            name = last.get(e["split"], of_split[e["split"]])
        else:
            owner, held = (e["split"], e["n"]), e["raw"] or ""
            name = last.get(e["split"], of_split.get(e["split"], ""))
            owners.append((e["split"], e["n"], *owner, name if e["depth"] == 2 else "", e["opens"]))
    fields = spark.createDataFrame(list(of_split.items()), "split long, before string")
    owned = spark.createDataFrame(owners, "split long, n long, own_split long, own_n long, own_field string, opens boolean")
    whole = made.filter(F.col("kind") == WHOLE).join(F.broadcast(fields), "split", "left").select(F.coalesce("field", "before", F.lit("")).alias("field"), "split", "n", "raw")
    parts = made.filter(F.col("kind") != WHOLE).drop("opens").join(F.broadcast(owned), ["split", "n"])
    joined = parts.groupBy("own_split", "own_n").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("split", "n", "raw"))), lambda p: p["raw"]), "").alias("raw"),
        F.first("own_field").alias("field"),
        F.max("opens").alias("opens"),
        F.max("depth").alias("depth"),
    )
    joined = joined.filter("trim(raw) <> '' and depth > 0 and not (opens and depth = 1)")
    return whole.unionByName(joined.select("field", F.col("own_split").alias("split"), F.col("own_n").alias("n"), "raw"))


def members(rows: DataFrame) -> DataFrame:
    """``key, value`` of elements that are members of objects; values that are strings without their quotes."""
    entry = F.from_json(F.concat(F.lit("{"), F.col("raw"), F.lit("}")), "map<string,string>")
    return rows.select(F.explode(entry).alias("key", "value"))


def member(key: Column, value: Column) -> Column:
    """``"key": value`` as JSON."""
    whole = F.to_json(F.create_map(key.cast("string"), value), {"ignoreNullFields": "false"})
    return F.substr(whole, F.lit(2), F.length(whole) - 2)


def value(*columns: str | Column) -> Column:
    """A row as a JSON object, nulls kept."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def _copy(spark: SparkSession, folder: str, out) -> None:
    """Committed parts end to end; the comma after the last element stays behind. Bytes go through a small buffer."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(folder)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    listed = sorted(((s.getPath().getName(), s) for s in fs.listStatus(where)), key=lambda x: x[0])
    parts = [s for name, s in listed if name.startswith("part-") and s.getLen()]
    for part in parts:
        source = fs.open(part.getPath())
        try:
            own = jvm.org.apache.commons.io.input.BoundedInputStream(source, part.getLen() - (len(SEPARATOR) if part is parts[-1] else 0))
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(own, out, 1 << 16, False)
        finally:
            source.close()


def write_document(spark: SparkSession, path: str, fields: dict) -> None:
    """One JSON object at ``path``. A field is any small value, or ``(brackets, rows, order)``: a frame's column ``raw`` in an order, as a list or an object.

    No row passes the driver's Python, and none of its processes holds more than a buffer of the document. A file that is
    there is replaced once the new one is whole.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path
    target, made = at(path), at(f"{path}.{uuid.uuid4().hex}")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    folders = {}
    try:
        for name, given in fields.items():
            if isinstance(given, tuple):
                _, rows, order = given
                folders[name] = f"{path}.{uuid.uuid4().hex}.parts"
                rows.orderBy(*order).select("raw").write.option("lineSep", SEPARATOR).text(folders[name])
        out = fs.create(made, True)
        try:
            for i, (name, given) in enumerate(fields.items()):
                out.write(bytearray(f"{',' if i else '{'}\n{json.dumps(name)}: ".encode()))
                if name in folders:
                    out.write(bytearray(f"{given[0][0]}\n".encode()))
                    _copy(spark, folders[name], out)
                    out.write(bytearray(f"\n{given[0][1]}".encode()))
                else:
                    out.write(bytearray(json.dumps(given).encode()))
            out.write(bytearray(b"\n}\n" if fields else b"{}\n"))
        finally:
            out.close()
        fs.delete(target, False)
        if not fs.rename(made, target):
            raise OSError(f"{path} could not be replaced")
    finally:
        for folder in folders.values():
            drop_path(spark, folder)
        with contextlib.suppress(Exception):
            fs.delete(made, False)
