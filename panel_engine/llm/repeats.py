"""Windows that also start in an earlier document, found by anchors: shared by the two substring operators.

Every window of a fixed length names an anchor inside it, by a rule that looks at nothing outside the
window, so equal windows name equal anchors. Neighbouring windows with one anchor form a record: a
key (hash of the anchor), the content hash of the stretch that the windows cover, document, first window and number
of windows. Records meet by key, packed in bundles. Where a key has one content, the smallest
document keeps it and all others lose those windows. Where it has several, one copy of each content
goes on to be compared window by window.

Copies of a content inside one bundle of documents are settled on the spot, so a passage that a third of all
documents share sends one record per bundle, not one per document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panel_engine.llm.text import whole

U = np.uint64
BASE = 0x9E3779B97F4A7C15
#: Bytes of text that are worked on at once in a task.
BUNDLE_BYTES = 2 << 20
#: Key slices; a multiple of the shuffle partitions, so that a slice stays small at any size.
SLICES_PER_PARTITION, LEAST_SLICES = 4, 256

FOUND = "doc long, start int, n int, open boolean, k long"


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective scramble of 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64, by doubling."""
    out = np.ones(n + 1, U)
    filled = 1
    while filled <= n:
        take = min(filled, n + 1 - filled)
        out[filled:filled + take] = out[:take] * U(pow(base, filled, 1 << 64))
        filled += take
    return out


class Ranges:
    """Hashes of ranges of a sequence of 64-bit values, wherever they lie, from prefix sums of a polynomial."""

    def __init__(self, values: np.ndarray):
        self.upto = np.concatenate([np.zeros(1, U), np.cumsum(values * powers(BASE, max(len(values) - 1, 0))[:len(values)], dtype=U)])
        self.back = powers(pow(BASE, -1, 1 << 64), len(values))

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return mixed((self.upto[high] - self.upto[low]) * self.back[low] + mixed((high - low).astype(U)))


@dataclass
class Records:
    key: np.ndarray
    content: np.ndarray
    doc: np.ndarray
    start: np.ndarray  # first window, counted from the document's start
    n: np.ndarray


def records(anchor: np.ndarray, low: np.ndarray, high: np.ndarray, starts: np.ndarray, docs: np.ndarray, doc_at: np.ndarray, hashes: Ranges, width: int) -> Records:
    """Records of the windows starting at ``starts`` (ascending), ``anchor`` the place of each one's anchor,
    which covers [low, high)."""
    if not len(starts):
        empty = np.empty(0, np.int64)
        return Records(empty.astype(U), empty.astype(U), empty, empty, empty)
    new = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]) | (starts[1:] != starts[:-1] + 1)))
    n = np.diff(np.append(new, len(starts)))
    first = starts[new]
    owner = np.searchsorted(doc_at, first, side="right") - 1
    return Records(hashes.of(low[new], high[new]), hashes.of(first, first + n + width - 1), docs[owner], first - doc_at[owner], n)


def merged(doc: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Adjoining runs of windows joined."""
    if not len(doc):
        return doc, start, n
    order = np.lexsort((start, doc))
    doc, start, n = doc[order], start[order], n[order]
    new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + n[:-1])))
    return doc[new], start[new], np.add.reduceat(n, new)


def later_copies(r: Records) -> np.ndarray:
    """Rows whose content a smaller document of these has too."""
    order = np.lexsort((r.doc, r.content, r.key))
    k, c, d = r.key[order], r.content[order], r.doc[order]
    new = np.append(True, (k[1:] != k[:-1]) | (c[1:] != c[:-1]))[: len(order)]
    least = d[np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else d
    out = np.zeros(len(order), bool)
    out[order] = d > least
    return out


def bundles(batches: Iterator[pa.RecordBatch], find: Callable, slices: int) -> Iterator[pa.RecordBatch]:
    """Rows (doc, text) to rows (slice, bundle of records by column, settled runs likewise)."""
    def close(docs: list[int], texts: list[str]) -> pa.RecordBatch:
        r: Records = find(np.array(docs, np.int64), texts)
        gone = later_copies(r)
        settled = merged(r.doc[gone], r.start[gone], r.n[gone])
        r = Records(*[getattr(r, f)[~gone] for f in ("key", "content", "doc", "start", "n")])
        part = (r.key % U(slices)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(slices + 1))
        numbers = np.flatnonzero(np.diff(cuts))
        columns_ = [(r.key >> U(16)).astype("<u4")[order], r.content[order], r.doc[order], r.start.astype("<i4")[order], r.n.astype("<i4")[order]]
        rows = [packed([a[cuts[s]:cuts[s + 1]] for a in columns_], 2) for s in numbers]
        done = [b""] * len(rows)
        if len(settled[0]):
            done.append(packed([settled[0], settled[1].astype("<i4"), settled[2].astype("<i4")], 0))
            rows.append(b"")
            numbers = np.append(numbers, docs[0] % slices)
        return pa.RecordBatch.from_arrays([pa.array(numbers.astype(np.int32)), pa.array(rows, pa.binary()), pa.array(done, pa.binary())], names=["slice", "packed", "done"])

    docs: list[int] = []
    texts: list[str] = []
    size = 0
    for batch in batches:
        for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            docs.append(d)
            texts.append(t)
            size += len(t)
            if size >= BUNDLE_BYTES:
                yield close(docs, texts)
                docs, texts, size = [], [], 0
    if docs:
        yield close(docs, texts)


KINDS, DONE_KINDS = ["<u4", "<u8", "<i8", "<i4", "<i4"], ["<i8", "<i4", "<i4"]


def packed(arrays: list[np.ndarray], doc_at: int) -> bytes:
    """Columns end to end, compressed; documents as steps from one to the next, which are mostly small."""
    arrays[doc_at] = np.diff(arrays[doc_at], prepend=0).astype("<i8")
    return zstandard.compress(b"".join(a.tobytes() for a in arrays), 1)


def columns(blob: bytes, kinds: list[str], doc_at: int) -> list[np.ndarray]:
    blob = zstandard.decompress(blob)
    n = len(blob) // sum(np.dtype(k).itemsize for k in kinds)
    out, at = [], 0
    for k in kinds:
        out.append(np.frombuffer(blob, k, n, at))
        at += n * np.dtype(k).itemsize
    out[doc_at] = np.cumsum(out[doc_at])
    return out


def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by slice to runs (doc, start, n, open, k): closed ones are lost, open ones to be compared."""
    def out(doc, start, n, open_, k) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(doc, pa.int64()), pa.array(start, pa.int32()), pa.array(n, pa.int32()), pa.array(open_, pa.bool_()), pa.array(k, pa.int64())],
            names=["doc", "start", "n", "open", "k"])

    def close(number: int, held: list[bytes]) -> pa.RecordBatch:
        parts = [columns(b, KINDS, 2) for b in held]
        r = Records(*[np.concatenate(x) for x in zip(*parts)])
        order = np.lexsort((r.doc, r.content, r.key))
        key, content, doc, start, n = (getattr(r, f)[order] for f in ("key", "content", "doc", "start", "n"))
        new_key = np.append(True, key[1:] != key[:-1])
        new_content = new_key | np.append(True, content[1:] != content[:-1])
        at_key, at_content = np.flatnonzero(new_key), np.flatnonzero(new_content)
        of_key, of_content = np.cumsum(new_key) - 1, np.cumsum(new_content) - 1
        later = doc > doc[at_content][of_content]
        several = (np.add.reduceat(new_content, at_key, dtype=np.int64) > 1) & (
            np.minimum.reduceat(doc, at_key) != np.maximum.reduceat(doc, at_key))
        open_ = several[of_key] & ~later
        pick = later | open_
        return out(doc[pick], start[pick], n[pick], open_[pick], (key[pick].astype(np.int64) << 16) | (number & 0xFFFF))

    number, held = None, []
    for batch in batches:
        for s, bundle, done in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if done:
                d, a, n = columns(done, DONE_KINDS, 0)
                yield out(d, a, n, np.zeros(len(d), bool), np.zeros(len(d), np.int64))
            if bundle:
                if s != number and held:
                    yield close(number, held)
                    held = []
                number = s
                held.append(bundle)
    if held:
        yield close(number, held)


def runs(docs: DataFrame, find: Callable) -> DataFrame:
    """Runs of windows (doc, start, n, open, k) over rows (doc, text): see the module's text."""
    slices = max(LEAST_SLICES, SLICES_PER_PARTITION * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bundled = docs.select("doc", "text").mapInArrow(lambda it: bundles(it, find, slices), "slice int, packed binary, done binary")
    return bundled.repartition("slice").sortWithinPartitions("slice").mapInArrow(settle, FOUND)


def by_document(found: DataFrame) -> DataFrame:
    """doc, and its runs packed as (start, n) pairs of 32-bit integers."""
    pair = F.shiftleft(F.col("start").cast("long"), 32) + F.col("n")
    return found.groupBy("doc").agg(F.collect_list(pair).alias("runs"))


def numbered(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc, text, with null texts empty and rows without a key kept apart by the caller."""
    return docs.select(F.col(key).cast("long").alias("doc"), whole(text).alias("text"))


def covered(runs_: np.ndarray, n: int, width: int) -> np.ndarray:
    """Which of ``n`` places windows starting in ``runs_`` cover."""
    start, count = np.minimum(runs_ >> 32, n), runs_ & 0xFFFFFFFF
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, start, 1)
    np.add.at(step, np.minimum(start + count + width - 1, n), -1)
    return np.cumsum(step[:n]) > 0


def squeezed(rows: DataFrame) -> DataFrame:
    """Rows (doc, text) to (doc, z): texts compressed one by one, as they are about to be shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([pack.compress(t.encode()) for t in batch.column(1).to_pylist()], pa.binary())], names=["doc", "z"])

    return rows.select("doc", "text").mapInArrow(run, "doc long, z binary")


def unsqueezed(z: bytes) -> bytes:
    return zstandard.decompress(z)
