"""Repeated byte strings removed by suffix arrays over shards, built by external induced sorting.

Equal strings of ``width`` bytes have the same minimizer, the least of their hashed grams, so it says
which shard a string belongs to. What one pass over the minimizers settles (strings around one that
occurs in one document, or always in the same surroundings: see ``repeats``) needs no sorting. The
stretches that are left meet by minimizer in shards; each shard's text is sorted by ``suffixes``, and
suffixes that share ``width`` bytes or more with their neighbours are one string: all but the smallest
document's lose it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panel_engine.llm.repeats import Ranges, Records, U, by_document, covered, merged, mixed, numbered, records, runs, squeezed, unsqueezed
from panel_engine.llm.suffixes import LIMIT, suffix_array
from panel_engine.sources.scratch import materialize

WIDTH, GRAM = 50, 24
#: Bytes of text after which a shard is closed at the next minimizer.
SHARD_BYTES = 1 << 20
#: Between stretches of a shard; UTF-8 never has this byte.
APART = 0xFF
#: Fixed random values of the 256 bytes.
VALUES = mixed(np.arange(1, 257).astype(U) * U(0xD6E8FEB86659FD93))


def least_places(values: np.ndarray, span: int) -> np.ndarray:
    """For each place the place of the least of ``span`` values from there on, the first of equal ones."""
    value, place, size = values, np.arange(len(values)), 1

    def join(shift: int):
        better = value[shift:] < value[:-shift]
        return np.where(better, value[shift:], value[:-shift]), np.where(better, place[shift:], place[:-shift])

    while 2 * size <= span:
        value, place = join(size)
        size *= 2
    if size < span:
        value, place = join(span - size)
    return place


def find(docs: np.ndarray, texts: list[str], width: int = WIDTH, gram: int = GRAM) -> Records:
    data = [t.encode() for t in texts]
    sizes = np.array([len(d) for d in data])
    doc_at = np.cumsum(sizes) - sizes
    text = np.frombuffer(b"".join(data), np.uint8)
    hashes = Ranges(VALUES[text])
    n = len(text)
    if n < width:
        anchor = starts = np.empty(0, np.int64)
    else:
        place = np.arange(n - gram + 1)
        anchor = least_places(hashes.of(place, place + gram), width - gram + 1)
        windows = np.maximum(sizes - width + 1, 0)
        starts = np.repeat(doc_at - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
        anchor = anchor[starts]
    some = sizes > 0
    return records(anchor, anchor, anchor + gram, starts, docs[some], doc_at[some], hashes, width)


Stretch = tuple[int, int, bytes]
Lost = tuple[int, int, int]


def in_several(rows: list[Stretch], width: int = WIDTH) -> tuple[list[Stretch], list[Lost]]:
    """The stretches cut to windows whose hash several documents have, as the others are in no two documents.

    Those whose bytes also lie, whole, where a smaller document first has their first window are lost as they are.
    """
    sizes = np.array([len(b) for _, _, b in rows])
    at = np.cumsum(sizes) - sizes
    text = b"".join(b for _, _, b in rows)
    windows = np.maximum(sizes - width + 1, 0)
    row = np.repeat(np.arange(len(rows)), windows)
    place = np.repeat(at - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
    if not len(place):
        return [], []
    hashes, docs = Ranges(VALUES[np.frombuffer(text, np.uint8)]).of(place, place + width), np.array([d for d, _, _ in rows])
    order = np.lexsort((docs[row], hashes))
    first = np.flatnonzero(np.append(True, hashes[order[1:]] != hashes[order[:-1]]))
    size = np.diff(np.append(first, len(order)))
    least, last = order[first], order[first + size - 1]
    several = docs[row[least]] < docs[row[last]]
    kept, origin = np.empty(len(place), bool), np.empty(len(place), np.int64)
    kept[order], origin[order] = np.repeat(several, size), np.repeat(least, size)
    run = np.flatnonzero(kept)
    if not len(run):
        return [], []
    new = np.flatnonzero(np.append(True, (row[run[1:]] != row[run[:-1]]) | (run[1:] != run[:-1] + 1)))
    out, lost = [], []
    for w, o, n in zip(run[new].tolist(), origin[run[new]].tolist(), np.diff(np.append(new, len(run))).tolist()):
        r, p, f, q, length = row[w], place[w], row[o], place[o], n + width - 1
        doc, start, data = rows[r][0], int(rows[r][1] + p - at[r]), text[p:p + length]
        if rows[f][0] < doc and q + length <= at[f] + sizes[f] and text[q:q + length] == data:
            lost.append((doc, start, n))
        else:
            out.append((doc, start, data))
    return out, lost


def once(rows: list[Stretch], width: int = WIDTH) -> tuple[list[Stretch], list[Lost]]:
    """Stretches of equal bytes once, for their smallest document, and the runs of windows that the others lose by that."""
    least: dict[bytes, int] = {}
    for d, _, b in rows:
        least[b] = min(d, least.get(b, d))
    return [r for r in rows if r[0] == least[r[2]]], [(d, s, len(b) - width + 1) for d, s, b in rows if d > least[b]]


def repeated(rows: list[Stretch], width: int = WIDTH, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows (doc, start, n) lost among stretches (doc, start, bytes) of one shard.

    What no other document has and copies of whole stretches are left out of the text that is sorted.
    """
    rows, inside = in_several(rows, width)
    rows, copies = once(rows, width)
    whole_ = np.array([*inside, *copies], np.int64).reshape(-1, 3).T
    return merged(*map(np.concatenate, zip(sorted_out(rows, width, limit), whole_)))


def sorted_out(rows: list[tuple[int, int, bytes]], width: int, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows (doc, start, n) that the suffix array of the stretches shows in a smaller document."""
    if not rows:
        return (np.empty(0, np.int64),) * 3
    sizes = np.array([len(b) for _, _, b in rows])
    ends = np.cumsum(sizes + 1) - 1
    text = np.frombuffer(bytes([APART]).join(b for _, _, b in rows), np.uint8).astype(np.int64)
    order, shared = suffix_array(text, width, limit)
    row = np.searchsorted(ends, order, side="left")
    row = np.minimum(row, len(rows) - 1)
    room = ends[row] - order >= width
    doc = np.array([d for d, _, _ in rows])[row]
    group = np.cumsum(shared < width)
    order, row, doc, group = order[room], row[room], doc[room], group[room]
    if not len(order):
        return (np.empty(0, np.int64),) * 3
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    least = np.minimum.reduceat(doc, first)
    later = doc > np.repeat(least, np.diff(np.append(first, len(doc))))
    start = np.array([s for _, s, _ in rows])[row] + order - (ends[row] - sizes[row])
    return merged(doc[later], start[later], np.ones(int(later.sum()), np.int64))


def sharded(batches: Iterator[pa.RecordBatch], width: int, shard_bytes: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Rows (k, doc, start, data) sorted by k to lost runs, a shard of whole keys at a time."""
    def close() -> pa.RecordBatch:
        doc, start, n = repeated(held, width, limit)
        return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], names=["doc", "start", "n"])

    held: list[tuple[int, int, bytes]] = []
    size, key = 0, None
    for batch in batches:
        for k, d, s, data in zip(*[c.to_pylist() for c in batch.columns]):
            if k != key and size >= shard_bytes:
                yield close()
                held, size = [], 0
            held.append((d, s, data))
            size, key = size + len(data), k
    if held:
        yield close()


def remove_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, limit: int = LIMIT,
) -> DataFrame:
    """``key``, ``n_bytes``, ``n_removed``, ``n_spans`` (runs removed) and ``kept`` (binary) of every row.

    Bytes of the UTF-8 text in a string of ``width`` bytes that also starts in a row with a smaller
    key go; strings are judged on the input. Null texts are empty. Rows that share a key are one
    document's copies and share its text: neither is smaller. A row with a null key loses nothing and
    takes nothing from others.
    """
    rows = numbered(docs, key, text)
    texts = squeezed(rows)
    found = materialize(runs(rows.where(F.col("doc").isNotNull()), lambda d, t: find(d, t, width, gram)), "runs")

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], [], []]
            for d, z, asked in zip(*[c.to_pylist() for c in batch.columns]):
                data = unsqueezed(z)
                for r in asked:
                    out[0].append(r["k"])
                    out[1].append(d)
                    out[2].append(r["start"])
                    out[3].append(data[r["start"]:r["start"] + r["n"] + width - 1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.binary())], names=["k", "doc", "start", "data"])

    asked = found.where("open").groupBy("doc").agg(F.collect_list(F.struct("k", "start", "n")).alias("asked"))
    each = texts.join(asked, "doc").select("doc", "z", "asked").mapInArrow(stretches, "k long, doc long, start int, data binary")
    closer = each.repartition("k").sortWithinPartitions("k").mapInArrow(
        lambda it: sharded(it, width, shard_bytes, limit), "doc long, start int, n int")
    gone = by_document(found.where("not open").select("doc", "start", "n").unionByName(closer))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, removed, spans, kept = [], [], [], []
            for z, runs_ in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data = unsqueezed(z)
                n_bytes.append(len(data))
                if runs_:
                    lost = covered(np.array(runs_), len(data), width)
                    removed.append(int(lost.sum()))
                    spans.append(int((lost[1:] & ~lost[:-1]).sum() + lost[0]) if len(lost) else 0)
                    data = np.frombuffer(data, np.uint8)[~lost].tobytes()
                else:
                    removed.append(0)
                    spans.append(0)
                kept.append(data)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(x, pa.int64()) for x in (n_bytes, removed, spans)], pa.array(kept, pa.binary())],
                names=[key, "n_bytes", "n_removed", "n_spans", "kept"])

    return texts.join(gone, "doc", "left").select(F.col("doc").alias(key), "z", "runs").mapInArrow(
        keep, f"`{key}` long, n_bytes long, n_removed long, n_spans long, kept binary")
