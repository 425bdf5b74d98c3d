"""SimHash near-duplicates found through deletion-variant signatures.

A 64-bit fingerprint is cut into ``max_bits // 2 + 1`` segments: of two fingerprints that differ in
``max_bits`` bits or fewer, one segment differs in one bit at most. Each segment is indexed once for
each of its bits with that bit deleted; such fingerprints then share a (bit, rest of segment) key.
The keys are joined by equality (a shuffle and a sort by key) and the pairs under one key verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panel_engine.llm.text import components, cut

#: Fingerprints under one key that are compared with each other; larger groups are probed by bit flips.
PAIRWISE = 256


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Majority of the XXH64 bits (seed 42) of a text's word shingles; 0 without a word."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and the six ASCII blanks
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-shingle] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[s:e], 42) for s, e in zip(starts, ends[shingle - 1:].tolist())), "<u8", len(starts))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 15):
        part = h[i:i + (1 << 15)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """``key`` and ``fp`` (the fingerprint as a signed long) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=[key, "fp"])

    kind = docs.select(key).schema[0].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, fp long")


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        jumped = root[root]
        if np.array_equal(jumped, root) and np.array_equal(root[a], root[b]):
            return root
        root = jumped


def _links(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of ascending distinct fingerprints that differ in ``max_bits`` bits or fewer."""
    n, left, right = len(fps), [], []
    if n <= PAIRWISE:
        for d in range(1, n):
            hit = np.flatnonzero(np.bitwise_count(fps[d:] ^ fps[:-d]) <= max_bits)
            left.append(hit)
            right.append(hit + d)
    else:  # every flip of bits that vary here is looked up: linear in the group, nothing is left out
        varying = np.bitwise_or.reduce(fps ^ fps[0])
        bits = [np.uint64(1 << i) for i in range(64) if int(varying) >> i & 1]
        for k in range(1, max_bits + 1):
            for flip in combinations(bits, k):
                other = fps ^ np.bitwise_or.reduce(np.array(flip, np.uint64))
                up = np.flatnonzero(other > fps)
                at = np.searchsorted(fps, other[up])
                hit = fps[np.minimum(at, n - 1)] == other[up]
                left.append(up[hit])
                right.append(at[hit])
    return np.concatenate(left), np.concatenate(right)


def _edges(batches: Iterator[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp, rep) sorted by key and fp, to edges between the reps. A group of one key may
    span batches; of it only the distinct fingerprints and their ids are held, 16 bytes each, and
    a spanning forest of its links comes out, not all pairs.
    """
    def out(a, b) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    held_key = None

    def close() -> pa.RecordBatch | None:
        fps, reps = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(fps)
        fps, reps = fps[order], reps[order]
        if len(fps) < 2:
            return None
        a, b = _links(fps, max_bits)
        if not len(a):
            return None
        root = _forest(len(fps), a, b)
        child = np.flatnonzero(root != np.arange(len(fps)))
        return out(reps[child], reps[root[child]])

    for batch in batches:
        key = batch.column(0).to_numpy()
        fps = batch.column(1).to_numpy().view(np.uint64)
        reps = batch.column(2).to_numpy()
        if not len(key):
            continue
        starts = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))
        sizes = np.diff(starts)
        first, last = 0, len(sizes) - 1
        if held_key is not None:
            if key[0] == held_key:
                held.append((fps[:sizes[0]], reps[:sizes[0]]))
                first = 1
                if last == 0:
                    continue
            if (found := close()) is not None:
                yield found
        held, held_key = [(fps[starts[last]:], reps[starts[last]:])], key[-1]
        # whole groups inside the batch; a pair is mostly the whole group
        inner = np.arange(first, last)
        two = starts[inner[sizes[inner] == 2]]
        two = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= max_bits]
        if len(two):
            yield out(reps[two], reps[two + 1])
        for g in inner[sizes[inner] > 2]:
            s, e = starts[g], starts[g + 1]
            order = np.argsort(fps[s:e])
            a, b = _links(fps[s:e][order], max_bits)
            if len(a):
                root, ids = _forest(e - s, a, b), reps[s:e][order]
                child = np.flatnonzero(root != np.arange(e - s))
                yield out(ids[child], ids[root[child]])
    if held and (found := close()) is not None:
        yield found


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, max_bits: int = 2,
) -> DataFrame:
    """``key``, ``fp`` and ``component_id``, the smallest key reachable over links of ``max_bits`` bits.

    Rows with one fingerprint collapse to their smallest key before anything is indexed, so exact
    copies, however many, cost one entry. Null and empty texts have fingerprint zero and are linked
    like any other; a null key has no component of its own; repeated keys each get their row; other
    columns are ignored. An empty table gives an empty result.
    """
    segments = max_bits // 2 + 1
    bounds = [64 * i // segments for i in range(segments + 1)]
    fps = cut(fingerprints(docs, key, text, shingle))
    reps = cut(fps.groupBy("fp").agg(F.min(key).alias("rep")))

    # bit i of a segment is deleted; what is left of the segment, with i, is the key
    variants = [
        (i, (((1 << hi) - (1 << lo)) & ~(1 << i)), lo)
        for lo, hi in zip(bounds, bounds[1:]) for i in range(lo, hi)]

    def signed(x: int) -> int:
        return x - (1 << 64) if x >> 63 else x

    keys = F.array(*[
        F.struct(F.lit(i).cast("byte").alias("bit"), F.col("fp").bitwiseAND(F.lit(signed(mask))).alias("rest"))
        for i, mask, _ in variants])
    signed_rows = reps.where(F.col("rep").isNotNull()).select(F.explode(keys).alias("k"), "fp", "rep").select(
        F.xxhash64("k.bit", "k.rest").alias("k"), "fp", "rep")
    edges = (
        signed_rows.repartition("k").sortWithinPartitions("k")
        .mapInArrow(lambda it: _edges(it, max_bits), "a long, b long").distinct())
    found = components(edges).withColumnsRenamed({"node": "rep", "component": "__c"})
    by_fp = reps.join(found, "rep", "left").select("fp", F.coalesce("__c", "rep").alias("component_id"))
    return fps.join(by_fp, "fp", "left").select(key, "fp", "component_id")


def hexadecimal(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
