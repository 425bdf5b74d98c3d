"""Groups of documents whose word shingles have a Jaccard similarity of ``LEAST`` or more, through SimHash.

One 64-bit fingerprint of a pair at 0.8 differs in some ten bits, too many for one deletion-variant index. So
each document gets ``PRINTS`` independent fingerprints of its set of shingles, and each is cut into three
segments, indexed once for each bit with that bit deleted: documents with a segment that differs in one bit
at most share a key. Of those, pairs whose first fingerprints differ in ``FAR`` bits or fewer are
candidates, and a candidate links if the sets of shingles themselves are alike, which is computed from the texts.

Near copies share many keys, and would give pairs by the square. So a first round compares each document with its
least and its greatest candidate below it, two pairs a document at most. Keys with many candidate pairs a member
give none: members that candidates connect there are of one family. Families meet block by block, and a task compares all texts of
two blocks through a matrix of their shingles and returns a spanning forest of its links. A second round indexes the documents
that have candidates again, with their groups and families, and takes every candidate pair in which both differ, so that no candidate is skipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panel_engine.llm.repeats import LEAST_SLICES, SLICES_PER_PARTITION, U, mixed
from panel_engine.llm.simhash import _forest
from panel_engine.llm.text import components, whole
from panel_engine.sources.scratch import materialize

#: Independent fingerprints; differing bits of the first one that a candidate may have.
PRINTS, FAR = 6, 17
#: Least Jaccard similarity of a link, as a fraction.
LEAST = (4, 5)
BOUNDS = [0, 21, 42, 64]
#: Documents that are indexed at once; members of a key that are compared with each other at once, pairs per member above which they are a family.
BUNDLE, PAIRWISE, PER_MEMBER = 1 << 10, 256, 8
#: Members of a family's block, about; shingles that two blocks are compared by at once.
BLOCK, SHINGLES = 256, 1 << 13
SALTS = mixed(np.arange(1, PRINTS + 1).astype(U) * U(0xD6E8FEB86659FD93))
BIT_SALTS = mixed(np.arange(1, 64 * PRINTS + 1).astype(U) * U(0x9FB21C651E98DF25)).reshape(PRINTS, 64)


def shingles(data: bytes, shingle: int) -> np.ndarray:
    """Ascending distinct XXH64 (seed 42) of a text's word shingles; the whole text if it has fewer words."""
    words = data.lower().split()  # bytes: A-Z only, and the six ASCII blanks
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], U)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-shingle] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[s:e], 42) for s, e in zip(starts, ends[shingle - 1:].tolist())), U, len(starts)))


def prints(hashes: np.ndarray) -> np.ndarray:
    """``PRINTS`` independent majority fingerprints of a set of hashes."""
    out = np.empty(PRINTS, U)
    for p, salt in enumerate(SALTS):
        ones = np.zeros(64, np.int64)
        for i in range(0, len(hashes), 1 << 15):
            part = mixed(hashes[i:i + (1 << 15)] ^ salt).view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[p] = np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0]
    return out


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of hashes have the least similarity, exactly."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return LEAST[1] * both >= LEAST[0] * (len(a) + len(b) - both)


def _indexed(batches: Iterator[pa.RecordBatch], slices: int) -> Iterator[pa.RecordBatch]:
    """Rows (node, prints, group, family) to rows (slice, packed entries): key, first fingerprint, node, group and family of each variant."""
    for batch in batches:
        for at in range(0, batch.num_rows, BUNDLE):
            part = batch.slice(at, BUNDLE)
            node = part.column(0).to_numpy()
            fps = np.frombuffer(b"".join(part.column(1).to_pylist()), U).reshape(-1, PRINTS)
            group, family = part.column(2).to_numpy(), part.column(3).to_numpy()
            keys = np.empty((len(node), PRINTS * 64), U)
            for p in range(PRINTS):
                for lo, hi in zip(BOUNDS, BOUNDS[1:]):
                    for bit in range(lo, hi):
                        rest = fps[:, p] & U(((1 << hi) - (1 << lo)) & ~(1 << bit))
                        keys[:, 64 * p + bit] = mixed(rest ^ BIT_SALTS[p, bit])
            keys = keys.ravel()
            row = np.repeat(np.arange(len(node)), PRINTS * 64)
            slice_ = (keys % U(slices)).astype(np.int32)
            order = np.argsort(slice_, kind="stable")
            cuts = np.searchsorted(slice_[order], np.arange(slices + 1))
            short, row = (keys >> U(32)).astype("<u4")[order], row[order]
            number = np.flatnonzero(np.diff(cuts))
            rows = []
            for s in number:
                i, j = cuts[s], cuts[s + 1]
                r = row[i:j]
                rows.append(zstandard.compress(short[i:j].tobytes() + fps[r, 0].tobytes() + b"".join(
                    np.diff(x[r], prepend=0).astype("<i8").tobytes() for x in (node, group, family)), 1))
            yield pa.RecordBatch.from_arrays([pa.array(number.astype(np.int32)), pa.array(rows, pa.binary())], names=["slice", "packed"])


ASKED, PAIRS = "node long, low long, high long, lead long", "a long, b long"
NONE = np.iinfo(np.int64).max


def near(key: np.ndarray, fp: np.ndarray, start: np.ndarray, size: np.ndarray, others: tuple[np.ndarray, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of entries with one key and near fingerprints, for keys of up to ``PAIRWISE`` entries; ``others`` must all differ."""
    group = np.repeat(np.arange(len(start)), size)
    alive = np.flatnonzero(size[group] <= PAIRWISE)
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for d in range(1, int(size[size <= PAIRWISE].max(initial=1))):
        alive = alive[alive + d < len(key)]
        alive = alive[group[alive] == group[alive + d]]
        hit = alive
        for other in others:
            hit = hit[other[hit] != other[hit + d]]
        hit = hit[np.bitwise_count(fp[hit] ^ fp[hit + d]) <= FAR]
        left.append(hit)
        right.append(hit + d)
    return np.concatenate(left), np.concatenate(right)


def leads(fp: np.ndarray) -> np.ndarray:
    """For each fingerprint the first one that near fingerprints connect it with; each is compared with those not met yet."""
    lead, left, first = np.arange(len(fp)), np.arange(len(fp)), 0
    while len(left):
        first, left = left[0], left[1:]
        queue = [first]
        while queue and len(left):
            close = np.bitwise_count(fp[left] ^ fp[queue.pop()]) <= FAR
            lead[left[close]] = first
            queue.extend(left[close].tolist())
            left = left[~close]
    return lead


def grouped(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """All arrays in the order of key, then the last of ``values``; starts and sizes of the keys."""
    order = np.lexsort((values[-1], key))
    key = key[order]
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key, *[v[order] for v in values], start, np.diff(np.append(start, len(key)))


def asked(key: np.ndarray, fp: np.ndarray, node: np.ndarray, *_: np.ndarray) -> pa.RecordBatch:
    """Of one slice, nodes that have candidates, each with the least and the greatest one below it and the first node of its family here."""
    key, fp, node, start, size = grouped(key, fp, node)
    left, right = near(key, fp, start, size)
    group = np.repeat(np.arange(len(start)), size)
    crowded = (size > PAIRWISE) | (np.bincount(group[left], minlength=len(size)) > PER_MEMBER * size)
    few = ~crowded[group[left]]
    left, right = node[left[few]], node[right[few]]
    stars = [np.empty((2, 0), np.int64)]
    for g in np.flatnonzero(crowded):
        part = slice(start[g], start[g] + size[g])
        lead = leads(fp[part])
        met = np.isin(lead, lead[lead != np.arange(len(lead))])  # those that candidates connect
        stars.append(np.stack([node[part][met], node[part][lead[met]]]))
    stars = np.concatenate(stars, axis=1)
    names, at = np.unique(np.concatenate([left, right, *stars]), return_inverse=True)
    low, high = np.full(len(names), NONE), np.full(len(names), -1)
    of = at[len(left):2 * len(left)]
    np.minimum.at(low, of, left)
    np.maximum.at(high, of, left)
    lead = _forest(len(names), *at[2 * len(left):].reshape(2, -1))
    none, own = high < 0, lead == np.arange(len(names))
    return pa.RecordBatch.from_arrays(
        [pa.array(names, pa.int64()), pa.array(low, pa.int64(), mask=none), pa.array(high, pa.int64(), mask=none), pa.array(names[lead], pa.int64(), mask=own)],
        names=["node", "low", "high", "lead"])


def crossing(key: np.ndarray, fp: np.ndarray, node: np.ndarray, group: np.ndarray, family: np.ndarray) -> pa.RecordBatch:
    """Of one slice, candidate pairs between different groups and families; a key of very many is a family."""
    key, fp, group, family, node, start, size = grouped(key, fp, group, family, node)
    left, right = near(key, fp, start, size, (group, family))
    pairs = np.unique(np.stack([node[left], node[right]]), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(pairs[0], pa.int64()), pa.array(pairs[1], pa.int64())], names=["a", "b"])


def _by_slice(batches: Iterator[pa.RecordBatch], of) -> Iterator[pa.RecordBatch]:
    """Packed entries sorted by slice to what ``of`` makes of each slice."""
    def close() -> pa.RecordBatch:
        parts = []
        for z in held:
            data = zstandard.decompress(z)
            n = len(data) // 36
            parts.append((np.frombuffer(data, "<u4", n), np.frombuffer(data, U, n, 4 * n), *[np.cumsum(np.frombuffer(data, "<i8", n, at * n)) for at in (12, 20, 28)]))
        return of(*[np.concatenate(x) for x in zip(*parts)])

    number, held = None, []
    for batch in batches:
        for s, z in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if s != number and held:
                yield close()
                held = []
            number = s
            held.append(z)
    if held:
        yield close()


def matches(sets: list[np.ndarray]) -> np.ndarray:
    """Which pairs of different sets are alike, as a square matrix, exactly: shared hashes are counted ``SHINGLES`` at a time."""
    sizes = np.array([len(x) for x in sets])
    hashes, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = times[at] > 1
    row, at = row[shared], (np.cumsum(times > 1) - 1)[at[shared]]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    both = np.zeros((len(sets), len(sets)), np.int64)
    for low in range(0, int((times > 1).sum()), SHINGLES):
        i, j = np.searchsorted(at, (low, low + SHINGLES))
        has = np.zeros((len(sets), SHINGLES), np.float32)
        has[row[i:j], at[i:j] - low] = 1
        both += (has @ has.T).astype(np.int64)
    return LEAST[1] * both >= LEAST[0] * (sizes[:, None] + sizes - both)


def within(families: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """Links (a, b) that connect what is alike in a family: ``families`` has node and component, ``texts`` node and z."""
    kin = ["component", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close() -> pa.RecordBatch:
            node, block = np.array([r[0] for r in held]), np.array([r[1] for r in held])
            alike_ = matches([shingles(zstandard.decompress(z), shingle) for _, _, z in held])
            if now[1] != now[2]:  # pairs of one block meet by themselves
                alike_ &= block[:, None] != block
            a, b = np.nonzero(np.triu(alike_, 1))
            root = _forest(len(node), a, b)
            child = np.flatnonzero(root != np.arange(len(node)))
            return pa.RecordBatch.from_arrays([pa.array(node[root[child]], pa.int64()), pa.array(node[child], pa.int64())], names=["a", "b"])

        now, held = None, []
        for batch in batches:
            for *of, node, block, z in zip(*[c.to_pylist() for c in batch.columns]):
                if of != now and held:
                    yield close()
                    held = []
                now = of
                held.append((node, block, z))
        if held:
            yield close()

    counts = families.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    dealt = families.join(counts, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))).join(texts, "node")
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = met.select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "block", "z")
    return met.repartition(*kin).sortWithinPartitions(*kin).mapInArrow(run, PAIRS)


def verified(pairs: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """Pairs (a, b) of nodes whose texts (node, z) are alike."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, np.ndarray] = {}

        def of(z: bytes) -> np.ndarray:
            if z not in known:
                if len(known) >= 64:
                    known.pop(next(iter(known)))
                known[z] = shingles(zstandard.decompress(z), shingle)
            return known[z]

        for batch in batches:
            yes = [alike(of(x), of(y)) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(yes, pa.bool_()))

    left = texts.select(F.col("node").alias("a"), F.col("z").alias("za"))
    right = texts.select(F.col("node").alias("b"), F.col("z").alias("zb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "za", "zb").mapInArrow(run, "a long, b long")


def groups(docs: DataFrame, key: str = "row", text: str = "text", shingle: int = 5) -> DataFrame:
    """``key`` and ``component`` of every row; rows of one component are linked, over others perhaps, by texts that are alike.

    Rows with one set of shingles are one node, however many. Null texts are empty; texts without a word are alike.
    A component's number means nothing but itself.
    """
    spark = docs.sparkSession
    slices = max(LEAST_SLICES, SLICES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")))
    kind = docs.select(key).schema[0].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                sets = [shingles(t.encode(), shingle) for t in part.column(1).to_pylist()]
                sig = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], U)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sig.view(np.int64)), pa.array([prints(s).tobytes() for s in sets], pa.binary())], names=[key, "sig", "prints"])

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pack.compress(t.encode()) for t in batch.column(1).to_pylist()], pa.binary())], names=["node", "z"])

    signed = materialize(docs.select(key, whole(text).alias("text")).mapInArrow(sign, f"`{key}` {kind}, sig long, prints binary"), "prints")
    nodes = materialize(
        signed.groupBy("sig").agg(F.first("prints").alias("prints"), F.min(key).alias("sample")).withColumn("node", F.monotonically_increasing_id()), "nodes")

    def slices_of(rows: DataFrame, of, schema: str) -> DataFrame:
        """What ``of`` makes of the index of ``rows`` (node, prints, group, family), slice by slice."""
        index = rows.mapInArrow(lambda it: _indexed(it, slices), "slice int, packed binary")
        return index.repartition("slice").sortWithinPartitions("slice").mapInArrow(lambda it: _by_slice(it, of), schema)

    zero = F.lit(0).cast("long")
    asks = materialize(slices_of(nodes.select("node", "prints", zero.alias("group"), zero.alias("family")), asked, ASKED), "asks")
    first = materialize(asks.groupBy("node").agg(F.min("low").alias("low"), F.max("high").alias("high")), "candidates")
    families = components(asks.where("lead is not null"), "node", "lead")

    def texts(wanted: DataFrame) -> DataFrame:
        asked_ = wanted.join(nodes.select("node", "sample"), "node")
        rows = docs.select(F.col(key).alias("sample"), whole(text).alias("text")).join(asked_, "sample").select("node", "text")
        return materialize(rows.mapInArrow(squeeze, "node long, z binary").dropDuplicates(["node"]), "texts")

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()

    lows = first.where("low is not null").select(F.col("low").alias("a"), F.col("node").alias("b"))
    highs = first.where("low < high").select(F.col("high").alias("a"), F.col("node").alias("b"))
    pairs = materialize(lows.unionByName(highs), "pairs")
    held = texts(ends(pairs).unionByName(families.select("node")).distinct())
    links = materialize(verified(pairs, held, shingle).unionByName(within(families, held, shingle)), "links")
    linked = components(links)
    # nodes without a family have one of their own, below zero
    family = F.coalesce("family", -1 - F.col("node")).alias("family")
    placed = nodes.join(first.select("node"), "node").join(linked, "node", "left").join(families.withColumnRenamed("component", "family"), "node", "left").select(
        "node", "prints", F.coalesce("component", "node").alias("group"), family)
    more = slices_of(placed, crossing, PAIRS).distinct().join(pairs, ["a", "b"], "left_anti")
    more = materialize(more, "pairs")
    if not more.isEmpty():
        # groups are single nodes from here on: only what lies between them is linked anew
        found = verified(more, texts(ends(more)), shingle)
        for end in "ab":
            found = found.join(linked.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}")), end, "left")
        joined = components(found.select(*[F.coalesce(f"of_{end}", end).alias(end) for end in "ab"])).select(
            F.col("node").alias("component"), F.col("component").alias("whole"))
        every = placed.select("node", F.col("group").alias("component"))
        linked = every.join(joined, "component", "left").select("node", F.coalesce("whole", "component").alias("component"))
    by_sig = nodes.join(linked, "node", "left").select("sig", F.coalesce("component", "node").alias("component"))
    return signed.select(key, "sig").join(by_sig, "sig").select(key, "component")
