"""Approximate nearest neighbours by inner product: a forest of random-projection trees.

The trees are fitted on a bounded sample: each node splits at the middle of the hyperplane between two
of its vectors. Every vector is then put into its leaf of each tree. A query walks all trees through
one priority queue, the least doubtful branch first, until the leaves it has reached hold
``search`` index rows and k + 1 different vectors; their vectors are scored exactly and the best kept. How many that takes is measured:
a few queries are answered by brute force and their true neighbours looked up in the queue's order. For the walk only, vectors
get one more component that gives all the same norm, so that near means large inner product.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panel_engine.llm.text import cut

#: Vectors that the trees are fitted on, at most about; they bound the forest's size.
SAMPLE = 1 << 16
TREES, LEAF = 4, 128
#: Share of true neighbours aimed at, and the queries, at most, that it is measured on.
RECALL, PROBES = 0.97, 64
#: Index rows, over all trees, that one group of leaves holds on average; a cell holds twice as many at most, and as many queries as ``CELL_QUERIES``.
GROUP_ROWS, CELL_QUERIES = 20_000, 4096
#: Bytes of vectors, at most, in the sample and on each side of a cell.
SAMPLE_BYTES, CELL_BYTES = 1 << 28, 1 << 26
#: Products that a task computes at once.
PRODUCTS = 1 << 22


@dataclass
class Forest:
    normals: np.ndarray  # inner nodes x (dimensions + 1)
    offsets: np.ndarray
    children: np.ndarray  # inner nodes x 2: an inner node, or -1 - leaf
    roots: list[int]
    counts: np.ndarray  # vectors in each leaf: of the sample, then of the index
    tree: np.ndarray  # of each leaf
    top: float  # largest norm, to which vectors are filled up

    def filled(self, v: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.top ** 2 - (v ** 2).sum(axis=1), 0.0))
        return np.concatenate([v, rest[:, None]], axis=1)

    def leaves(self, v: np.ndarray) -> np.ndarray:
        """Leaf of each vector (rows) in each tree (columns)."""
        v, out = self.filled(v), np.empty((len(v), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            at = np.full(len(v), root)
            while len(open_ := np.flatnonzero(at >= 0)):
                node = at[open_]
                side = (np.einsum("ij,ij->i", v[open_], self.normals[node]) >= self.offsets[node]).astype(int)
                at[open_] = self.children[node, side]
            out[:, t] = -1 - at
        return out

    def walk(self, query: np.ndarray, search: float, least: int) -> list[int]:
        """Leaves in the order of the shared queue until they hold ``search`` index rows and ``least``
        different vectors, or all leaves. A vector has a row in each tree, so different ones are counted in one tree."""
        unit = np.append(query / np.linalg.norm(query) * self.top, 0.0)
        margins = (self.normals @ unit - self.offsets).tolist()
        heap = [(-np.inf, r) for r in self.roots]
        heapq.heapify(heap)
        found, held, in_tree = [], 0.0, [0.0] * len(self.roots)
        while heap and (held < search or max(in_tree) < least):
            doubt, at = heapq.heappop(heap)
            while at >= 0:
                m = margins[at]
                near, far = self.children[at, 1 if m >= 0 else 0], self.children[at, 0 if m >= 0 else 1]
                heapq.heappush(heap, (max(doubt, abs(m)), int(far)))
                at = int(near)
            leaf = -1 - at
            found.append(leaf)
            held += self.counts[leaf]
            in_tree[self.tree[leaf]] += self.counts[leaf]
        return found


def grow(sample: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = 1) -> Forest:
    """Forest over the sample. A node whose vectors cannot be told apart stays a leaf."""
    rng = np.random.default_rng(seed)
    top = float(np.sqrt((sample ** 2).sum(axis=1)).max(initial=0.0)) or 1.0
    forest = Forest(np.empty((0, 0)), np.empty(0), np.empty((0, 2), int), [], np.empty(0), np.empty(0, int), top)
    points = forest.filled(sample)
    normals, offsets, children, counts = [], [], [], []

    def node(rows: np.ndarray) -> int:
        if len(rows) > leaf:
            for _ in range(5):
                a, b = points[rng.choice(rows, 2, replace=False)]
                normal = a - b
                if (norm := np.linalg.norm(normal)) < 1e-12:
                    continue
                normal = normal / norm
                along = points[rows] @ normal
                offset = float(np.median(along))
                side = along >= offset
                if 0.1 < side.mean() < 0.9:
                    at = len(normals)
                    normals.append(normal)
                    offsets.append(offset)
                    children.append([0, 0])
                    children[at][0] = node(rows[~side])
                    children[at][1] = node(rows[side])
                    return at
        counts.append(len(rows))
        return -len(counts)

    tree: list[int] = []
    for t in range(trees):
        forest.roots.append(node(np.arange(len(sample))))
        tree += [t] * (len(counts) - len(tree))
    if normals:
        forest.normals, forest.offsets, forest.children = np.array(normals), np.array(offsets), np.array(children)
    else:
        forest.normals, forest.offsets, forest.children = np.zeros((1, sample.shape[1] + 1)), np.zeros(1), np.array([[-1, -1]])
    forest.counts, forest.tree = np.array(counts), np.array(tree)
    return forest


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``k`` and ``v`` (array<double>) of the vectors that take part: not null, not zero, finite, of the
    commonest length (the shorter of two as common). A null key takes no part either."""
    v = F.col(vector).cast("array<double>")
    sound = F.forall(v, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = vectors.select(F.col(key).alias("k"), v.alias("v")).where(F.col("k").isNotNull() & F.col("v").isNotNull())
    rows = rows.where(sound & F.exists("v", lambda x: x != 0))
    size = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    return rows.where(F.size("v") == (size.d if size else 0))


def brute(entries: DataFrame, queries: list[tuple[int, np.ndarray]], k: int) -> dict[int, np.ndarray]:
    """True ``k`` nearest vectors of a few queries, by one pass over all ``entries``."""
    q, own = np.stack([v for _, v in queries]), np.array([i for i, _ in queries])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = np.stack(batch.column(0).to_numpy(zero_copy_only=False))
            first = batch.column(1).to_numpy(zero_copy_only=False)
            scores = q @ v.T
            for i, row in enumerate(scores):
                best = np.argsort(-row, kind="stable")[:k + 1]
                best = [j for j in best if len(first[j]) > 1 or first[j][0] != own[i]][:k]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(best), own[i])), pa.array(row[best]), batch.column(0).take(pa.array(np.array(best, np.int64)))], names=["q", "s", "v"])

    found = entries.select("v", "ids").mapInArrow(run, "q long, s double, v array<double>")
    best = Window.partitionBy("q").orderBy(F.desc("s"))
    top = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).groupBy("q").agg(F.collect_list("v").alias("v")).collect()  # k each
    return {r.q: np.array(r.v) for r in top}


def search_needed(forest: Forest, entries: DataFrame, queries: list[tuple[int, np.ndarray]], k: int, recall: float) -> float:
    """Index rows to reach so that ``recall`` of the true neighbours of ``queries`` are among them."""
    needed: list[float] = []
    truth = brute(entries, queries, k)
    for i, v in queries:
        if i not in truth:
            continue
        order = forest.walk(v, float("inf"), 0)
        upto = np.full(len(forest.counts), np.inf)
        upto[order] = np.cumsum(forest.counts[order])
        needed += upto[forest.leaves(truth[i])].min(axis=1).tolist()
    return float(np.quantile(needed, recall, method="higher")) if needed else 1.0


def best_of(query: np.ndarray, vectors: np.ndarray, mark: np.ndarray, first: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and exact scores of the ``k`` + 1 best different vectors among ``rows``, ties to the smaller
    ``first`` key. ``mark`` is the same for rows of one vector."""
    rows = rows[np.unique(mark[rows], return_index=True)[1]]
    exact = (vectors[rows] * query).sum(axis=1)
    order = np.lexsort((first[rows], -exact))[:k + 1]
    return rows[order], exact[order]


def nearest(
    vectors: DataFrame, is_query, key: str = "vec_id", vector: str = "embedding", k: int = 20, trees: int = TREES, leaf: int = LEAF,
    recall: float = RECALL, sample: int = SAMPLE,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: ``k`` nearest found of each row for which ``is_query`` holds.

    Candidates are all other rows. Equal vectors are indexed once, with their ``k`` + 1 smallest keys,
    all that can be among a query's ``k`` nearest, so copies never fill a leaf. Rows that repeat a key
    with the same vector are one; a key with several vectors counts at its best score. Where fewer than
    ``k`` other vectors take part, all are returned. Vectors are told apart before anything is cut, and among those
    reached ties go to the smaller key.

    Leaves are dealt in buckets. A bucket with many vectors or many queries is split into cells, vectors by
    their hash and queries by theirs, so that a task holds a bounded block of either.
    """
    rows = cut(usable(vectors, key, vector).distinct())
    same = Window.partitionBy("v").orderBy("k")
    entries = cut(
        rows.withColumn("r", F.row_number().over(same)).where(F.col("r") <= k + 1)
        .groupBy("v").agg(F.sort_array(F.collect_list("k")).alias("ids"))
        .withColumn("e", F.xxhash64("v")))
    n = entries.count()
    schema = "query_id long, rank int, vec_id long, score double"
    spark = vectors.sparkSession
    if not n:
        return spark.createDataFrame([], schema)
    size = 8 * len(entries.first().v)
    sample = max(1, min(sample, SAMPLE_BYTES // size))
    drawn = entries.where(F.pmod("e", F.lit(1 << 30)) < min(1.0, sample / n) * (1 << 30)).select("v").limit(2 * sample).toPandas()
    points = np.stack(drawn["v"].to_numpy()) if len(drawn) else np.zeros((1, size // 8))
    forest = grow(points, trees, leaf)
    sampled = spark.sparkContext.broadcast(forest)  # bounded by sample x trees / leaf nodes

    def leaf_numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(len(sampled.value.counts), np.int64)
        for batch in batches:
            if batch.num_rows:
                held += np.bincount(sampled.value.leaves(np.stack(batch.column(0).to_numpy(zero_copy_only=False))).ravel(), minlength=len(held))
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(held)), pa.array(held[held > 0])], names=["leaf", "n"])

    per_leaf = entries.select("v").mapInArrow(leaf_numbers, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).collect()
    forest.counts = np.zeros(len(forest.counts))
    for r in per_leaf:
        forest.counts[r.leaf] = r.n
    group_rows = max(1, min(GROUP_ROWS, CELL_BYTES // (2 * size)))
    groups = int(min(len(forest.counts), max(spark.sparkContext.defaultParallelism, -(-n * trees // group_rows))))  # of leaves
    queries = rows.where(is_query(F.col("k"))).select(F.col("k").alias("q"), "v")
    tried = [(r.q, np.array(r.v)) for r in queries.orderBy(F.xxhash64("q")).limit(PROBES).collect()]
    search = search_needed(forest, entries, tried, k, recall) if tried else 1.0
    shared = spark.sparkContext.broadcast(forest)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            leaves = shared.value.leaves(np.stack(batch.column(0).to_numpy(zero_copy_only=False)))
            t = pa.array(np.repeat(np.arange(batch.num_rows), leaves.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(leaves.ravel()), *[c.take(t) for c in batch.columns]], names=["leaf", *batch.schema.names])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column(1).to_numpy(zero_copy_only=False)
            bucket, row, leaves = [], [], []
            for i, x in enumerate(v):
                found = np.array(shared.value.walk(x, search, k + 1))
                order = np.argsort(found % groups, kind="stable")
                numbers, first = np.unique(found[order] % groups, return_index=True)
                bucket += numbers.tolist()
                row += [i] * len(numbers)
                leaves += np.split(found[order], first[1:])
            t = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket, pa.int64()), batch.column(0).take(t), batch.column(1).take(t), pa.array(leaves, pa.list_(pa.int64()))],
                names=["bucket", "q", "v", "leaves"])

    def score(key_: tuple, asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, float]] = []
        if len(asked) and len(held):
            held_at = held.groupby("leaf").indices
            vectors_, ids = np.stack(held["v"].to_numpy()), held["ids"].to_numpy()
            first = np.array([i[0] for i in ids])
            mark = held.assign(first=first).groupby(["e", "first"]).ngroup().to_numpy()
            of = np.stack(asked["v"].to_numpy())
            # products of a matrix may differ from exact ones in the last bits
            slack = 1e-12 * np.sqrt((of ** 2).sum(axis=1) * (vectors_ ** 2).sum(axis=1).max())
            best: dict[int, np.ndarray] = {}  # of a query: rows that may be among its k + 1 best
            for at, part in asked.assign(at=np.arange(len(asked)))[["at", "leaves"]].explode("leaves").groupby("leaves"):
                rows_ = held_at.get(at)
                if rows_ is None:
                    continue
                m, all_q = min(k + 1, len(rows_)), part["at"].to_numpy(int)
                for q in np.split(all_q, range(0, len(all_q), max(1, PRODUCTS // len(rows_)))[1:]):
                    rough = of[q] @ vectors_[rows_].T
                    edge = np.partition(rough, len(rows_) - m, axis=1)[:, len(rows_) - m] - slack[q]
                    for i, row, e in zip(q, rough, edge):
                        r = rows_[row >= e]
                        if i in best:
                            r = np.concatenate([best[i], r])
                        best[i] = best_of(of[i], vectors_, mark, first, r, k)[0] if len(r) > 64 * (k + 1) else r
            asker = asked["q"].to_numpy()
            for i, r in best.items():
                found = zip(*best_of(of[i], vectors_, mark, first, r, k))
                near = sorted((-s, key) for j, s in found for key in ids[j] if key != asker[i])[:k]
                out += [(asker[i], key, -s) for s, key in near]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    asked = cut(queries.repartition(spark.sparkContext.defaultParallelism).mapInArrow(
        probe, "bucket long, q long, v array<double>, leaves array<long>"))
    in_bucket = np.bincount(np.arange(len(forest.counts)) % groups, forest.counts, minlength=groups)
    block = max(1, min(CELL_QUERIES, CELL_BYTES // size))
    split = [(r.bucket, int(max(1, -(-in_bucket[r.bucket] // (2 * group_rows)))), -(-r["count"] // block))
             for r in asked.groupBy("bucket").count().collect()]  # at most one for each leaf
    split = F.broadcast(spark.createDataFrame(split, "bucket long, nv long, nq long"))
    cell = ["bucket", "vb", "qb"]
    placed = (
        entries.mapInArrow(place, "leaf long, v array<double>, ids array<long>, e long")
        .withColumn("bucket", F.col("leaf") % groups).join(split, "bucket")
        .select("leaf", "v", "ids", "e", "bucket", F.expr("pmod(xxhash64(e), nv)").alias("vb"), F.expr("explode(sequence(0L, nq - 1))").alias("qb")))
    asked = asked.join(split, "bucket").select(
        "q", "v", "leaves", "bucket", F.expr("explode(sequence(0L, nv - 1))").alias("vb"), F.expr("pmod(xxhash64(q), nq)").alias("qb"))
    found = asked.groupBy(*cell).cogroup(placed.groupBy(*cell)).applyInPandas(score, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
