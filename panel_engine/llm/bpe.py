"""Byte-level BPE encoding of whole texts in overlapping chunks, and decoding.

A text longer than ``chunk`` is cut into chunks that reach ``overlap`` code points into the next one.
All chunks are pre-tokenised in parallel. Where two neighbours name a common boundary inside the
overlap they have resynchronised: a match depends on what follows its start only, so from there on both
cut alike, and the text is stitched at the first such boundary. Neighbours that never agree
there (one run of blanks or letters fills the overlap) are joined into one longer chunk and pre-tokenised anew, alone,
until every chunk of a text meets the one after it.
Pieces are then encoded in parallel. Texts of one chunk are never shuffled.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panel_engine.llm.text import cut, whole

CHUNK, OVERLAP = 1 << 15, 1 << 9
#: Distinct pre-tokens remembered by a task; the memory starts anew beyond it.
REMEMBERED = 1 << 18


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the adjacent pair of lowest rank, leftmost first, merges until none is ranked.

    A heap of candidate pairs over a linked list of parts: n log n for a pre-token of n bytes.
    """
    if (whole_id := ranks.get(piece)) is not None:
        return [whole_id]
    n = len(piece)
    end = list(range(1, n + 1))  # end[i]: where the part that starts at i ends; 0 when it is merged away
    prev = list(range(-1, n))

    def rank(i: int) -> int | None:
        j = end[i]
        return ranks.get(piece[i:end[j]]) if j < n else None

    heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(i)) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not j or j >= n or end[j] != stop:
            continue  # one of the two parts has changed meanwhile
        end[i], end[j] = stop, 0
        if stop < n:
            prev[stop] = i
            if (r := rank(i)) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (p := prev[i]) >= 0 and (r := rank(p)) is not None:
            heapq.heappush(heap, (r, p, stop))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i:end[i]]])
        i = end[i]
    return ids


class Encoder:
    """Encodes a text pre-token by pre-token, remembering the ids of those seen, as packed integers."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern, self.find = ranks, pattern, regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    def packed(self, text: str) -> bytes:
        known, ranks = self.known, self.ranks
        if len(known) > REMEMBERED:
            known.clear()
        tokens = self.find(text)
        for token in set(tokens).difference(known):
            known[token] = array("i", merge(token.encode(), ranks)).tobytes()
        return b"".join(map(known.__getitem__, tokens))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()


_KEPT: list[Encoder] = []


def kept_encoder(ranks: dict[bytes, int], pattern: str) -> Encoder:
    """The Python worker's encoder, kept from task to task while the vocabulary stays."""
    if not _KEPT or _KEPT[0].ranks is not ranks or _KEPT[0].pattern != pattern:
        _KEPT[:] = [Encoder(ranks, pattern)]
    return _KEPT[0]


def pieces(
    docs: DataFrame, pattern: str, key: str = "doc_id", text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP,
) -> DataFrame:
    """``key``, ``part``, ``piece``: pieces that concatenate to the text and can be pre-tokenised apart.

    ``key`` is unique and not null, ``text`` not null. ``pattern`` may look ahead, not behind.
    """
    n = F.ceil((F.length(text)) / chunk).cast("int")
    chunks = docs.select(key, text, F.explode(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)).alias("part")).select(
        key, "part", F.lit(1).alias("span"), F.col(text).substr(F.col("part") * chunk + 1, F.lit(chunk + overlap)).alias("piece"))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern).finditer
        for batch in batches:
            heads, tails = [], []
            for span, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                starts = [m.start() for m in find(t)]
                heads.append([s for s in starts if s < overlap])
                # the chunk's end may have cut its last matches short
                tails.append([s - span * chunk for s in starts[:-2] if s >= span * chunk])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(heads, pa.list_(pa.int32())), pa.array(tails, pa.list_(pa.int32()))],
                names=[*batch.schema.names, "head", "tail"])

    kind = docs.select(key).schema[0].dataType.simpleString()
    fields = f"`{key}` {kind}, part int, span int, piece string, head array<int>, tail array<int>"
    in_order = Window.partitionBy(key).orderBy("part")
    # where a chunk takes over from the one before, counted from its start. A text's first chunk is cut right; so is each that
    # meets a chunk which is, from there on
    meets = F.when(F.col("part") == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect(F.lag("tail").over(in_order), "head")))
    marked = cut(chunks.mapInArrow(ends, fields))
    while True:
        places = cut(marked.select(key, "part", meets.alias("meets"))).withColumn("group", F.count("meets").over(in_order))
        lost = places.where(F.col("meets").isNull()).select(key, "group").distinct()
        if lost.isEmpty():
            break
        together = marked.join(places.join(lost, [key, "group"]).select(key, "part", "group"), [key, "part"])
        last = Window.partitionBy(key, "group")
        own = F.when(F.col("part") == F.max("part").over(last), F.col("piece")).otherwise(F.col("piece").substr(F.lit(1), F.col("span") * chunk))
        longer = together.withColumn("piece", own).groupBy(key, "group").agg(
            F.min("part").alias("part"), F.sum("span").cast("int").alias("span"), F.sort_array(F.collect_list(F.struct("part", "piece"))).alias("p"),
        ).select(key, "part", "span", F.array_join("p.piece", "").alias("piece"))
        untouched = marked.join(together.select(key, "part"), [key, "part"], "left_anti")
        marked = cut(untouched.select(*marked.columns).unionByName(longer.mapInArrow(ends, fields)))
    stitched = marked.withColumn("take", meets).withColumn("until", F.lead("take").over(in_order))
    return stitched.select(key, "part", F.col("piece").substr(
        F.col("take") + 1, F.col("span") * chunk + F.coalesce("until", F.lit(0)) - F.col("take")).alias("piece"))


def encode(
    docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", ids: str = "ids",
    chunk: int = CHUNK, overlap: int = OVERLAP,
) -> DataFrame:
    """``docs`` with ``ids``, the token ids of the whole text; special tokens are ordinary text.

    A null text is an empty one and has no ids. Rows may repeat and keys may be null: long texts are
    tracked by a row number of their own. ``ids`` replaces a column of that name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # the vocabulary: fixed, some 50,000 entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = kept_encoder(shared.value, pattern)
        for batch in batches:
            at = batch.schema.get_field_index("__text")
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                packed = [own.packed(t) for t in part.column(at).to_pylist()]
                offsets = np.cumsum([0, *[len(p) // 4 for p in packed]], dtype=np.int32)
                got = pa.ListArray.from_arrays(offsets, np.frombuffer(b"".join(packed), np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*[c for k, c in enumerate(part.columns) if k != at], got],
                    names=[*[n for n in part.schema.names if n != "__text"], ids])

    others = [c for c in docs.columns if c != ids]
    source = docs.select(*others, whole(text).alias("__text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*others).schema]
    short = source.where(F.length("__text") <= chunk).mapInArrow(run, ", ".join([*fields, f"`{ids}` array<int>"]))
    long = cut(source.where(F.length("__text") > chunk).withColumn("__row", F.expr("uuid()")))
    parts = pieces(long.select("__row", "__text"), pattern, "__row", "__text", chunk, overlap)
    coded = parts.withColumnRenamed("piece", "__text").mapInArrow(run, f"`__row` string, part int, `{ids}` array<int>")
    whole_ids = coded.groupBy("__row").agg(F.sort_array(F.collect_list(F.struct("part", ids))).alias("p")).select(
        "__row", F.flatten(F.col(f"p.{ids}")).alias(ids))
    return short.unionByName(long.drop("__text").join(whole_ids, "__row").select(*others, ids))


def decode(df: DataFrame, ranks: dict[bytes, int], ids: str = "ids", data: str = "data") -> DataFrame:
    """``df`` with ``data``: the raw bytes of the ids, concatenated. Null ids give null."""
    shared = df.sparkSession.sparkContext.broadcast({i: token for token, i in ranks.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = shared.value.__getitem__
        for batch in batches:
            at = batch.schema.get_field_index(ids)
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                flat = list(map(token, part.column(at).flatten().to_numpy().tolist()))  # of rows that are not null
                sizes = pc.fill_null(pc.list_value_length(part.column(at)), -1).to_pylist()
                got, done = [], 0
                for n in sizes:
                    got.append(None if n < 0 else b"".join(flat[done:done + n]))
                    done += max(n, 0)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.binary())], names=[*part.schema.names, data])

    df = df.drop(data)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema]
    return df.mapInArrow(run, ", ".join([*fields, f"`{data}` binary"]))


def digest(ids: str = "ids") -> Column:
    """SHA-256 of the decimal ids joined by one space."""
    return F.sha2(F.array_join(F.col(ids).cast("array<string>"), " "), 256)
