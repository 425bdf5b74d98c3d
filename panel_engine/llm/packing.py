"""Sum-of-squares packing of token sequences.

A piece goes to the open bin, or to a new one, after which the sum over gaps of the squared number of open bins
with that gap is smallest; ties go to the bin with the smallest gap, before a new one. Shards of pieces, dealt by
a hash, are packed apart, the longest piece first. Bins that a round leaves open are dissolved and their pieces
dealt to fewer shards, so that what shards lack is filled from each other; the last round keeps its open bins.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panel_engine.llm.text import cut
from panel_engine.sources.scratch import materialize

#: Pieces in a shard on average; distinct words a worker remembers before it starts anew.
SHARD_PIECES, REMEMBERED = 1 << 14, 1 << 20
#: A sequence's number: round, shard and bin in so many bits. Round 0 is the pieces that fill a sequence alone.
SHARD_BITS, BIN_BITS = 32, 24


class WordEncoder:
    """Ids of whole texts, word by word, each distinct word encoded once.

    Blanks separate words for this tokenizer and are dropped, so a text's ids are those of its words in
    turn. New words are encoded together, a mark between each two, and told apart by the mark's id, which words
    without the mark cannot have. The strings of special tokens are ordinary text.
    """

    MARK = "|"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores
        self.path, self.tokenizer = path, Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.known: dict[bytes, bytes] = {}
        self.mark = self._ids([self.MARK])[0]

    def _ids(self, words: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _learn(self, words: list[bytes]) -> None:
        mark = self.MARK.encode()
        plain = [w for w in words if mark not in w]
        marked = [w for w in words if mark in w]
        for i in range(0, len(plain), 2048):
            part = plain[i:i + 2048]
            ids = self._ids([f" {self.MARK} ".join(w.decode() for w in part)])[0]
            data = ids.tobytes()
            cuts = [-1, *np.flatnonzero(ids == self.mark).tolist(), len(ids)] if len(self.mark) == 1 else []
            if len(cuts) != len(part) + 1:  # this vocabulary has no such mark
                marked += part
                continue
            self.known.update(zip(part, [data[4 * a + 4:4 * b] for a, b in zip(cuts, cuts[1:])]))
        self.known.update(zip(marked, [ids.tobytes() for ids in self._ids([w.decode() for w in marked])]))

    def packed(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        split = [t.split() for t in texts]  # bytes split at space and \\x09 to \\x0D only
        if len(self.known) > REMEMBERED:
            self.known.clear()
        self._learn(list(set().union(*split).difference(self.known)))
        return [b"".join(map(self.known.__getitem__, words)) for words in split]


_KEPT: list[WordEncoder] = []


def kept_encoder(path: str) -> WordEncoder:
    """The Python worker's encoder, kept from task to task."""
    if not _KEPT or _KEPT[0].path != path:
        _KEPT[:] = [WordEncoder(path)]
    return _KEPT[0]


def pieces(
    docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", size: int = 2048, separator: int = 0, keep_ids: bool = True,
) -> DataFrame:
    """``key``, ``piece``, ``start``, ``length``, ``ids_crc32`` and, unless refused, ``ids``.

    A document is its text's ids and the separator, cut every ``size`` ids, so every row has a piece.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = kept_encoder(tokenizer)
        end = np.array([separator], "<u4").tobytes()
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                coded = [c + end for c in own.packed(part.column(1).to_pylist())]
                row, number, data = [], [], []
                for k, ids in enumerate(coded):
                    for at in range(0, len(ids), 4 * size):
                        row.append(k)
                        number.append(at // (4 * size))
                        data.append(ids[at:at + 4 * size])
                number = np.array(number)
                out = [part.column(0).take(pa.array(row)), pa.array(number, pa.int32()), pa.array(number * size, pa.int64()),
                       pa.array([len(d) // 4 for d in data], pa.int64()), pa.array(list(map(zlib.crc32, data)), pa.int64())]
                if keep_ids:
                    offsets = np.cumsum([0, *[len(d) // 4 for d in data]], dtype=np.int32)
                    out.append(pa.ListArray.from_arrays(offsets, np.frombuffer(b"".join(data), "<u4").astype(np.int32)))
                yield pa.RecordBatch.from_arrays(out, names=[f"c{j}" for j in range(len(out))])

    kind = docs.select(key).schema[0].dataType.simpleString()
    schema = "c0 " + kind + ", c1 int, c2 long, c3 long, c4 long" + (", c5 array<int>" if keep_ids else "")
    coded = docs.select(F.col(key), F.coalesce(F.col(text).cast("binary"), F.lit(b""))).mapInArrow(run, schema)
    return coded.toDF(key, "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else []))


def sum_of_squares(lengths: list[int], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each piece in turn, and each bin's gap in the end. Pieces are shorter than ``size``."""
    count = np.zeros(size + 1, np.int64)  # open bins by gap; a full bin has none and does not count
    open_bins: list[list[int]] = [[] for _ in range(size + 1)]
    bins, offsets, gaps = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    for i, n in enumerate(lengths):
        here = count[n:size]
        # change of the sum: one bin less with gap g, one more with gap g - n
        change = 2 * (count[:size - n] - here) + 2
        change[0] = 1 - 2 * here[0]
        change[here == 0] = np.iinfo(np.int64).max
        best = int(change.argmin())
        if here[best] and change[best] <= 2 * count[size - n] + 1:
            gap = n + best
            b = open_bins[gap].pop()
            count[gap] -= 1
        else:
            gap, b = size, len(gaps)
            gaps.append(size)
        bins[i], offsets[i] = b, size - gap
        gaps[b] = gap - n
        if gap > n:
            count[gap - n] += 1
            open_bins[gap - n].append(b)
    return bins, offsets, np.array(gaps, np.int64)


def _pack_shards(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows (shard, length, row) by shard, longest first, to (row, length, shard, bin, offset, gap)."""
    held: list[tuple[np.ndarray, ...]] = []

    def close() -> pa.RecordBatch:
        shard, length, row = (np.concatenate(x) for x in zip(*held))
        held.clear()
        bins, offsets, gaps = sum_of_squares(length.tolist(), size)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (row, length, shard, bins, offsets, gaps[bins])], names=["row", "length", "shard", "bin", "offset", "gap"])

    for batch in batches:
        columns = [c.to_numpy() for c in batch.columns]
        edges = [0, *(np.flatnonzero(np.diff(columns[0])) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if a < b:
                if held and held[-1][0][0] != columns[0][a]:
                    yield close()
                held.append(tuple(c[a:b] for c in columns))
    if held:
        yield close()


def place(lengths: DataFrame, size: int = 2048, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """``row``, ``sequence_id``, ``offset`` for rows ``row`` (a unique long), ``length`` (1 to ``size``).

    A round ends with bins that are full, and keeps them. Rounds go on until one shard holds all that is
    open, or while they at least halve the pieces in open bins; a shard's pieces are held by one task,
    16 bytes each, and their number does not grow with the input.
    """
    def number(level: int, shard, bin_):
        high = F.lit(level << (SHARD_BITS + BIN_BITS)).cast("long")
        return high + F.shiftleft(shard.cast("long"), BIN_BITS) + bin_

    alone = F.col("length") >= size
    done = [lengths.where(alone).select("row", F.col("row").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    left, level = cut(lengths.where(~alone).select("row", "length")), 0
    n = left.count()
    while n:
        level += 1
        shards = -(-n // shard_pieces)
        shard = F.pmod(F.xxhash64(F.lit(level), "row"), F.lit(shards))
        dealt = left.select(shard.alias("shard"), "length", "row").repartition(min(shards, 1 << 14), "shard")
        packed = cut(dealt.sortWithinPartitions("shard", F.desc("length"), "row").mapInArrow(
            lambda batches: _pack_shards(batches, size), "row long, length long, shard long, bin long, offset long, gap long"))
        still = packed.where("gap > 0").count()
        last = shards == 1 or 2 * still > n
        kept = packed if last else packed.where("gap = 0")
        done.append(kept.select("row", number(level, F.col("shard"), F.col("bin")).alias("sequence_id"), "offset"))
        if last:
            break
        left, n = packed.where("gap > 0").select("row", "length"), still
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def pack(
    docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", size: int = 2048, separator: int = 0,
    keep_ids: bool = True, shard_pieces: int = SHARD_PIECES,
) -> DataFrame:
    """The pieces of all documents with ``sequence_id`` and ``offset`` (see ``pieces`` and ``place``).

    Null, empty and blank texts are one piece, the separator; null keys and repeated rows are documents
    like any other; further columns are ignored; an empty table gives an empty result. A sequence's
    pieces lie without gaps from offset 0. The result follows from the stored pieces alone.
    """
    coded = pieces(docs, tokenizer, key, text, size, separator, keep_ids)
    # rows are numbered as they are stored, without a shuffle, and read from there ever after
    stored = materialize(coded.withColumn("__row", F.monotonically_increasing_id()), "pieces")
    placed = place(stored.select(F.col("__row").alias("row"), "length"), size, shard_pieces)
    return stored.join(placed.withColumnRenamed("row", "__row"), "__row").drop("__row")
