"""Periodic runs of words, by uniting suffix classes along a descending common-prefix array.

The suffixes of a text that share a long prefix are sorted, neighbours in that order are joined by edges weighted
with their longest common prefix (LCP), and the edges are taken by decreasing weight as in Kruskal's spanning
tree. A union-find class at weight l then holds the positions whose suffixes agree in l words, in order of place.
Two positions that become adjacent in a class when it is united, at a distance p of at most l, start a stretch of
p + l words in which words p apart are identical, and p is its smallest period: a smaller one would put a third
position of the class between them. Stretches that reach no further left are the runs.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panel_engine.llm.quality import bound
from panel_engine.llm.text import words

#: A run has at least so many words and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Bytes of text whose words are coded together.
SLICE_BYTES = 1 << 21


class Positions:
    """An ordered set of places, in blocks, so that one insertion moves few of them."""

    BLOCK = 1024

    def __init__(self, place: int):
        self.blocks, self.size = [[place]], 1

    def _block(self, place: int) -> int:
        return 0 if len(self.blocks) == 1 else max(0, bisect_right(self.blocks, place, key=lambda b: b[0]) - 1)

    def add(self, place: int) -> None:
        k = self._block(place)
        block = self.blocks[k]
        insort(block, place)
        self.size += 1
        if len(block) > 2 * self.BLOCK:
            self.blocks[k:k + 1] = [block[:self.BLOCK], block[self.BLOCK:]]

    def around(self, place: int) -> tuple[int | None, int | None]:
        """The places before and after a member."""
        k = self._block(place)
        block = self.blocks[k]
        i = bisect_left(block, place)
        before = block[i - 1] if i else self.blocks[k - 1][-1] if k else None
        after = block[i + 1] if i + 1 < len(block) else self.blocks[k + 1][0] if k + 1 < len(self.blocks) else None
        return before, after

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block


def repeated(codes: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """Places whose next ``depth`` words may occur elsewhere in the same text, by a hash; no other place does.

    ``codes`` are the words of several texts in turn, ``ends[i]`` where the text of place i ends.
    """
    places = np.flatnonzero(np.arange(len(codes)) + depth <= ends)
    if not len(places):
        return places
    h = ends[places].astype(np.uint64)
    for k in range(depth):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + codes[places + k].astype(np.uint64)
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    tied = np.zeros(len(places), bool)
    tied[order[1:][same]] = tied[order[:-1][same]] = True
    return places[tied]


def suffix_order(codes: np.ndarray, depth: int) -> np.ndarray:
    """All places of one text in the order of their suffixes: sorted by ``depth`` words, then by prefix doubling
    among those that still tie. A class of tied places is named by where it starts in the order."""
    n = len(codes)
    padded = np.append(codes, np.full(depth, -1))
    grams = padded[np.arange(n)[:, None] + np.arange(depth)]
    order = np.lexsort(grams.T[::-1])
    grams = grams[order]
    new = np.append(True, (grams[1:] != grams[:-1]).any(axis=1))
    name = np.append(np.empty(n, np.int64), -1)
    starts = np.flatnonzero(new)
    name[order] = starts[np.cumsum(new) - 1]
    known = depth
    while True:
        sizes = np.diff(np.append(starts, n))
        tied = np.flatnonzero(np.repeat(sizes > 1, sizes))
        if not len(tied):
            return order
        at = order[tied]
        a, b = name[at], name[at + known]  # a tie of `known` words lies inside the text
        by = np.lexsort((b, a))
        at, a, b = at[by], a[by], b[by]
        order[tied] = at
        split = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
        name[at] = tied[split][np.cumsum(split) - 1]
        new[tied] = split
        starts = np.flatnonzero(new)
        known *= 2


def common_prefixes(codes: list[int], order: list[int], places: list[int], depth: int) -> dict[int, int]:
    """The LCP of each place with the one before it in ``order``; exact where it is ``depth`` or more.

    One pass in text order: a word later it is less by one at most.
    """
    before = dict(zip(order[1:], order))
    n, found, last, h = len(codes), {}, -2, 0
    for i in places:
        h = h - 1 if i == last + 1 and h > depth else 0
        last = i
        if (j := before.get(i)) is None:
            h = 0
            continue
        stop = n - max(i, j)
        while h < stop and codes[i + h] == codes[j + h]:
            h += 1
        found[i] = h
    return found


def runs(codes: np.ndarray, places: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """All maximal (start, length, smallest period) of one text, by start, then period; ``places`` from ``repeated``."""
    depth = least_prefix(least_words, least_periods)
    order = suffix_order(codes, depth)
    shared = np.zeros(len(codes), bool)
    shared[places] = True
    order = order[shared[order]].tolist()  # no other place shares `depth` words with any
    codes = codes.tolist()
    prefix = common_prefixes(codes, order, places.tolist(), depth)
    edges = sorted((-prefix[b], k) for k, b in enumerate(order[1:]) if prefix[b] >= depth)
    parent = list(range(len(order)))
    members: list[Positions | None] = [Positions(p) for p in order]

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    found = []

    def adjacent(i: int, j: int, level: int) -> None:
        p = j - i
        if p + level >= max(least_words, least_periods * p) and not (i and codes[i - 1] == codes[j - 1]):
            found.append((i, p + level, p))

    for level, k in edges:
        a, b = find(k), find(k + 1)
        if members[a].size < members[b].size:
            a, b = b, a
        large, small = members[a], list(members[b])
        parent[b], members[b] = a, None
        for place in small:
            large.add(place)
        # adjacent once all are in: with the next and the one before, where these were in the other class
        for place, following, preceding in zip(small, [*small[1:], None], [None, *small]):
            left, right = large.around(place)
            if left is not None and left != preceding:
                adjacent(left, place, -level)
            if right is not None and right != following:
                adjacent(place, right, -level)
    return sorted(found, key=lambda r: (r[0], r[2]))


def least_prefix(least_words: int, least_periods: int) -> int:
    """Words that a run's positions one period apart have in common at least; two periods or more make a run."""
    return min(max(least_words, least_periods * p) - p for p in range(1, least_words // least_periods + 2))


def collapsed(split: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words that no run contains after its first period, joined by one space."""
    if not found:
        return b" ".join(split)
    keep = np.ones(len(split), bool)
    for start, length, period in found:
        keep[start + period:start + length] = False
    return b" ".join(compress(split, keep.tolist()))


def _find(batches: Iterator[pa.RecordBatch], least_words: int, least_periods: int) -> Iterator[pa.RecordBatch]:
    depth = least_prefix(least_words, least_periods)
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("__text"))
        others = [(name, c) for name, c in zip(batch.schema.names, batch.columns) if name != "__text"]
        done = 0
        while done < batch.num_rows:
            split, used, first = [], 0, done
            while done < batch.num_rows and (not used or used < SLICE_BYTES):
                data = texts[done].as_py()
                split.append(data.split())  # bytes split at space and \x09 to \x0D only
                used += len(data)
                done += 1
            number = dict.fromkeys(chain.from_iterable(split))
            number = dict(zip(number, range(len(number))))
            sizes = np.array(list(map(len, split)))
            codes = np.fromiter(map(number.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
            ends = np.cumsum(sizes)
            places = repeated(codes, np.repeat(ends, sizes), depth)
            cuts = np.searchsorted(places, np.append(0, ends))
            found, kept = [], []
            for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                start = int(ends[k] - sizes[k])
                found.append(runs(codes[start:ends[k]], places[a:b] - start, least_words, least_periods) if a < b else [])
                kept.append(collapsed(split[k], found[-1]).decode())
            flat = np.array(list(chain.from_iterable(found)), np.int64).reshape(-1, 3)
            spans = pa.ListArray.from_arrays(
                np.cumsum([0, *map(len, found)], dtype=np.int32),
                pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays(
                [*[c.slice(first, done - first) for _, c in others], spans, pa.array(kept, pa.string())],
                names=[*[name for name, _ in others], "runs", "kept"])


def find_runs(
    docs: DataFrame, text: str | Column = "text", keep: tuple[str, ...] = ("doc_id",), least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS,
) -> DataFrame:
    """The columns ``keep``, ``runs`` (start, length, period by start, then period) and ``kept``, the collapsed text.

    Null, empty and blank texts have no words, no runs and an empty ``kept``. Repeated rows each get their row, null
    keys are kept; columns not named are ignored, so their names cannot clash; an empty table gives an empty result.
    A text is worked on whole, in memory that grows with its words; texts never meet, so nothing is shuffled.
    """
    if least_periods < 2 or least_words < 2:
        raise ValueError("a run has at least two periods and two words")
    column = F.col(text) if isinstance(text, str) else text
    source = docs.select(*keep, F.coalesce(column.cast("binary"), F.lit(b"")).alias("__text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.drop("__text").schema]
    return source.mapInArrow(
        lambda batches: _find(batches, least_words, least_periods),
        ", ".join([*fields, "runs array<struct<start:bigint,length:bigint,period:bigint>>", "kept string"]))


def with_periodic_tail(key: str = "doc_id", text: str = "text") -> Column:
    """``text``, where a tenth of all keys has a tail made periodic.

    With h the CRC-32 of the decimal key and g = floor(h / 10), a text of n words with h % 10 = 0 repeats its p words
    from word a = g % n on, p = 1 + floor((n - a) / (3 + g % 8)). A null key leaves its text as it is.
    """
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    g = F.floor(h / 10)

    def rewritten(w: Column) -> Column:
        n = F.size(w)
        a = F.pmod(g, n).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
        tail = F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.when(n > 0, F.array_join(F.slice(F.concat(F.slice(w, F.lit(1), a), tail), F.lit(1), n), " ")).otherwise(F.lit(""))

    return F.when(F.pmod(h, F.lit(10)) == 0, bound(words(text), rewritten)).otherwise(F.col(text))
