"""Suffix and common-prefix arrays by external induced sorting.

The text is a sequence of integers. Suffixes that start at a local minimum of type S (LMS) are sorted
first: their substrings are put through an external sort and named, and the sequence of names is sorted by
recursion until names are unique. All other suffixes follow by induction. Disk-backed priority queues
carry tuples upwards for the L suffixes and downwards for the S suffixes, ordered by first symbol and rank of the rest:
when a suffix leaves the queue, the one before it in the text enters, ranked by what has just left. Each
tuple also carries the common prefix that its rest has with the rest that left before it, so the
common-prefix values come out with the order. Beyond ``limit`` tuples the queues and the sort of the LMS
substrings go to temporary files of the task. The text, the lists of its symbols, types and runs, the LMS names
and the resulting arrays stay in memory, so that a text must fit there.
"""

from __future__ import annotations

import heapq
import pickle
import tempfile
from array import array
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator
from itertools import islice

import numpy as np

#: Tuples that a queue or sort keeps in memory.
LIMIT = 1 << 20


class Queue:
    """Priority queue of (symbol, rank, value), for ranks that rise from push to push, as in induction.

    Rows of one symbol then leave in the order in which they came: a heap orders the symbols, and each has
    a line of its rows. Lines that outgrow ``limit`` rows together go to one temporary file, a block each.
    """

    def __init__(self, limit: int = LIMIT):
        self.heap: list[int] = []
        self.lines: dict[int, array] = {}
        self.stored: dict[int, deque] = {}
        self.limit, self.held, self.file, self.blocks = limit, 0, None, 0

    def push(self, symbol: int, value: int) -> None:
        line = self.lines.get(symbol)
        if line is None:
            line = self.lines[symbol] = array("q")
            heapq.heappush(self.heap, symbol)
        line.append(value)
        self.held += 1
        if self.held > self.limit:
            self.spill()

    def spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for symbol, line in self.lines.items():
            if line:
                self.stored.setdefault(symbol, deque()).append((self.file.tell(), len(line)))
                line.tofile(self.file)
                self.lines[symbol] = array("q")
                self.blocks += 1
        self.held = 0

    def least(self) -> int | None:
        return self.heap[0] if self.heap else None

    def drain(self) -> Iterator[int]:
        """Values of the least symbol, those pushed meanwhile included; it is gone afterwards."""
        symbol = self.heap[0]
        while True:
            if self.stored.get(symbol):
                at, n = self.stored[symbol].popleft()
                self.file.seek(at)
                block = array("q")
                block.fromfile(self.file, n)
            else:
                block, self.lines[symbol] = self.lines[symbol], array("q")
                self.held -= len(block)
            if not block:
                break
            yield from block
        heapq.heappop(self.heap)
        del self.lines[symbol]


def types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is of type S: smaller than the next. The empty suffix ends the text."""
    n = len(text)
    differs = np.append(text[:-1] != text[1:], True)
    decides = np.minimum.accumulate(np.where(differs, np.arange(n), n)[::-1])[::-1]  # next place that differs from its own next
    return np.append(text[:-1] < text[1:], False)[decides]


class LeastSince:
    """Least of the values appended since a given one: a stack of those not yet undercut."""

    def __init__(self):
        self.at: list[int] = []
        self.value: list[int] = []

    def append(self, now: int, value: int) -> None:
        if not value:  # undercuts all
            self.at, self.value = [now], [0]
            return
        while self.value and self.value[-1] >= value:
            self.value.pop()
            self.at.pop()
        self.at.append(now)
        self.value.append(value)

    def since(self, start: int) -> int:
        return self.value[bisect_left(self.at, start)]


def externally_sorted(keys: Iterator[tuple[bytes, int]], limit: int) -> Iterator[tuple[bytes, int]]:
    """(key, number) pairs in order; runs of ``limit`` pairs are sorted in memory and merged from disk."""
    files = []
    part = list(islice(keys, limit))
    while len(part) == limit:
        files.append(tempfile.TemporaryFile())
        for row in sorted(part):
            pickle.dump(row, files[-1])
        files[-1].seek(0)
        part = list(islice(keys, limit))

    def stream(file) -> Iterator[tuple[bytes, int]]:
        while True:
            try:
                yield pickle.load(file)
            except EOFError:
                return

    part.sort()
    return heapq.merge(part, *map(stream, files)) if files else iter(part)


def lms_order(text: np.ndarray, small: np.ndarray, lms: np.ndarray, limit: int) -> np.ndarray:
    """``lms`` places in suffix order: substrings up to the next one are sorted and named, then the names."""
    symbols = (2 * (text.astype(np.int64) + 1) + small).astype(">u4").tobytes()  # of equal symbols, L before S
    ends = np.append(lms[1:] + 1, len(text) + 1)  # the last runs into the end of the text, which no other does
    symbols += bytes(4)
    keys = ((symbols[4 * a:4 * b], i) for i, (a, b) in enumerate(zip(lms.tolist(), ends.tolist())))
    names, name, before = np.empty(len(lms), np.int64), -1, None
    for key, i in externally_sorted(keys, limit):
        name += key != before
        before = key
        names[i] = name
    if name + 1 == len(lms):
        return lms[np.argsort(names)]
    return lms[suffix_array(names, 0, limit)[0]]


def common(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Common prefixes of suffix pairs, up to ``cap``."""
    out, alive = np.zeros(len(a), np.int64), np.arange(len(a))
    for d in range(cap):
        alive = alive[(a[alive] + d < len(text)) & (b[alive] + d < len(text))]
        alive = alive[text[a[alive] + d] == text[b[alive] + d]]
        if not len(alive):
            break
        out[alive] += 1
    return out


def suffix_array(text: np.ndarray, cap: int = 0, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """Places of the suffixes in order, and the common prefix of each with the one before, up to ``cap``."""
    n = len(text)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    small = types(text)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    order = lms_order(text, small, lms, limit) if len(lms) > 1 else lms
    shared = [0, *common(text, order[1:], order[:-1], cap).tolist()] if cap else [0] * len(order)
    differs = np.append(text[:-1] != text[1:], True)
    stops = np.minimum.accumulate(np.where(differs, np.arange(n), n)[::-1])[::-1]
    run = np.minimum(stops - np.arange(n) + 1, max(cap, 1)).tolist()  # equal symbols from here on
    symbol, is_small = text.tolist(), small.tolist()

    # a row of the queue: place and the common prefix of its rest, in one integer
    bits = max(cap, 1).bit_length()
    mask = (1 << bits) - 1

    # upwards: L suffixes, between the sorted LMS ones
    queue, least, last = Queue(limit), LeastSince(), {}
    up = array("q"), array("q")
    queue.push(symbol[n - 1], (n - 1) << bits)
    places, q, now, prev = order.tolist(), 0, 0, -1
    append, since = least.append, least.since
    while queue.heap or q < len(places):
        c = queue.least()
        if c is None or q < len(places) and symbol[places[q]] < c:
            c = symbol[places[q]]
        else:
            fresh = True
            for row in queue.drain():
                i = row >> bits
                value = 0 if fresh else min((row & mask) + 1, cap)
                fresh = False
                up[0].append(i)
                up[1].append(value)
                if cap:
                    append(now, value)
                if i and not is_small[i - 1]:
                    d = symbol[i - 1]
                    queue.push(d, (i - 1) << bits | (since(last[d] + 1) if cap and d in last else 0))
                    last[d] = now
                prev, now = i, now + 1
        lms_before = prev >= 0 and is_small[prev]
        while q < len(places) and symbol[i := places[q]] == c:
            if lms_before:
                value = shared[q]
            else:
                value = min(run[prev], run[i]) if prev >= 0 and symbol[prev] == c else 0
            lms_before = True
            q += 1
            if cap:
                append(now, value)
            if not is_small[i - 1]:
                d = symbol[i - 1]
                queue.push(d, (i - 1) << bits | (since(last[d] + 1) if cap and d in last else 0))
                last[d] = now
            prev, now = i, now + 1

    # downwards: S suffixes, between the L ones
    queue, least, last = Queue(limit), LeastSince(), {}
    append, since = least.append, least.since
    down = array("q"), array("q")  # places, and the common prefix with the one before here
    q, now, prev = len(up[0]) - 1, 0, -1
    while queue.heap or q >= 0:
        c = queue.least()
        if c is None or q >= 0 and symbol[up[0][q]] > -c:
            c = symbol[up[0][q]]
        else:
            c = -c
            fresh = True
            for row in queue.drain():
                i = row >> bits
                value = 0 if fresh else min((row & mask) + 1, cap)
                fresh = False
                down[0].append(i)
                down[1].append(value)
                if cap:
                    append(now, value)
                if i and is_small[i - 1]:
                    d = symbol[i - 1]
                    queue.push(-d, (i - 1) << bits | (since(last[d] + 1) if cap and d in last else 0))
                    last[d] = now
                prev, now = i, now + 1
        while q >= 0 and symbol[i := up[0][q]] == c:
            if prev < 0 or symbol[prev] != c:
                value = 0
            else:
                value = min(run[prev], run[i]) if is_small[prev] else up[1][q + 1]
            q -= 1
            down[0].append(i)
            down[1].append(value)
            if cap:
                append(now, value)
            if i and is_small[i - 1]:
                d = symbol[i - 1]
                queue.push(-d, (i - 1) << bits | (since(last[d] + 1) if cap and d in last else 0))
                last[d] = now
            prev, now = i, now + 1
    down[1].append(0)
    return np.array(down[0], np.int64)[::-1], np.array(down[1], np.int64)[:0:-1]
