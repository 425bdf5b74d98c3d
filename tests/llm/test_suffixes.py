from __future__ import annotations

import random

import numpy as np
import pytest

from panel_engine.llm.suffixes import Queue, suffix_array


def brute(text, cap):
    t = list(text)
    sa = sorted(range(len(t)), key=lambda i: t[i:])
    lcp = [0]
    for a, b in zip(sa, sa[1:]):
        k = 0
        while k < cap and max(a, b) + k < len(t) and t[a + k] == t[b + k]:
            k += 1
        lcp.append(k)
    return sa, lcp[:len(t)]


@pytest.mark.parametrize("limit", [3, 1 << 20])
@pytest.mark.parametrize("cap", [4, 50])
def test_equals_sorting(limit, cap):
    rnd = random.Random(limit + cap)
    texts = [b"", b"a", b"aa", b"ab", b"ba", b"banana", b"mississippi", b"aaaa" * 20, b"ab" * 40, b"abcabcab" * 9]
    texts += [bytes(rnd.choice(b"abc"[:k]) for _ in range(rnd.randint(1, 120))) for k in (1, 2, 3) for _ in range(25)]
    for t in texts:
        sa, lcp = suffix_array(np.frombuffer(t, np.uint8).astype(np.int64), cap, limit)
        assert (sa.tolist(), lcp.tolist()) == (brute(t, cap) if t else ([], [])), t


def test_queue_goes_to_disk_and_back():
    rnd = random.Random(1)
    queue, want, got = Queue(limit=8), [], []
    for i in range(2000):
        symbol = rnd.randint(0, 9)
        queue.push(symbol, i)
        want.append((symbol, i))
    more = iter(range(2000, 2100))
    while queue.heap:
        symbol = queue.least()
        for value in queue.drain():
            got.append((symbol, value))
            if (extra := next(more, None)) is not None:  # pushed while its own line leaves
                queue.push(symbol, extra)
                want.append((symbol, extra))
    assert got == sorted(want) and queue.blocks > 100
