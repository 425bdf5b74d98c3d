from __future__ import annotations

import random

import numpy as np
import pytest

from panel_engine.llm import recompression as rc
from panel_engine.llm import repeats
from tests.llm.cases import LOREM, awkward, empty


def brute(rows, width=13):
    """(key, n_words, n_removed, kept) of (key, text) rows."""
    least, out = {}, []
    for key, text in rows:
        w = (text or "").encode().split()
        for i in range(len(w) - width + 1):
            g = tuple(w[i:i + width])
            if key is not None:
                least[g] = min(least.get(g, key), key)
    for key, text in rows:
        w = (text or "").encode().split()
        lost = {i + j for i in range(len(w) - width + 1) if key is not None and least[tuple(w[i:i + width])] < key for j in range(width)}
        out.append((key, len(w), len(lost), b" ".join(x for i, x in enumerate(w) if i not in lost).decode()))
    return sorted(out, key=repr)


def texts(seed, n=120):
    rnd = random.Random(seed)
    vocabulary = ["a", "b", "ab", "é", "the", "x1"] + [f"w{i}" for i in range(40)]
    passages = [[rnd.choice(vocabulary) for _ in range(rnd.randint(5, 60))] for _ in range(12)]
    out = []
    for i in range(n):
        w = []
        for _ in range(rnd.randint(0, 5)):
            p = list(rnd.choice(passages)) if rnd.random() < 0.6 else [rnd.choice(vocabulary) for _ in range(rnd.randint(1, 30))]
            if rnd.random() < 0.3 and p:
                p[rnd.randrange(len(p))] = "edit"
            if rnd.random() < 0.1:
                p = ["a"] * rnd.randint(1, 40) if rnd.random() < 0.5 else ["a", "b"] * rnd.randint(1, 20)
            w += p
        out.append((i, " ".join(w)))
    return out


@pytest.mark.parametrize("seed,bundle", [(1, 300), (2, 10_000), (3, 1)])
def test_equals_brute_force(spark, monkeypatch, seed, bundle):
    rows = texts(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(repeats, "BUNDLE_BYTES", bundle)
    got = sorted((tuple(r) for r in rc.remove_repeats(docs).collect()), key=repr)
    assert got == brute(rows)


def test_equal_windows_have_equal_keys():
    rnd = random.Random(7)
    for _ in range(60):
        window = [rnd.choice("abcdefgh") for _ in range(13)]
        keys = set()
        for _ in range(4):
            left, right = ([rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 9))] for _ in range(2))
            r = rc.find(np.array([5, 9]), ["z y", " ".join(left + window + right)])
            at = np.searchsorted(r.start, len(left), side="right") - 1
            keys.add(int(r.key[at]))
            assert r.start[at] <= len(left) < r.start[at] + r.n[at] and set(r.doc.tolist()) == {9}
        assert len(keys) == 1


def test_awkward_rows(spark):
    docs = awkward(spark).selectExpr("*", "1 as doc", "2 as runs", "3 as start", "4 as n_words")
    got = sorted((tuple(r) for r in rc.remove_repeats(docs).collect()), key=repr)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert rc.remove_repeats(empty(spark)).count() == 0


def test_hot_passage_sends_one_record_a_bundle():
    docs = np.arange(500)
    r = rc.find(docs, [f"{i} {LOREM} {i}" for i in range(500)])
    assert len(r.doc) == 1500 and (~repeats.later_copies(r)).sum() <= 1001  # the two ends of each, and one middle
