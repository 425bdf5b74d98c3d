from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from panel_engine.llm import simhash
from panel_engine.llm.text import components
from tests.llm.cases import LOREM, awkward, empty


def brute_fingerprint(text, k=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    grams = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, bits=2):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, fa in zip(ids, fps):
        for b, fb in zip(ids, fps):
            if (fa ^ fb).bit_count() <= bits:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_fingerprint_equals_plain_majority():
    rnd = random.Random(1)
    for n in (0, 1, 2, 3, 4, 50, 700):
        text = " \t".join(rnd.choice(["Ab", "Äb", "c", "d e", "x1"]) for _ in range(n))
        assert simhash.fingerprint(text) == brute_fingerprint(text)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


@pytest.mark.parametrize("bits", [0, 1, 2, 3, 4])
@pytest.mark.parametrize("pairwise", [4, 256])
def test_components_equal_all_pairs(spark, monkeypatch, bits, pairwise):
    monkeypatch.setattr(simhash, "PAIRWISE", pairwise)
    rnd = random.Random(bits)
    fps = [rnd.getrandbits(64) for _ in range(20)]
    for base in fps[:5]:
        f = base
        for _ in range(12):
            for _ in range(rnd.randint(1, 3)):
                f ^= 1 << rnd.randrange(64)
            fps.append(f)
    texts = {f"t{i}": f for i, f in enumerate(fps)}
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, key, text, shingle: docs.select(key, "fp"))
    docs = spark.createDataFrame([(i, t, int(np.uint64(f).view(np.int64))) for i, (t, f) in enumerate(texts.items())], "doc_id long, text string, fp long")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, max_bits=bits).collect()}
    assert got == brute_components(list(range(len(fps))), fps, bits)


def test_large_groups_are_probed_exactly():
    rnd = random.Random(3)
    base = rnd.getrandbits(64)
    fps = {base ^ sum(1 << rnd.randrange(33) for _ in range(rnd.randint(0, 4))) for _ in range(900)}
    arr = np.array(sorted(fps), np.uint64)
    a, b = simhash._links(arr, 2)
    want = {(i, j) for i in range(len(arr)) for j in range(i + 1, len(arr)) if int(arr[i] ^ arr[j]).bit_count() <= 2}
    assert set(zip(a.tolist(), b.tolist())) == want


def test_awkward_rows(spark):
    docs = awkward(spark)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r.component_id for r in got}
    assert by[1] == by[2] == by[3] == 1 and by[4] == by[5] == by[6] == 4 and by[9] == 9
    clash = docs.selectExpr("*", "1 as fp", "2 as rep", "3 as component_id")
    assert simhash.near_duplicates(clash).columns == ["doc_id", "fp", "component_id"]
    assert simhash.near_duplicates(clash).count() == docs.count()
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_groups_that_span_batches(spark):
    docs = spark.createDataFrame([(i, f"{LOREM} {'x ' * (i % 7)}") for i in range(200)], "doc_id long, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute_components(list(got), [brute_fingerprint(f"{LOREM} {'x ' * (i % 7)}") for i in got])


def test_chain_and_hub_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, j) for j in range(101, 160)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[j] == 100 for j in range(100, 160))
