from __future__ import annotations

import random

import numpy as np
import pytest

from panel_engine.llm import repeats
from panel_engine.llm import suffixdedup as sd
from tests.llm.cases import awkward, empty


def brute(rows, width=50):
    least, out = {}, []
    for key, text in rows:
        b = (text or "").encode()
        for i in range(len(b) - width + 1):
            if key is not None:
                least[b[i:i + width]] = min(least.get(b[i:i + width], key), key)
    for key, text in rows:
        b = (text or "").encode()
        lost = {i + j for i in range(len(b) - width + 1) if key is not None and least[b[i:i + width]] < key for j in range(width)}
        out.append((key, len(b), len(lost), sum(i in lost and i - 1 not in lost for i in range(len(b))), bytes(x for i, x in enumerate(b) if i not in lost)))
    return sorted(out, key=repr)


def texts(seed, n=60):
    rnd = random.Random(seed)
    piece = lambda k: "".join(rnd.choice(["a", "b", "é", " ", "the ", "世"]) for _ in range(k))
    passages = [piece(rnd.randint(20, 150)) for _ in range(8)] + ["x" * 120, "xy" * 70]
    out = []
    for i in range(n):
        t = ""
        for _ in range(rnd.randint(0, 4)):
            p = rnd.choice(passages) if rnd.random() < 0.6 else piece(rnd.randint(1, 40))
            at = rnd.randrange(len(p))
            t += p[:at] + rnd.choice(["", "", "!", "edit"]) + p[at:]
        out.append((i, t))
    return out


@pytest.mark.parametrize("seed,bundle,shard,limit", [(1, 400, 1 << 20, 1 << 20), (2, 1, 500, 20), (3, 1 << 20, 1, 1 << 20)])
def test_equals_brute_force(spark, monkeypatch, seed, bundle, shard, limit):
    rows = texts(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(repeats, "BUNDLE_BYTES", bundle)
    got = sorted(((r[0], r[1], r[2], r[3], bytes(r[4])) for r in sd.remove_repeats(docs, shard_bytes=shard, limit=limit).collect()), key=repr)
    assert got == brute(rows)


def test_least_places():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 9, 200)
    for span in (1, 2, 3, 7, 8, 27):
        assert sd.least_places(v, span).tolist() == [i + int(np.argmin(v[i:i + span])) for i in range(200 - span + 1)]


def test_awkward_rows(spark):
    docs = awkward(spark).selectExpr("*", "1 as doc", "2 as runs", "3 as k", "4 as n_bytes")
    got = sorted(((r[0], r[1], r[2], r[3], bytes(r[4])) for r in sd.remove_repeats(docs).collect()), key=repr)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert sd.remove_repeats(empty(spark)).count() == 0


def test_sorts_only_what_several_documents_have(monkeypatch):
    rnd = random.Random(5)
    base = bytes(rnd.choice(b"abcdefgh ") for _ in range(90))
    rows = [(i, 7, base[:20 + i % 60] + b"%04d" % i + base[20 + i % 60:]) for i in range(200)] + [(200, 0, base), (201, 3, base), (201, 99, base)]
    least, want, sizes = {}, set(), []
    for d, _, b in rows:
        for i in range(len(b) - 49):
            least[b[i:i + 50]] = min(d, least.get(b[i:i + 50], d))
    for d, s, b in rows:
        want |= {(d, s + i) for i in range(len(b) - 49) if least[b[i:i + 50]] < d}
    sort = sd.suffix_array
    monkeypatch.setattr(sd, "suffix_array", lambda text, *a: sizes.append(len(text)) or sort(text, *a))
    got = {(d, s + i) for d, s, n in zip(*[x.tolist() for x in sd.repeated(rows)]) for i in range(n)}
    assert got == want
    assert sum(sizes) < sum(len(b) for _, _, b in rows) / 3
    assert [x.tolist() for x in sd.repeated([(1, 0, b"a" * 20), (2, 0, base), (3, 5, b"b" * 50)])] == [[], [], []]
